"""Decontamination against the edit distance of every item to every text, recall by kind of edit, and odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from plotwise.llm import decontaminate
from tests.llm.recall import KINDS, edited, recall

WORDS = [a + b for a in "ba ke li mo nu ra se ti".split() for b in "n r s t l m".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def slow_edits(item, text):
    """Least edit distance of the item to any stretch of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, symbol in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, other in enumerate(text, 1):
            last, row[j] = row[j], min(last + (symbol != other), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_edit_distance_of_a_stretch():
    rng = random.Random(1)
    for _ in range(600):
        item, text = [rng.randrange(2, 6) for _ in range(rng.randint(1, 90))], [rng.randrange(1, 6) for _ in range(rng.randint(0, 120))]
        most = rng.randint(0, 95)
        assert decontaminate.edits_to_stretch(item, text, most) == min(slow_edits(item, text), most + 1)


@pytest.mark.parametrize("kind", KINDS)
def test_recall(kind):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.choice((5, 12, 20, 40, 63)))) for k in range(60)]
    assert recall(items, kind, 3) >= 0.95


def test_all_items_in_all_texts():
    """Few edits or many, whole items or parts: what is found is held, and nearly all that is held is found."""
    rng = random.Random(6)
    items = [(k, prose(rng, rng.choice((1, 3, 8, 25, 70, 200)))) for k in range(24)]
    index, held, hits = decontaminate.Index(items), 0, 0
    for k in range(60):
        own = rng.choice(items)[1].split()
        part = edited(own, rng.randint(0, max(0, len(own) * 3 // 10)), "mixed", rng) if rng.random() < 0.8 else own[: len(own) // 2]
        text = " ".join([prose(rng, rng.randint(0, 40)), *part, prose(rng, rng.randint(0, 40))])
        words = decontaminate.words_of(text)
        want = {i for i, t in items if slow_edits(t.split(), words) <= int(len(t.split()) * decontaminate.SHARE + 1e-9)}
        got = set(index.holds(text))
        assert got <= want
        held, hits = held + len(want), hits + len(got)
    assert hits >= 0.95 * held > 0


def test_long_items_and_shared_runs():
    """An item of 20,000 words needs no table of its square; a run that all items share points to few places."""
    rng = random.Random(7)
    long = prose(rng, 20_000)
    start = prose(rng, 6)
    items = [(1, long)] + [(k, start + " " + prose(rng, 30)) for k in range(2, 2_000)]
    index = decontaminate.Index(items)
    changed = edited(long.split(), 1_500, "mixed", rng)
    assert index.holds(" ".join([*changed, items[700][1], "x"])) == sorted({1, items[700][0]})
    assert max(len(p) for _, pointed in index.runs.values() for p in pointed) <= 64 * 10
    assert index.holds(prose(rng, 100_000)) == [] and index.holds((start + " ") * 5_000) == []


def test_tables(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randint(14, 40))) for k in range(25)] + [(90, None), (91, ""), (92, again := prose(rng, 20)), (92, again), (93, again), (None, again)]
    rows = [(k, prose(rng, 50) + " " + text.upper() + " " + prose(rng, 30)) for k, text in items[:25]]
    rows += [(100, prose(rng, 400)), (101, None), (102, ""), (103, again), (103, again), (None, again), (104, items[3][1] + " " + items[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item": F.lit(1), "_held": F.lit("x"), "held": F.lit(2)})
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(k, [k]) for k in range(25)] + [(100, []), (101, []), (102, []), (103, [92, 93]), (103, [92, 93]), (None, [92, 93]), (104, [3, 4])], key=str)
    one = decontaminate.matches(docs.drop("_held"), benchmark)
    assert sorted([(r.doc_id, r["items"]) for r in one.collect()], key=str) == want
    monkeypatch.setattr(decontaminate, "PORTION", 10)
    several = decontaminate.matches(docs, benchmark)
    assert len(decontaminate._portions(benchmark)) > 2 and several.columns == [*docs.columns, "items"]
    assert sorted([(r.doc_id, r["items"]) for r in several.collect()], key=str) == want
