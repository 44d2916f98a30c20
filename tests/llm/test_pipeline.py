"""The pipeline's stages on odd tables, each against what it must do."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plotwise.llm import bpe, decontaminate, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(zip(("classify", "near_dedup", "remove_leaks", "mask_secrets", "tokenize"), (f for _, f in corpus_pipeline.STAGES)))
KEY = "xK9fQ2mZ7Lp4Wv8Rt3Yb6Nc1"


def frame(spark, rows):
    """Documents with columns whose names the operators might use themselves."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return docs.withColumns({"first": F.lit(1), "mark": F.lit("m"), "component_id": F.lit(2), "items": F.lit("i"), "score": F.lit(0.5), "own": F.array(F.lit(1)), "group": F.struct(F.lit(3).alias("a"))})


def kept(spark, name, rows, folder="/root/testdata/sf0.001"):
    docs = frame(spark, rows)
    out = STAGE[name](spark, docs, folder)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_near_dedup_with_null_ids(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "only here is this text said at all"
    rows = [(1, a), (None, a), (None, a.upper()), (None, b), (None, b), (None, c), (2, c), (5, None), (4, ""), (None, " "), (3, "x"), (3, "y"), (7, "Y")]
    assert kept(spark, "near_dedup", rows) == sorted([(1, a), (None, b), (2, c), (4, ""), (3, "x"), (3, "y")], key=str)


@pytest.mark.parametrize("name", ["classify", "near_dedup", "remove_leaks", "mask_secrets"])
def test_columns_of_any_type_and_name(spark, name):
    """Columns that cannot be ordered, and names that need quoting, come out as they went in."""
    rows = [(1, "one two three four five six"), (None, "one two three four five six"), (None, "seven eight nine ten eleven"), (None, "seven eight nine ten eleven"), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs = docs.withColumns({"a.b": F.create_map(F.lit("k"), F.col("doc_id")), "v`w": F.array(F.create_map(F.lit(1), F.col("text"))), "x y": F.struct(F.lit(1).alias("p.q")), "Mark": F.lit(7)})
    out = STAGE[name](spark, docs, "/root/testdata/sf0.001")
    assert out.dtypes == docs.dtypes
    got = sorted(((r[0], r[1]) for r in out.collect()), key=str)
    assert got == sorted(rows if name != "near_dedup" else [rows[0], rows[2], rows[4]], key=str)
    assert all(r["a.b"] == {"k": r[0]} and r[6] == [{1: r[1]}] for r in out.collect())


def test_secrets_are_masked(spark):
    rows = [(1, f"use {KEY} now"), (1, f"use {KEY} now"), (None, "password: hunter22 x"), (2, None), (3, ""), (4, "nothing here")]
    assert kept(spark, "mask_secrets", rows) == sorted(((i, secrets.redact(t)) for i, t in rows), key=str)
    out = corpus_pipeline.mask_secrets(spark, frame(spark, rows), "").collect()
    assert {(r.text, r.n_chars) for r in out} == {("use [SECRET] now", 16), ("[SECRET] x", 10), (None, 0), ("", 0), ("nothing here", 12)}


def test_leaks_go(spark, tmp_path):
    item = "which of these tall birds may be seen by the river at noon when the water is low"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "before it " + item + " and after"), (None, item), (2, None), (3, ""), (4, "a river"), (4, "a river")]
    assert kept(spark, "remove_leaks", rows, str(tmp_path)) == sorted([(2, None), (3, ""), (4, "a river"), (4, "a river")], key=str)


def test_classifier_keeps_by_score(spark, tmp_path):
    labels = [(k, int(k % 4 > 0), 0) for k in range(200)] + [(None, 1, 0), (5, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(k, "a good sentence of plain words, with an end. " * 5 if k % 4 else "BUY!!! $$$ 99 %% " * 9) for k in range(200)] + [(None, None), (None, ""), (300, "BUY!!! $$$ 99 %% " * 9), (301, "x" * 300_000)]
    docs = frame(spark, rows)
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = {(r.doc_id): r.score for r in quality.score(docs.where("doc_id is not null"), model).collect()}
    got = kept(spark, "classify", rows, str(tmp_path))
    assert [x for x in got if x[0] is not None] == sorted(((i, t) for i, t in rows if i is not None and score[i] >= 0.3), key=str)
    assert 300 not in {i for i, _ in got} and {i for i, _ in got} >= {k for k in range(200) if k % 4}


def test_tokens(spark):
    import public_tokenizers

    rows = [(1, "some text 12"), (1, "some text 12"), (None, None), (2, "")]
    out = corpus_pipeline.tokenize(spark, frame(spark, rows), "").collect()
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    assert sorted((tuple(r)[:4] for r in out), key=str) == sorted(((i, *codec.digest(t or "")) for i, t in rows), key=str)


def test_crowded_near_copies(spark, monkeypatch):
    """A large group, alike in parts only, in many small blocks, against all pairs."""
    import random

    from plotwise.llm import near_copies

    monkeypatch.setattr(near_copies, "BLOCK", 32)
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = []
    for k in range(260):
        words = list(base)
        for _ in range(rng.choice((1, 2, 4, 6, 9, 14))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    sets = [set(near_copies.shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert 10 < sum(root[k] == k for k in range(len(rows))) < 200
    assert kept(spark, "near_dedup", rows) == sorted(((k, t) for k, t in rows if find(k) == k), key=str)


@pytest.mark.parametrize("name", STAGE)
def test_nothing_comes_of_nothing(spark, name):
    out = STAGE[name](spark, frame(spark, []), "/root/testdata/sf0.001")
    assert out.count() == 0


def test_whole_run_is_its_stages_by_hand(spark):
    """run() on real documents against the same decisions taken in plain Python."""
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:4] for r in corpus_pipeline.run(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= 0.3}
    texts = {i: t for i, t in duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall() if i in good}
    shingles = {}
    for i, t in texts.items():
        words = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        shingles[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in shingles.items():
        for j, y in shingles.items():
            if j < i and (x == y or 5 * len(x & y) >= 4 * len(x | y) > 0):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    index = decontaminate.Index(duckdb.sql(f"select item_id, text from '{d}/benchmark.parquet'").fetchall())
    left = [i for i in texts if find(i) == i and not index.holds(texts[i])]
    import public_tokenizers

    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    assert got == {i: codec.digest(secrets.redact(texts[i]) or "") for i in left}


def test_chance_meetings_make_no_family(spark, monkeypatch):
    """Texts that share single phrases with many others, and nothing else, are not compared with each other."""
    import random

    from plotwise.llm import near_copies

    rng, compared, whole = random.Random(4), [], near_copies._compared
    phrases = [" ".join(f"p{k}w{j}" for j in range(10)) for k in range(200)]
    rows = [(k, " ".join(rng.sample(phrases, 20))) for k in range(300)]
    rows += [(900 + k, rows[k][1] + " and more") for k in range(3)]

    def counted(members, sets):
        compared.append(members.count())
        return whole(members, sets)

    monkeypatch.setattr(near_copies, "_compared", counted)
    assert kept(spark, "near_dedup", rows) == sorted(rows[:300], key=str)
    assert compared[0] <= 100  # filed under their least shingles: nearly all


def test_alike_sets_meet():
    """Sets of a similarity of exactly 4/5 share a place, whatever their size; sets that have little in common do not."""
    import numpy as np

    from plotwise.llm import near_copies

    rng = np.random.default_rng(6)

    def meet(common, all_):
        x = rng.integers(0, 1 << 64, all_, np.uint64)
        half = common + (all_ - common) // 2
        return len(np.intersect1d(near_copies.places_of(np.sort(x[:half])), near_copies.places_of(np.sort(np.concatenate((x[:common], x[half:])))))) > 0

    assert all(meet(4 * n, 5 * n) for n in (1, 2, 20, 2000) for _ in range(250))
    assert sum(meet(3, 300) for _ in range(1000)) <= 2
