"""Spelling variants against all pairs of words, compared letter by letter."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plotwise.llm import spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    base = ["".join(rng.choice("abé") for _ in range(rng.choice((6, 7, 8, 11)))) for _ in range(160)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "Aaaaaaaab", "Éaaaaaa", "éaaaaaa", "z" * 3000, "z" * 2999, "z" * 1500 + "y" + "z" * 1499, "abc×def"]
    weights = [rng.choice((1, 1, 1, 8, 60)) for _ in base]
    out = []
    for doc in range(400):
        picked = rng.choices(base, weights, k=40)
        for k in range(4):
            w = picked[k]
            at = rng.randrange(len(w))
            picked.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + "b" + w[at + 1 :]]))
        out.append((doc, rng.choice([" ", ", ", "\n", "1"]).join(picked)))
    return out + [(None, "aaaaaa " * 9), (None, None), (7, ""), (7, out[7][1]), (7, out[7][1])]


@pytest.mark.parametrize("limit", [3, 40, 100_000])
def test_variants(spark, rows, limit):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "path", "depth", "subtree", "at", "a", "b")})
    got = sorted(map(tuple, spelling.variants(df, limit).collect()))
    want = brute(rows)
    assert got == want and len(want) > 150
    assert any(w[2] not in (w[0], w[1]) for w in want), "no chain of forms is tested"


def test_near_words():
    rng = random.Random(1)
    for letters in ("ab", "abcdefgh"):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(7))) for _ in range(400)})
        got = [tuple(sorted(p)) for p in spelling.near_words(words)]
        want = {(i, j) for i in range(len(words)) for j in range(i) if one_edit(words[i], words[j])}
        assert len(got) == len(set(got)) and set(got) == {tuple(sorted(p)) for p in want}
    assert spelling.near_words([]) == [] and spelling.near_words(["", "a"]) == [(1, 0)]


def test_query(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, spelling.op11_spelling_variants(spark, str(tmp_path)).collect())) == brute(rows)
