"""The manifest against a tree built level by level in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plotwise.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_up(nodes):
    """(root, proof of each node): level by level, every three neighbours, siblings as (left, right)."""
    at, proofs, level = list(range(len(nodes))), [[] for _ in nodes], list(nodes)
    while len(level) > 1:
        for leaf, place in enumerate(at):
            first = place - place % 3
            proofs[leaf].append((level[first:place], level[place + 1 : first + 3]))
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
        at = [place // 3 for place in at]
    return level[0], proofs


def brute(rows):
    """doc rows (doc_id, text, lang, source, n_chars) to the sorted result rows."""
    trees = {}
    for doc_id, text, lang, source, n in rows:
        leaf = row_digest(doc_id, source, lang, n, text)
        other = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
            other = row_digest(doc_id, source, lang, n, text.replace("\n", ""))
        trees.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, other, doc_id))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    done = {s: (sorted(trees[s]), *levels_up([r[2] for r in sorted(trees[s])])) for s in order}
    root, above = levels_up([done[s][1] for s in order])
    out = []
    for s, up in zip(order, above):
        leaves, subroot, proofs = done[s]
        for (_, _, leaf, other, doc_id), own in zip(leaves, proofs):
            value = other
            for left, right in own + up:
                value = sha("".join(left) + value + "".join(right))
            out.append((doc_id, leaf, subroot, root, sha("".join("".join(a + b) for a, b in own + up)), value, value == root))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, "b": 3, None: 1}, {"a": 1500, "b": 27, "ä": 28, "Z": 1, None: 5, "": 4, "c": 729, "d": 730}])
def test_manifest(spark, sizes):
    rng, rows = random.Random(4), []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice(["one\ntwo", "plain", "", "ä\n\nü", "x" * 5000 + "\n"])
            rows.append((rng.randrange(1 << 40) if len(rows) else 3, text, rng.choice(["en", None]), source, rng.choice([len(text), None])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit(1), "pos": F.lit("x"), "size": F.lit(2), "digest": F.lit(3), "block": F.lit(4), "leaf": F.lit(5)})
    assert key(merkle.manifest(df).collect()) == key(brute(rows))


def test_odd_rows(spark):
    rows = [(None, "a\nb", "en", "s", 3), (None, None, None, None, None), (1, None, None, "s", None), (2, "a", "en", "s", 1), (2, "b", "en", "s", 1)]
    assert key(merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()) == key(brute(rows))
    twins = [(5, "a\nb", "en", "s", 3)] * 7 + rows
    got, want = merkle.manifest(spark.createDataFrame(twins, SCHEMA)).collect(), brute(twins)
    assert key(got) == key(want)  # equal rows may swap proofs among them, the rows of the result are the same


def test_many_sources(spark):
    rows = [(k, f"t\n{k}", "en", f"s{k % 1600}", k) for k in range(2000)]
    assert key(merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()) == key(brute(rows))


def test_query(spark, tmp_path):
    rows = [(k, f"line {k}\nmore", "en", f"s{k % 3}", 10 + k) for k in range(50)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert key(got) == key(brute(rows))
    assert any(r.verified for r in got) and not all(r.verified for r in got)
