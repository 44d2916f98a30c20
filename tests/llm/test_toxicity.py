"""The convolutional classifier against plain loops, on odd rows, and by held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotwise.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in "ba ke li mo nu ra".split() for b in "n r s t".split() for c in "a e o".split()]


def prose(rng, n, extra=()):
    words = [rng.choice(WORDS + ["the", "of", "is"]) for _ in range(n)]
    for w in extra:
        words.insert(rng.randrange(len(words) + 1), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """Documents of which a quarter holds a bad word, or a word with a bad beginning."""
    rng = random.Random(2)
    rows = []
    for k in range(1200):
        toxic = k % 4 == 0
        bad = [rng.choice(["Vile!", "rotten", "grubu" + rng.choice(WORDS)]) for _ in range(rng.choice((1, 2, 3)))] if toxic else []
        rows.append((k, prose(rng, rng.choice((5, 30, 120)), bad), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(corpus):
    return toxicity.fit([t for _, t, _ in corpus], np.array([y for _, _, y in corpus]))


def naive(model, text):
    """The score by loops over places, without stretches, caches or shared sums."""
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).strip().split(" ")
    row = lambda b: model.embedding[model.rows[b] if b >= 0 else -1]
    vectors = [sum(row(b) for b in toxicity.parts_of(w)) for w in words]
    hidden = []
    for k, width in enumerate(toxicity.WIDTHS):
        best = np.max([sum(vectors[p + s] @ model.filters[k][s] for s in range(width) if p + s < len(words)) for p in range(len(words))], axis=0)
        hidden.append(best)
    logit = np.maximum(np.concatenate(hidden) + model.bias, 0) @ model.out + model.intercept
    counts = [sum(w in f for w in words) for f in toxicity.FUNCTION_WORDS.values()]
    top = sorted(counts)
    language = counts.index(top[-1]) if top[-1] > top[-2] else len(counts)
    return 1 / (1 + np.exp(-(logit - model.thresholds[language])))


def test_against_loops(model, corpus, monkeypatch):
    rng = random.Random(8)
    texts = [None, "", " \n", "!?", "one", "vile", "der die das", "le the", "ÄÖ ß", prose(rng, 700, ["vile"]), *(t for _, t, _ in corpus[:40]), corpus[0][1], corpus[0][1]]
    want = [naive(model, t) for t in texts]
    monkeypatch.setattr(toxicity, "STRETCH", 64)
    monkeypatch.setattr(toxicity, "CACHE", 50)
    score = model.scorer()
    got = np.concatenate([score(pa.array(texts[k : k + 9], pa.string())) for k in range(0, len(texts), 9)])
    assert np.allclose(got, want, atol=1e-4)


def test_gradient_places():
    """The place noted for a pooled value is where the filter takes it."""
    rng = np.random.default_rng(0)
    model = toxicity.Convolution(filters=[rng.normal(size=(w, toxicity.SIZE, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS])
    vectors = rng.normal(size=(30, toxicity.SIZE)).astype(np.float32)
    starts, places = np.array([0, 7, 8, 50]), rng.integers(0, 30, 50)
    best, where = model.pooled(model.pieces(vectors), starts, places, argmax=True)
    for d in range(3):
        for f in range(best.shape[1]):
            k, p = f // toxicity.FILTERS, where[d, f]
            value = sum(vectors[places[p + s]] @ model.filters[k][s][:, f % toxicity.FILTERS] for s in range(toxicity.WIDTHS[k]) if p + s < starts[d + 1])
            assert starts[d] <= p < starts[d + 1] and abs(value - best[d, f]) < 1e-4


def test_query(spark, corpus, tmp_path):
    rows = [(i, t, "en", "s", len(t)) for i, t, _ in corpus] + [(None, "vile", "en", "s", 4), (7, corpus[7][1], "en", "s", 1), (2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "rotten vile " + "ban " * 200_000, "en", "s", 0)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({"label": F.lit(1), "score": F.lit("x"), "held_out": F.lit(2), "toxic": F.lit(0)})
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, y) for i, _, y in corpus] + [(None, 1, 1), (3, 0, 0), (3, 0, None), (4, 1, 1), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op12_toxicity(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(r[0] or -1 for r in rows)
    for r in got:
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = {i: y for i, _, y in corpus}
    told = [(r.predicted, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert sum(p == y for p, y in told) >= 0.97 * len(told) > 100
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    other = spark.createDataFrame([(i, t, "xx", "other", n) for i, t, _, _, n in rows], SCHEMA)
    learnt = toxicity.train(other, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {r.doc_id: r.score for r in toxicity.score(other, learnt).collect()} == pytest.approx({r.doc_id: r.score for r in got}, abs=1e-6)


def test_without_two_labels(spark):
    docs = spark.createDataFrame([(k, "a b") for k in range(6)], "doc_id long, text string")
    for labels, want in (([], 0.5), ([(k, 1, 1) for k in (1, 2, 3)], None)):
        scores = {r.score for r in toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
        assert len(scores) == 1 and (want is None or scores == {want})


def test_all_labelled_documents_teach(spark, monkeypatch):
    """Documents of a kind that comes last in any order of ids are learnt from, by several trainers, and each only once a round."""
    rng, rows = random.Random(5), []
    for k in range(6000):
        toxic = k % 3 == 0
        rows.append((k, prose(rng, 12, [rng.choice(["vile", "rotten"])] if toxic else []), int(toxic)))
    monkeypatch.setattr(toxicity, "TRAINER", 1500)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    read, whole = [], toxicity._round

    def counted(examples, *rest):
        read.append((examples.rdd.getNumPartitions(), examples.count()))
        return whole(examples, *rest)

    monkeypatch.setattr(toxicity, "_round", counted)
    model = toxicity.train(docs, labels)
    taught = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k, _, _ in rows)
    assert set(read) == {(taught // 1500, taught)} and taught // 1500 > 1
    told = {r.doc_id: r.predicted for r in toxicity.score(docs, model).where("held_out").collect()}
    assert sum(told[k] == y for k, _, y in rows if k in told) >= 0.98 * len(told) > 500


def test_words_are_hashed_together(corpus, model, monkeypatch):
    """Buckets of many words at once are those of each word by itself, and scoring and counting hash no word by itself."""
    rng = random.Random(6)
    words = ["", "a", "ß", "ab", "äö", "日本語", "𝒜𝒷", "x" * 31, "y" * 32, "é" * 17, "𝒜" * 8, "𝒜" * 9, "long" * 5000, *("".join(rng.choice("abñé日𝒜0") for _ in range(rng.randrange(1, 40))) for _ in range(3000))]
    want = np.array([toxicity.parts_of(w) for w in words])
    assert (toxicity.buckets_of(pa.array(words)) == want).all()
    assert (toxicity.buckets_of(pa.array(["before", *words, "after"])[1:-1]) == want).all()
    assert toxicity.buckets_of(pa.array([], pa.string())).shape == (0, toxicity.PARTS) and (toxicity.buckets_of(pa.array(["", ""])) == -1).all()
    texts = [None, "", *(t for _, t, _ in corpus[:50])]
    plain = [naive(model, t) for t in texts]
    starts, found, places = toxicity.words_of(pa.array(texts))
    docs, listed = np.arange(0, len(texts), 2), found.to_pylist()
    counted = np.zeros(toxicity.BUCKETS, np.int64)
    for k in docs:
        for bucket in {b for p in places[starts[k] : starts[k + 1]] for b in toxicity.parts_of(listed[p]) if b >= 0}:
            counted[bucket] += 1

    def alone(word):
        raise AssertionError("hashed by itself: " + word)

    monkeypatch.setattr(toxicity, "parts_of", alone)
    monkeypatch.setattr(toxicity, "CACHE", 7)
    assert np.allclose(model.scorer()(pa.array(texts)), plain, atol=1e-4)
    seen = np.zeros(toxicity.BUCKETS, np.int64)
    toxicity._counted(starts, places, toxicity.buckets_of(found), docs, seen)
    assert (seen == counted).all()
