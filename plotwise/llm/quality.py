"""Operator 2: a quality classifier, as a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins.  Shallow trees over the bins of one feature are boosted in a cycle over all
features, so that their sum is one lookup table per feature; then the pairs of features that explain most of what is
left get two-dimensional tables in the same way.  A score is the logistic of an intercept plus one table entry per
feature and pair, added for a block of documents at a time.

The model is fitted on the driver, on at most ``SAMPLE`` labelled documents, picked by a hash of the document id;
scoring covers every whole text.  Labels, language, source and id are never inputs of a score.

Defined cases: a null text counts as empty and is scored like any other; documents with several labels take their
mean, ties as 1; without labels, or with labels of one kind, every score is the smoothed share of label 1; repeated
rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE, FOLDS, THRESHOLD = 20_000, 5, 0.3
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 48, 8, 10, 120, 60, 0.15, 4.0
FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "longest_word", "upper", "digit", "blank", "non_ascii", "stops",
    "commas", "marks", "bars", "quotes", "other_signs", "distinct_words", "top_word", "same_as_before", "shouted_words", "short_words",
    "lines", "line_length", "repeated_lines", "deflated", "signs_per_word", "brackets", "slashes", "top_character", "bigram_repeats", "digits_in_words",
)


def features(text: str | None) -> list[float]:
    text = text or ""
    data = text.encode("utf-8", "replace")
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    count = lambda signs: float(by[list(signs.encode())].sum())
    size, words, lines = max(len(data), 1), text.split(), text.split("\n")
    n, distinct = max(len(words), 1), Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    before = sum(map(str.__eq__, words[1:], words))
    pairs = len(set(zip(words[1:], words)))
    upper, digit = float(by[65:91].sum()), float(by[48:58].sum())
    signs = float(by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum())
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        upper / size, digit / size, count(" \n\t\r") / size, float(by[128:].sum()) / size, count(".") / n,
        count(",") / n, count("!?") / n, count("|") / n, count("\"'") / n, count("#$%&*+=@^_~") / n,
        len(distinct) / n, max(distinct.values(), default=0) / n, before / n, sum(map(str.isupper, words)) / n, float((lengths <= 2).sum()) / n,
        np.log1p(len(lines)), np.log1p(len(text) / len(lines)), 1 - len(set(lines)) / len(lines), len(zlib.compress(data, 1)) / (size + 16), signs / n,
        count("()[]{}<>") / n, count("/\\") / n, float(by.max()) / size, 1 - pairs / max(len(words) - 1, 1), digit / n,
    ]


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (cut, lookup) in enumerate(zip(self.cuts, self.tables)):
            total += lookup[np.searchsorted(cut, x[:, k], side="right")]
        for a, b, cut_a, cut_b, lookup in self.pairs:
            total += lookup[np.searchsorted(cut_a, x[:, a], side="right"), np.searchsorted(cut_b, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + SMOOTH)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0: none."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(gain.argmax())
    return float(gain[at]), at + 1 if gain[at] > 1e-9 else 0


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values, by bin, of a tree of depth two."""
    out = np.empty(len(g))
    _, middle = _best_cut(g, h)
    for start, end in ((0, middle), (middle, len(g))):
        if start < end:
            _, at = _best_cut(g[start:end], h[start:end])
            for x, y in ((start, start + at), (start + at, end)):
                if x < y:
                    out[x:y] = -g[x:y].sum() / (h[x:y].sum() + SMOOTH)
    return out


def _square_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts one axis and then, on each side, the other."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for middle in range(1, len(a)):
            gain, leaf = -_gain(g.sum(), h.sum()), np.zeros_like(a)
            for rows in (slice(0, middle), slice(middle, None)):
                row_g, row_h = a[rows].sum(0), b[rows].sum(0)
                _, at = _best_cut(row_g, row_h)
                for part in (slice(0, at), slice(at, None)):
                    gain += _gain(row_g[part].sum(), row_h[part].sum())
                    leaf[rows, part] = -row_g[part].sum() / (row_h[part].sum() + SMOOTH)
            if gain > best:
                best, out = gain, leaf.T if turned else leaf
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(intercept=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    model.cuts = [_quantile_cuts(x[:, k], BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(cut) + 1) for cut in model.cuts]
    bins = [np.searchsorted(cut, x[:, k], side="right") for k, cut in enumerate(model.cuts)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k, lookup in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _shallow_tree(np.bincount(bins[k], g, len(lookup)), np.bincount(bins[k], h, len(lookup)))
            lookup += step
            total += step[bins[k]]
    coarse = [_quantile_cuts(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    wide = [np.searchsorted(cut, x[:, k], side="right") for k, cut in enumerate(coarse)]
    sums = lambda a, b, v: np.bincount(wide[a] * (len(coarse[b]) + 1) + wide[b], v, (len(coarse[a]) + 1) * (len(coarse[b]) + 1)).reshape(len(coarse[a]) + 1, -1)
    g, h = slopes()
    gains = [(_square_tree(sums(a, b, g), sums(a, b, h))[0], a, b) for a in range(len(coarse)) for b in range(a)]
    chosen = sorted(gains, reverse=True)[:PAIRS]
    model.pairs = [(a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in chosen]
    for _ in range(PAIR_ROUNDS):
        for a, b, _, _, lookup in model.pairs:
            g, h = slopes()
            step = RATE * _square_tree(sums(a, b, g), sums(a, b, h))[1]
            lookup += step
            total += step[wide[a], wide[b]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """Fit on at most ``sample`` labelled documents outside the held-out fold."""
    picked = (
        labels.where("doc_id is not null and quality is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")  # at most ``sample`` rows of two numbers
        .mapInArrow(_feature_rows, "doc_id long, label int, x array<double>")
        .groupBy("doc_id")
        .agg(F.min(F.struct("label", "x")).alias("row"))
        .select("row.label", "row.x")
        .toPandas()
    )
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["label"].to_numpy(dtype=float))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), x], ["doc_id", "label", "x"])


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.array([features(t) for t in part.column("text").to_pylist()], dtype=float).reshape(part.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.array([features(t) for t in part.column("text").to_pylist()], dtype=float).reshape(part.num_rows, len(FEATURES))
                yield part.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
