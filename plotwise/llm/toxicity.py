"""Operator 12: toxicity, by a convolutional text classifier in numpy.

A word's embedding is the sum of hashed embeddings of the word, its beginnings and its endings, so that forms never
seen share what is known of their parts.  Filters over one, two and three words in a row are taken at every place of the
text, and the largest value of each filter enters a logistic output.  Training goes back through the places of these
largest values only.  A part of the labelled documents is kept from training; on it a threshold is chosen for each language, and
the score is shifted so that the threshold of the text's language stands at one half.  The language is guessed from
function words in the text itself; texts of no known language, or of one with few labelled documents, get the threshold
of all.

The model is fitted on every labelled document outside the held-out fold, in rounds: trainers, one a partition, take the same model
through their documents, batch by batch, and Spark averages the changes of each parameter over the trainers that changed
it.  Parts of words are counted over all of these documents, and thresholds go by the counts of all kept-back documents on a
fine grid of logits.  The driver holds the model, whose size is bounded by ``BUCKETS``.  Scoring covers every place of every
whole text, a stretch of words at a time.
Labels, language, source and id are never inputs of a score.

Defined cases: a null text counts as empty, and an empty one, or one without letters and digits, has one empty word;
documents with several labels take their mean, ties as 1; without labels, or with labels of one kind, every score is the
smoothed share of label 1; repeated rows each get their row; rows without an id are scored, never learnt from, and have a null held_out; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, portions, table

FOLDS, THRESHOLD = 5, 0.5
BUCKETS, LEAST_DOCS = 1 << 20, 4  # parts of words in fewer documents have no embedding
BEGINNINGS, ENDINGS = range(2, 9), range(2, 5)
PARTS = 1 + len(BEGINNINGS) + len(ENDINGS)
SIZE, WIDTHS, FILTERS = 8, (1, 2, 3), 8
EPOCHS, MOST_EPOCHS, VISITS, BATCH, RATE, DECAY = 2, 24, 60_000, 48, 0.04, 1e-4  # few documents are gone through more often
TRAINER, TRAINERS = 10_000, 64  # documents that are worth a trainer, and most trainers
GRID, SLOTS = 256, 1 << 24  # steps of a logit for thresholds; slots of ids
DROPPED = 0.4  # of a batch's words: what one word tells must not keep others from being learnt
KEPT_BACK = 5  # one document in so many is for the thresholds
CALIBRATED = 20  # documents of each label that a language's own threshold takes
STRETCH = 1 << 16  # places filtered at a time
CACHE = 1 << 13  # words hashed at a time: what a step works on stays in the processor's cache
LONGEST = 32  # bytes of the names that are hashed together; a beginning or an ending has no more
# Fixed word lists: frequent function words that tell a language from the others here.
FUNCTION_WORDS = {
    "en": "the of and to is that for with was this are".split(),
    "de": "der die und das nicht ist von mit sich ein den".split(),
    "fr": "le les des et est dans pour une sur par du".split(),
    "es": "el los las que y por con del una se no".split(),
}
LANGUAGES = list(FUNCTION_WORDS)
_LANGUAGE_OF = {w: k for k, words in enumerate(FUNCTION_WORDS.values()) for w in words}
_TOLD_BY = pa.array(list(_LANGUAGE_OF))
_LANGUAGE_AT = np.array([*_LANGUAGE_OF.values(), -1])


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(starts, words, places): where each text's words start, the distinct words, and which of them stands at each place."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(low, r"[^\pL\pN]+", " "))
    split = pc.split_pattern(plain, " ")
    coded = pc.dictionary_encode(split.flatten())
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())]).astype(np.int64)
    return starts, coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64)


def parts_of(word: str) -> list[int]:
    """Buckets of a word, its beginnings and its endings; -1 where it is too short."""
    n = len(word)
    names = ["=" + word, *("<" + word[:k] if k <= n else "" for k in BEGINNINGS), *(">" + word[-k:] if k <= n else "" for k in ENDINGS)]
    return [zlib.crc32(name.encode()) % BUCKETS if name and n else -1 for name in names]


def _crc_table() -> np.ndarray:
    """What a byte makes of a CRC-32, as in zlib."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ (table & 1) * np.uint32(0xEDB88320)
    return table


_CRC_TABLE = _crc_table()


def _crcs(data: np.ndarray, mark: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of a mark and the bytes from each start to its end, a byte of all of them at a time."""
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    at, left = starts[order], (ends - starts)[order]
    crc = np.full(len(at), zlib.crc32(mark.encode()) ^ 0xFFFFFFFF, np.uint32)
    for step in range(left[0] if len(left) else 0):
        going = np.searchsorted(-left, -step)
        now = crc[:going]
        crc[:going] = _CRC_TABLE[(now ^ data[at[:going] + step]) & 255] ^ (now >> 8)
    found = np.empty(len(at), np.int64)
    found[order] = crc ^ np.uint32(0xFFFFFFFF)
    return found


def buckets_of(words: pa.Array) -> np.ndarray:
    """``parts_of`` of each word, for many words at once."""
    return np.concatenate([np.zeros((0, PARTS), np.int32), *(_buckets_of(words[k : k + CACHE]) for k in range(0, len(words), CACHE))])


def _buckets_of(words: pa.Array) -> np.ndarray:
    _, offsets, content = words.buffers()
    edges = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8)[edges[0] : edges[-1]] if content else np.zeros(0, np.uint8)
    starts, ends = edges[:-1] - edges[0], edges[1:] - edges[0]
    points = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))  # where code points start
    first, last = np.searchsorted(points, starts), np.searchsorted(points, ends)
    found = np.full((len(words), PARTS), -1, np.int32)
    short = np.flatnonzero((ends > starts) & (ends - starts <= LONGEST))
    found[short, 0] = _crcs(data, "=", starts[short], ends[short]) % BUCKETS
    for k in np.flatnonzero(ends - starts > LONGEST):
        found[k, 0] = zlib.crc32(b"=" + data[starts[k] : ends[k]].tobytes()) % BUCKETS
    for column, k in enumerate((*BEGINNINGS, *ENDINGS), 1):
        own = np.flatnonzero(last - first >= k)
        if column <= len(BEGINNINGS):
            crc = _crcs(data, "<", starts[own], points[first[own] + k])
        else:
            crc = _crcs(data, ">", points[last[own] - k], ends[own])
        found[own, column] = crc % BUCKETS
    return found


def languages_of(starts: np.ndarray, words: pa.Array, places: np.ndarray) -> np.ndarray:
    """The language of each text by its function words; the number of languages if none is ahead."""
    of_word = _LANGUAGE_AT[pc.fill_null(pc.index_in(words, _TOLD_BY), -1).to_numpy()][places]
    told = np.flatnonzero(of_word >= 0)
    text = np.searchsorted(starts, told, side="right") - 1
    counts = np.bincount(text * len(LANGUAGES) + of_word[told], minlength=(len(starts) - 1) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
    best = counts.argmax(1)
    ahead = counts.max(1) > np.sort(counts, axis=1)[:, -2]
    return np.where(ahead, best, len(LANGUAGES))


@dataclass
class Convolution:
    """Embeddings of the kept buckets (the last row is zero), filters, biases and the output."""

    rows: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.int32))
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((1, SIZE), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)  # of each width: (width, SIZE, FILTERS)
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    intercept: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))

    def parts(self, words: pa.Array) -> np.ndarray:
        """Rows of the embeddings of each word's parts."""
        buckets = buckets_of(words)
        return np.where(buckets < 0, len(self.embedding) - 1, self.rows[buckets])

    def vectors(self, parts: np.ndarray) -> np.ndarray:
        return self.embedding.take(parts, axis=0).sum(1)

    def pieces(self, vectors: np.ndarray) -> list[list[np.ndarray]]:
        """Of each width and place in the filter: what each word adds; the last row stands for no word."""
        vectors = np.concatenate([vectors, np.zeros((1, SIZE), np.float32)])
        return [[vectors @ f[k] for k in range(width)] for width, f in zip(WIDTHS, self.filters)]

    def pooled(self, pieces: list[list[np.ndarray]], starts: np.ndarray, places: np.ndarray, argmax: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest value of each filter in each text, and where it is taken; filters reach past a text's end into nothing."""
        texts = len(starts) - 1
        best = np.full((texts, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        where = np.zeros(best.shape, np.int64) if argmax else None
        for a in range(0, len(places), STRETCH):
            b = min(a + STRETCH, len(places))
            first, last = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, b, side="left")
            edges = np.maximum(starts[first:last], a) - a
            at, ends = np.arange(a, b), np.repeat(starts[first + 1 : last + 1], np.diff(np.append(edges, b - a)))
            after = [places[a:b], *(np.where(at + step < ends, places[np.minimum(at + step, len(places) - 1)], -1) for step in range(1, max(WIDTHS)))]
            for k, width in enumerate(WIDTHS):
                value = pieces[k][0].take(after[0], axis=0)
                for step in range(1, width):
                    value += pieces[k][step].take(after[step], axis=0)
                cut = slice(k * FILTERS, (k + 1) * FILTERS)
                most = np.maximum.reduceat(value, edges, axis=0)
                if argmax:
                    for row, (x, y) in enumerate(zip(edges, np.append(edges[1:], b - a))):
                        top = value[x:y].argmax(0)
                        where[first + row, cut] = np.where(most[row] > best[first + row, cut], top + x + a, where[first + row, cut])
                best[first:last, cut] = np.maximum(best[first:last, cut], most)
        return best, where

    def logits(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best + self.bias, 0) @ self.out + self.intercept

    def raw(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logits without thresholds, and languages."""
        starts, words, places = words_of(texts)
        best, _ = self.pooled(self.pieces(self.vectors(self.parts(words))), starts, places)
        return self.logits(best), languages_of(starts, words, places)

    def scorer(self):
        """A function from texts to scores."""

        def score(texts: pa.Array) -> np.ndarray:
            if not self.filters:
                return np.full(len(texts), 1 / (1 + np.exp(-self.intercept)))
            logits, language = self.raw(texts)
            return 1 / (1 + np.exp(-np.clip(logits - self.thresholds[language], -30, 30)))

        return score


def _threshold(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the least weight of wrong answers."""
    order = np.argsort(logits)
    logits, y, weight = logits[order], y[order], weight[order]
    between = np.concatenate([[True], np.diff(logits) > 0, [True]])
    wrong = np.concatenate([[0], np.cumsum(np.where(y == 1, weight, 0))]) + np.concatenate([np.cumsum(np.where(y == 0, weight, 0)[::-1])[::-1], [0]])
    wrong = np.where(between, wrong, np.inf)
    ends = np.concatenate([[logits[0] - 2], logits, [logits[-1] + 2]])
    cuts = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    at = cuts[np.argmax(ends[cuts + 1] - ends[cuts])]
    return float((ends[at] + ends[at + 1]) / 2)


class Trainer:
    """Takes a model through documents; ``one_in``: the weight of a document of each label."""

    def __init__(self, model: Convolution, one_in: np.ndarray, rng: np.random.Generator):
        self.model, self.one_in, self.rng = model, one_in, rng
        self.of_rows = np.full(len(model.embedding), 1e-3, np.float32)
        self.squares = [np.full(p.shape, 1e-3, np.float32) for p in self._dense()]
        self.of_intercept = 1e-3

    def _dense(self) -> list[np.ndarray]:
        return [*self.model.filters, self.model.bias, self.model.out]

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """What training changes: a row for each embedding, and all other numbers."""
        other = [p.reshape(-1) for p in (*self._dense(), *self.squares)]
        return np.column_stack([self.model.embedding, self.of_rows]), np.concatenate([*other, [self.model.intercept, self.of_intercept]])

    def restore(self, rows: np.ndarray, other: np.ndarray) -> None:
        self.model.embedding, self.of_rows = np.ascontiguousarray(rows[:, :SIZE], np.float32), np.ascontiguousarray(rows[:, SIZE], np.float32)
        at = 0
        for p in (*self._dense(), *self.squares):
            p[...] = other[at : at + p.size].reshape(p.shape)
            at += p.size
        self.model.intercept, self.of_intercept = map(float, other[at:])

    def learn(self, starts: np.ndarray, places: np.ndarray, parts: np.ndarray, y: np.ndarray, order: np.ndarray, rate: float) -> None:
        """Documents in an order, a batch at a time; ``parts`` has the rows of the embeddings of each word's parts."""
        model, rng, dense = self.model, self.rng, self._dense()
        for chosen in (order[k : k + BATCH] for k in range(0, len(order), BATCH)):
            place = np.concatenate([places[starts[k] : starts[k + 1]] for k in chosen])
            own, place = np.unique(place, return_inverse=True)
            start = np.concatenate([[0], np.cumsum(starts[chosen + 1] - starts[chosen])])
            vectors = model.vectors(parts[own])
            vectors[rng.random(len(own)) < DROPPED] = 0
            best, where = model.pooled(model.pieces(vectors), start, place, argmax=True)
            hidden = np.maximum(best + model.bias, 0)
            slope = ((1 / (1 + np.exp(-model.logits(best))) - y[chosen]) * self.one_in[y[chosen].astype(int)] / len(chosen)).astype(np.float32)
            back_hidden = slope[:, None] * model.out * (hidden > 0)
            grads, to_words = [np.zeros_like(f) for f in model.filters], np.zeros_like(vectors)
            for k, width in enumerate(WIDTHS):
                g = back_hidden[:, k * FILTERS : (k + 1) * FILTERS]
                for step in range(width):
                    at = where[:, k * FILTERS : (k + 1) * FILTERS] + step
                    inside = at < start[1:, None]
                    word = place[np.where(inside, at, 0)]
                    flow = np.where(inside, g, 0)
                    grads[k][step] = np.einsum("dfs,df->sf", vectors[word], flow)
                    np.add.at(to_words, word, flow[:, :, None] * model.filters[k][step].T)
            grads += [back_hidden.sum(0), (slope[:, None] * hidden).sum(0)]
            for p, g, s in zip(dense, grads, self.squares):
                g = g + DECAY * p
                s += g * g
                p -= rate * g / np.sqrt(s)
            self.of_intercept += float(slope.sum()) ** 2
            model.intercept -= rate * float(slope.sum()) / self.of_intercept**0.5
            moved = np.flatnonzero(np.abs(to_words).sum(1) * np.abs(vectors).sum(1))
            rows, to_rows = np.unique(parts[own[moved]], return_inverse=True)
            g = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(g, to_rows.reshape(-1), np.repeat(to_words[moved], PARTS, axis=0))
            g += DECAY * model.embedding[rows]
            self.of_rows[rows] += (g * g).mean(1)
            model.embedding[rows] -= rate * g / np.sqrt(self.of_rows[rows])[:, None]
            model.embedding[-1] = 0


def _counted(starts: np.ndarray, places: np.ndarray, buckets: np.ndarray, docs: np.ndarray, seen: np.ndarray) -> None:
    """Adds to ``seen`` in how many of the documents each bucket is."""
    last = np.zeros(len(seen), np.int32)  # the entry of a document's list that was the last to name the bucket
    for k in docs:
        held = buckets[np.unique(places[starts[k] : starts[k + 1]])].reshape(-1)
        held = held[held >= 0]
        entry = np.arange(len(held), dtype=np.int32)
        last[held] = entry
        seen[held[last[held] == entry]] += 1


def _begun(kept: np.ndarray, rng: np.random.Generator) -> Convolution:
    """A model before training, with embeddings for the kept buckets."""
    model = Convolution(rows=np.full(BUCKETS, len(kept), np.int32))
    model.rows[kept] = np.arange(len(kept))
    model.embedding = np.concatenate([rng.standard_normal((len(kept), SIZE), np.float32) * np.float32(0.1), np.zeros((1, SIZE), np.float32)])
    model.filters = [rng.normal(0, 0.5, (width, SIZE, FILTERS)).astype(np.float32) for width in WIDTHS]
    model.out = rng.normal(0, 0.3, len(model.out)).astype(np.float32)
    return model


def _weights(counts: np.ndarray) -> np.ndarray:
    return 0.5 / np.maximum(counts / max(counts.sum(), 1), 1e-9)


def _rounds(n: int) -> int:
    return max(EPOCHS, min(MOST_EPOCHS, VISITS // max(n, 1)))


def _calibrated(model: Convolution, logits: np.ndarray, language: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Convolution:
    """Sets the thresholds; ``weight``: how many documents each entry stands for."""
    if len(y) and y.min() != y.max():
        model.thresholds[:] = _threshold(logits, y, weight)
        for k in range(len(LANGUAGES)):
            here = language == k
            if min((weight * y)[here].sum(), (weight * (1 - y))[here].sum()) >= CALIBRATED:
                model.thresholds[k] = _threshold(logits[here], y[here], weight[here])
    return model


def fit(texts: list[str], y: np.ndarray, seed: int = 3) -> Convolution:
    """Train on a few texts and their labels in this process, by one trainer."""
    total = np.bincount(y.astype(int), minlength=2)[:2]
    if not len(y) or y.min() == y.max():
        return Convolution(intercept=float(np.log((total[1] + 1) / (total[0] + 1))))
    rng = np.random.default_rng(seed)
    starts, words, places = words_of(pa.array(texts, pa.string()))
    buckets = buckets_of(words)
    back = np.arange(len(y)) % KEPT_BACK == KEPT_BACK - 1
    seen = np.zeros(BUCKETS, np.int32)
    _counted(starts, places, buckets, np.flatnonzero(~back), seen)
    model = _begun(np.flatnonzero(seen >= LEAST_DOCS), rng)
    trainer, rounds = Trainer(model, _weights(np.bincount(y[~back].astype(int), minlength=2)[:2]), rng), _rounds(len(y))
    for k in range(rounds):
        trainer.learn(starts, places, model.parts(words), y, rng.permutation(np.flatnonzero(~back)), RATE * (1 - k / rounds))
    logits, language = model.raw(pa.array([t for t, b in zip(texts, back) if b], pa.string()))
    return _calibrated(model, logits, language, y[back], np.ones(back.sum()))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _examples(docs: DataFrame, known: DataFrame, trainers: int) -> DataFrame:
    """(label, back, text) of all labelled documents, one partition a trainer, in an order that only their ids decide.

    A bit a slot of ids, of a fixed number of slots, tells which texts need not be dealt out; the join decides.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    maps = known.select((slot + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in maps.collect():  # at most a bit a slot
        bits[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    wanted = docs.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def labelled(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy()
        return pa.array((wanted.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null").where(labelled(slot))
    both = texts.repartition(trainers, "doc_id").join(known.repartition(trainers, "doc_id").hint("merge"), "doc_id")
    one = both.groupBy("doc_id", "label").agg(F.min("text").alias("text")).coalesce(trainers)
    back = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(KEPT_BACK)) == 0
    return cut(one.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("label", back.alias("back"), "text"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(starts, words, places, labels, kept back) of some documents at a time, however the batches are cut."""
    held, size = [], 0
    for batch in batches:
        for part in portions(batch, rows=BATCH, size=1 << 21):
            held.append(part)
            size += part.nbytes
            if size >= 1 << 22:
                yield _piece(held)
                held, size = [], 0
    if held:
        yield _piece(held)


def _piece(parts: list[pa.RecordBatch]) -> tuple:
    rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    return (*words_of(rows.column("text")), rows.column("label").to_numpy(), rows.column("back").to_numpy(zero_copy_only=False))


def _known_parts(examples: DataFrame) -> np.ndarray:
    """The buckets that enough documents have, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for starts, words, places, y, back in _pieces(batches):
            _counted(starts, places, buckets_of(words), np.flatnonzero(~back), seen)
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[own])], ["bucket", "n"])

    found = examples.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    return np.sort(found.select(F.col("bucket").cast("int")).toArrow()["bucket"].to_numpy())  # at most ``BUCKETS``


def _round(examples: DataFrame, trainer: Trainer, rate: float, seed: tuple[int, ...]) -> None:
    """All trainers go on from the same state; the changes of each number are averaged over those that changed it."""
    rows, other = trainer.state()
    sent = examples.sparkSession.sparkContext.broadcast((trainer.model.rows, rows, other, trainer.one_in))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets_rows, rows, other, one_in = sent.value
        model = Convolution(rows=buckets_rows, filters=[np.zeros((w, SIZE, FILTERS), np.float32) for w in WIDTHS])
        model.embedding = np.zeros((len(rows), SIZE), np.float32)
        own = Trainer(model, one_in, np.random.default_rng((*seed, TaskContext.get().partitionId())))
        own.restore(rows, other)
        for starts, words, places, y, back in _pieces(batches):
            own.learn(starts, places, model.parts(words), y, own.rng.permutation(np.flatnonzero(~back)), rate)
        new_rows, new_other = own.state()
        if (new_other == other).all():
            return
        moved = np.flatnonzero((new_rows != rows).any(1))
        change = new_rows[moved] - rows[moved]
        rest = np.zeros((len(other), SIZE + 1))
        rest[:, 0] = new_other - other
        for names, values in ((moved, change), (-1 - np.arange(len(other)), rest)):
            for at in range(0, len(names), 1 << 14):
                part = values[at : at + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + (1 << 14)], pa.int64()), *(pa.array(c, pa.float32()) for c in np.ascontiguousarray(part.T, np.float32))], ["name", *columns])

    columns = [f"c{k}" for k in range(SIZE + 1)]
    changes = examples.mapInArrow(run, "name long, " + ", ".join(c + " float" for c in columns))
    mean = changes.groupBy(F.col("name").cast("int").alias("name")).agg(*(F.avg(c).cast("float").alias(c) for c in columns)).toArrow()  # as many as the model has
    sent.destroy()
    for part in mean.to_batches():
        names = part.column("name").to_numpy()
        for k, c in enumerate(columns):
            change = part.column(c).to_numpy()
            rows[names[names >= 0], k] += change[names >= 0]
            if not k:
                other[-1 - names[names < 0]] += change[names < 0]
    trainer.restore(rows, other)


def _kept_back(examples: DataFrame, model: Convolution) -> pa.Table:
    """(language, step, label, n): how many kept-back documents have their logit at each step of the grid."""
    sent = examples.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, rows=512, size=1 << 21):
                logits, language = sent.value.raw(part.column("text"))
                steps = np.round(np.clip(logits, -32, 32) * GRID).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(language, pa.int64()), pa.array(steps), part.column("label")], ["language", "step", "label"])

    told = examples.where("back").select("label", "text").mapInArrow(run, "language long, step long, label int")
    return told.groupBy("language", "step", "label").agg(F.count(F.lit(1)).alias("n")).toArrow()  # bounded by the grid


def train(docs: DataFrame, labels: DataFrame, seed: int = 3) -> Convolution:
    """Fit on all labelled documents outside the held-out fold."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    examples = _examples(docs, known, max(1, min(TRAINERS, known.count() // TRAINER)))
    found = {(r.label, r.back): r["count"] for r in examples.groupBy("label", "back").count().collect()}  # four rows
    counts = np.array([[found.get((k, b), 0) for b in (False, True)] for k in (0, 1)])
    total = counts.sum(1)
    if not total.all():
        return Convolution(intercept=float(np.log((total[1] + 1) / (total[0] + 1))))
    model = _begun(_known_parts(examples), np.random.default_rng(seed))
    trainer, rounds = Trainer(model, _weights(counts[:, 0]), np.random.default_rng(seed)), _rounds(int(total.sum()))
    for k in range(rounds):
        _round(examples, trainer, RATE * (1 - k / rounds), (seed, k))
    told = _kept_back(examples, model)
    return _calibrated(model, told["step"].to_numpy() / GRID, told["language"].to_numpy(), told["label"].to_numpy(), told["n"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Convolution) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for batch in batches:
            for part in portions(batch, rows=512, size=1 << 21):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(part.column("text")), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
