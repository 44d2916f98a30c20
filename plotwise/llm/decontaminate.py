"""Operator 6: benchmark decontamination by CGK embedding and bit-sampling LSH.

A text holds an item if some stretch of its words is within ``SHARE`` of the item's words in edit distance (words are
runs of letters, digits and underscores, lower-cased).  Items are cut into pieces of at most ``PIECE`` words; in any
stretch that holds the item one piece at least is within ``SHARE`` of its own words.  A random walk over the words (CGK)
turns edit distance into Hamming distance: at each step the word is written down and a random bit, drawn for that step and
word, says whether to go on to the next.  Repeated bit sampling makes tables of it: for each of ``WALKS`` walks, and each
of ``TABLES`` samples of ``SAMPLED`` steps, a piece is filed under the words that its walk wrote at those steps.  Walks
over windows of a text, of the size of a piece, are looked up in the tables; what is found there is verified by the exact
edit distance of the whole item to the text around it.

A walk of n steps stays within n words, and does not depend on where the window ends, so that one walk from a place
serves windows of all sizes.  Places are pruned before walking, without loss: so few edits leave a run of ``run`` words of
every piece whole (pigeonhole), so only places that such a run points to, give or take the edits, are walked from.  What a
run points to is a place in a piece of some size, never an item, however many items share it.

Walks and tables are as many as the target recall asks for; ``tests/llm/recall.py`` measures it by kind of edit.  Items go
to the executors in portions of bounded size, each a pass of its own whose hits are saved.

Defined cases: null and empty texts hold nothing; items that are null or have no words match nothing; an item that
occurs several times, or in repeated rows, counts once a document; repeated documents each get their row; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import cut, portions, table

SHARE, WALKS, TABLES, SAMPLED, PIECE = 0.2, 12, 6, 3, 64
PORTION, PORTION_CHARS, WINDOWS = 20_000, 16_000_000, 8_192
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _TURN
    return x ^ (x >> np.uint64(29))


def edits_to_stretch(item: list[int], text: list[int], most: int) -> int:
    """Least edit distance of the item to any stretch of the text; over ``most``, ``most`` + 1.

    Bit-parallel: the differences down a column of the distance table are two numbers of as many bits as the item has
    words, and a word of the text costs a few operations on them.
    """
    size = len(item)
    where: dict[int, int] = defaultdict(int)
    for k, symbol in enumerate(item):
        where[symbol] |= 1 << k
    full, top = (1 << size) - 1, 1 << size - 1
    up, down, score, best = full, 0, size, size
    for symbol in text:
        equal = where.get(symbol, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        score += bool(right & top) - bool(left & top)
        best = min(best, score)
        right, left = right << 1 & full, left << 1 & full
        up, down = left | ~(diagonal | right) & full, right & diagonal
    return min(best, most + 1)


class Index:
    """The items' words, their pieces, the runs that prune, and the tables of the pieces' walks."""

    def __init__(self, items: list[tuple[int, str | None]], share: float = SHARE, walks: int = WALKS, tables: int = TABLES, seed: int = 7):
        rng = np.random.default_rng(seed)
        ids: dict[tuple[str, ...], set[int]] = defaultdict(set)  # equal items are one
        for item, text in items:
            if words := words_of(text):
                ids[tuple(words)].add(item)
        self.ids = [sorted(x) for x in ids.values()]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for words in ids for w in words), 2)}  # 0: no word, 1: no item's word
        self.items = [[self.vocabulary[w] for w in words] for words in ids]
        self.edits = [math.floor(len(x) * share + 1e-9) for x in self.items]
        pieces: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)  # words: (item, offset) of each place
        for k, item in enumerate(self.items):
            n = math.ceil(len(item) / PIECE)
            bounds = [len(item) * i // n for i in range(n + 1)]
            for a, b in zip(bounds, bounds[1:]):
                pieces[tuple(item[a:b])].append((k, a))
        self.owners = list(pieces.values())
        by_size: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
        for number, words in enumerate(pieces):
            by_size[len(words)].append((number, words))
        self.span = max(by_size, default=0)
        self.seeds = rng.integers(1, 1 << 63, walks, np.uint64)
        self.runs: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.shift = {size: math.floor(size * share + 1e-9) for size in by_size}
        pointed: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for size, entries in sorted(by_size.items()):
            symbols = np.array([words for _, words in entries], np.uint64)
            numbers = np.array([number for number, _ in entries])
            edits = self.shift[size]
            run = max(1, min(4, math.ceil((size - edits) / (edits + 1))))
            for at in range(size - run + 1):
                for key in set(self._keys(symbols[:, at : at + run].T.copy()).tolist()):
                    pointed[run][key].add((size, at))
            steps = np.sort(np.array([rng.choice(size, SAMPLED, replace=size < SAMPLED) for _ in range(walks * tables)]).reshape(walks, tables, SAMPLED), axis=2)
            filed = []
            for walk in range(walks):
                written = self.walk(symbols, walk, size)
                for sample in steps[walk]:
                    key = self._keys(written[:, sample].T)
                    order = np.argsort(key, kind="stable")
                    filed.append((sample, key[order], numbers[order]))
            self.tables[size] = filed
        for run, keys in pointed.items():
            order = sorted(keys)
            self.runs[run] = np.array(order, np.uint64), [np.array(sorted(keys[k]), np.int64) for k in order]

    @staticmethod
    def _keys(rows: np.ndarray) -> np.ndarray:
        """A name for each column of symbols."""
        key = np.zeros(rows.shape[1], np.uint64)
        for symbols in rows:
            key = (key ^ symbols.astype(np.uint64)) * _MIX
            key ^= key >> np.uint64(29)
        return key

    def walk(self, windows: np.ndarray, number: int, steps: int) -> np.ndarray:
        """The embeddings: at each step the symbol under way; the bit is a hash of walk, step and symbol."""
        rows, at = np.arange(len(windows)), np.zeros(len(windows), np.int64)
        out = np.empty((len(windows), steps), np.uint64)
        for step in range(steps):
            symbol = windows[rows, at]
            out[:, step] = symbol
            at += (_stirred(symbol * _MIX + self.seeds[number : number + 1] + np.array([step], np.uint64) * _TURN) & np.uint64(1)).astype(np.int64)
        return out

    def places(self, symbols: np.ndarray) -> dict[int, np.ndarray]:
        """For each size of pieces the starts of the windows that are worth a walk."""
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for run, (keys, pointed) in self.runs.items():
            n = len(symbols) - run + 1
            if n <= 0:
                continue
            own = self._keys(np.stack([symbols[k : k + n] for k in range(run)]))
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            for place in np.flatnonzero(keys[at] == own).tolist():
                for size, offset in pointed[at[place]].tolist():
                    found[size].append(np.arange(place - offset - self.shift[size], place - offset + self.shift[size] + 1))
        return {size: np.unique(np.concatenate(starts)) for size, starts in found.items()}

    def candidates(self, symbols: np.ndarray) -> dict[int, list[np.ndarray]]:
        """For each piece the starts of the windows that share a table's entry with it, some thousand windows at a time.

        The pieces of an entry share the array of its windows; no pair of a piece and a window is made.
        """
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        padded = np.concatenate([np.zeros(self.span, np.uint64), symbols, np.zeros(2 * self.span, np.uint64)])  # 0 stands in no piece
        for size, starts in self.places(symbols).items():
            starts = starts[(starts > -size) & (starts < len(symbols))]
            tables = self.tables[size]
            for at in range(0, len(starts), WINDOWS):
                part = starts[at : at + WINDOWS]
                windows = padded[(part + self.span)[:, None] + np.arange(size)]
                for number, (sample, keys, numbers) in enumerate(tables):
                    walk, sampled = divmod(number, len(tables) // len(self.seeds))
                    if not sampled:
                        written = self.walk(windows, walk, size)
                    own = self._keys(written[:, sample].T)
                    low = np.searchsorted(keys, own)
                    hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == own)
                    hit = hit[np.argsort(low[hit], kind="stable")]
                    for same in np.split(hit, np.flatnonzero(np.diff(low[hit])) + 1) if len(hit) else ():
                        entry = low[same[0]]
                        for piece in numbers[entry : np.searchsorted(keys, keys[entry], "right")].tolist():
                            found[piece].append(part[same])
        return found

    def holds(self, text: str | None) -> list[int]:
        """The items that the text holds."""
        known = self.vocabulary.get
        symbols = np.array([known(w, 1) for w in words_of(text)], np.uint64)
        if not len(symbols) or not self.items:
            return []
        around: dict[int, list[np.ndarray]] = defaultdict(list)
        for piece, starts in self.candidates(symbols).items():
            for item, offset in self.owners[piece]:
                around[item] += [s - offset for s in starts]
        there, out = set(symbols.tolist()), set()
        for item, starts in around.items():
            words, most = self.items[item], self.edits[item]
            if sum(w in there for w in words) < len(words) - most:  # each word that is not in the text is an edit
                continue
            low = np.unique(np.concatenate(starts)) - 2 * most
            high = low + len(words) + 4 * most
            breaks = np.flatnonzero(low[1:] > high[:-1]) + 1  # overlapping stretches are read once
            for a, b in zip(low[np.concatenate(([0], breaks))].tolist(), high[np.concatenate((breaks - 1, [-1]))].tolist()):
                if edits_to_stretch(words, symbols[max(a, 0) : max(b, 0)].tolist(), most) <= most:
                    out.update(self.ids[item])
                    break
        return sorted(out)


def _portions(benchmark: DataFrame) -> list[list[tuple[int, str | None]]]:
    """The items in portions of bounded size, each fetched on its own."""
    items = benchmark.where("text is not null and item_id is not null").select("item_id", "text")
    n, chars = items.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    parts = max(1, math.ceil(n / PORTION * 1.5), math.ceil((chars or 0) / PORTION_CHARS * 1.5))
    return [[(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()] for k in range(parts)]


_INDEX: dict[str, Index] = {}


def _found(docs: DataFrame, items: list[tuple[int, str | None]], text: str, name: str) -> DataFrame:
    """``docs`` with the array ``name`` of the items of a portion that the text column holds."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # a portion: bounded
    number = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _INDEX:  # one index a worker, for the portion at hand
            _INDEX.clear()
            _INDEX[number] = Index(shared.value)
        index = _INDEX[number]
        for batch in batches:
            for part in portions(batch, text, 256, 1 << 22):
                held = [index.holds(t) for t in part.column(text).to_pylist()]
                yield part.append_column(name, pa.array(held, pa.list_(pa.int64())))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(LongType()))]))


def matches(docs: DataFrame, benchmark: DataFrame, name: str = "items") -> DataFrame:
    """``docs`` with the column ``name``, array of the item ids that the text holds, in order.

    One portion is a pass over the documents without a shuffle.  Of several, each is a pass whose hits, by a digest of the
    text, are saved; together they are joined to the documents, so that no task holds more than one portion.
    """
    parts = _portions(benchmark)
    if len(parts) == 1:
        return _found(docs, parts[0], "text", name)
    hits = [cut(_found(docs.select("text"), items, "text", "_held").where(F.size("_held") > 0).select(F.sha2("text", 256).alias("_digest"), "_held").distinct()) for items in parts]
    held = reduce(DataFrame.union, hits).groupBy("_digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_held")))).alias(name))
    out = docs.withColumn("_digest", F.sha2("text", 256)).join(held, "_digest", "left").drop("_digest")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast("array<bigint>")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), "items", (F.size("items") > 0).alias("contaminated"))
