"""Operator 11: groups of spelling variants, by a self-join of a vocabulary's trie with active-node sets.

The vocabulary is a trie, partitioned by prefixes: a node with more than ``SUBTREE`` words below is a node of the top,
and below it hang subtrees of at most so many words each, which are dealt out to tasks.  An active node of a node is
one whose path is at most one edit away.  Going down a level, a node without an edit so far passes on its children
(equal letters), pairs of them (a letter replaced), and each child beside itself (a letter more); a pair that has spent
its edit goes on only where both have a child with the same letter.  Where both are ends of words, the pair is emitted.

In a subtree numpy does this for all nodes of a level at once.  A pair that spends its edit at a top node lies in
different subtrees; having one way to go on, it meets where the rest of the two paths is equal, so that Spark brings
both together by one shuffle of the paths without the letter in question, at most a word for each letter of the
alphabet under one key, instead of a round for each level.

Chains of forms are followed by doubling; as counts grow by ``RATIO`` with each step, few rounds are needed.

Defined cases: null and empty texts hold no words; rows of one doc_id each count; a null doc_id stands as an empty text
in the hash; words of any length are taken; without near words ``form`` is null and ``root`` the word itself; an empty
table has no words; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table, written

LETTERS, OCCURRENCES, RATIO, DELETED = 6, 5, 5, 199
SUBTREE = 1000  # words
HELD = 1 << 18  # words that a task counts before it passes them on
STEP = 8  # levels of the top that are counted together
_CODES = 0x110000
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}")  # shorter runs give no word: a deletion only shortens them


def counted_runs(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text, where one run in ``DELETED`` of a document has lost a letter."""
    low = text.encode("utf-8", "replace").lower().decode()  # bytes: only A-Z change
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(low)).items():
        h = zlib.crc32(run.encode(), seed)
        if h % DELETED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LETTERS:
            yield run, n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return rows

    for batch in batches:
        for part in portions(batch, rows=256):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                for word, n in counted_runs(doc_id, text or ""):
                    held[word] += n
            if len(held) >= HELD:
                yield out()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts with their occurrences."""
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counts, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def with_depth(words: DataFrame, limit: int) -> DataFrame:
    """Adds to (word, n) the length ``depth`` of the word's longest prefix with more than ``limit`` words; -1: not even the empty one."""
    if words.count() <= limit:
        return words.withColumn("depth", F.lit(-1))
    done, going, reached = [], words.withColumn("depth", F.lit(0)), 0
    while True:
        levels = F.sequence(F.lit(reached + 1), F.least(F.lit(reached + STEP), F.length("word")))
        prefixes = going.where(F.length("word") > reached).select("word", F.explode(levels).alias("level")).select("word", "level", F.substring("word", F.lit(1), F.col("level")).alias("prefix"))
        top = written(prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("below")).where(F.col("below") > limit).select("prefix"))
        deeper = prefixes.join(top, "prefix").groupBy("word").agg(F.max("level").alias("deeper"))
        found = written(going.join(deeper, "word", "left").select("word", "n", F.coalesce("deeper", "depth").alias("depth")))
        reached += STEP
        done.append(found.where(F.col("depth") < reached))
        going = found.where(F.col("depth") == reached)
        if going.isEmpty():
            break
    whole = done[0]
    for part in done[1:]:
        whole = whole.union(part)
    return whole


class Trie:
    """Levels of a trie as arrays: a node is its place in its level; a node's children are next to each other in the next one."""

    def __init__(self, words: list[str]) -> None:
        self.keys: list[np.ndarray] = []  # of each level: parent and letter of the nodes below it
        self.first: list[np.ndarray] = []  # and where the children of each node start
        self.word = [np.array([0 if words and not words[0] else -1])]  # of each node: the word that ends there
        self.below = [np.array([len(words)])]
        node, live, level = np.zeros(len(words), np.int64), np.array([k for k, w in enumerate(words) if w], np.int64), 0
        while len(live):
            letters = np.fromiter((ord(words[k][level]) for k in live.tolist()), np.int64, len(live))
            keys, place, size = np.unique(node[live] * _CODES + letters, return_inverse=True, return_counts=True)
            self.keys.append(keys)
            self.first.append(np.searchsorted(keys // _CODES, np.arange(len(self.below[-1]) + 1)))
            self.below.append(size)
            node[live] = place
            level += 1
            ends = np.fromiter((len(words[k]) == level for k in live.tolist()), bool, len(live))
            word = np.full(len(keys), -1)
            word[place[ends]] = live[ends]
            self.word.append(word)
            live = live[~ends]

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the nodes, child)."""
        if level >= len(self.keys) or not len(nodes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = self.first[level][nodes]
        size = self.first[level][nodes + 1] - start
        which = np.repeat(np.arange(len(nodes)), size)
        return which, start[which] + np.arange(len(which)) - (np.cumsum(size) - size)[which]

    def same_letter(self, at: int, a: np.ndarray, bt: int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes ``a`` on level ``at`` and of their partners ``b`` on level ``bt`` with the same letter."""
        which, child = self.children(at, a)
        if not len(child) or bt >= len(self.keys):
            return child[:0], child[:0]
        keys = self.keys[bt]
        wanted = b[which] * _CODES + self.keys[at][child] % _CODES
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[place] == wanted
        return child[hit], place[hit]


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    both = np.unique(np.stack([a, b]), axis=1)
    return both[0], both[1]


def near_words(words: list[str]) -> list[tuple[int, int]]:
    """Places of the pairs of distinct, sorted words that differ by one letter inserted, deleted or replaced."""
    trie, out = Trie(words), []
    none = np.zeros(0, np.int64)
    even, longer = (none, none), (none, none)  # spent pairs: of one level; of the next level and this one

    def emitted(at: int, a: np.ndarray, bt: int, b: np.ndarray) -> None:
        x, y = trie.word[at][a], trie.word[bt][b]
        ends = (x >= 0) & (y >= 0)
        out.extend(zip(x[ends].tolist(), y[ends].tolist()))

    for level in range(len(trie.keys)):
        nodes = np.flatnonzero(trie.below[level] > 1)  # the active node without an edit, where a pair can still arise
        if not (len(nodes) or len(even[0]) or len(longer[0])):
            break
        which, child = trie.children(level, nodes)
        longer = tuple(np.concatenate(x) for x in zip(longer, (child, nodes[which])))
        longer = _once(*longer)
        emitted(level + 1, longer[0], level, longer[1])
        even = trie.same_letter(level, even[0], level, even[1])
        # Pairs of siblings: each child with those after it under the same node.
        later = trie.first[level][nodes + 1][which] - child - 1
        left = np.repeat(np.arange(len(child)), later)
        right = child[left] + 1 + np.arange(len(left)) - (np.cumsum(later) - later)[left]
        even = tuple(np.concatenate(x) for x in zip(even, (child[left], right)))
        emitted(level + 1, even[0], level + 1, even[1])
        longer = trie.same_letter(level + 1, longer[0], level, longer[1])
    return out


def _subtree(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("word")
    words, n = rows.column("word").to_pylist(), rows.column("n").to_pylist()
    skip = len(rows.column("subtree")[0].as_py())
    # Spark and Arrow sort by UTF-8 bytes, which is the order of code points.
    pairs = near_words([w[skip:] for w in words])
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    pick = lambda values, places, kind: pa.array([values[k] for k in places], kind)
    return pa.table({"a": pick(words, a, pa.string()), "a_n": pick(n, a, pa.int64()), "b": pick(words, b, pa.string()), "b_n": pick(n, b, pa.int64())})


def near_pairs(words: DataFrame, limit: int = SUBTREE) -> DataFrame:
    """From distinct (word, n): each pair (a, a_n, b, b_n) at distance one, once."""
    words = written(with_depth(words, limit))
    below = words.where(F.length("word") > F.col("depth")).withColumn("subtree", F.substring("word", F.lit(1), F.col("depth") + 1))
    inside = below.groupBy("subtree").applyInArrow(_subtree, "a string, a_n long, b string, b_n long")
    top = words.where(F.col("depth") >= 0)
    spent = top.select("word", "n", F.explode(F.sequence(F.lit(0), F.least("depth", F.length("word") - 1))).alias("at"))
    letter = lambda place: F.substring("word", place, F.lit(1))
    spent = written(
        spent.select(
            "word", "n", "at", F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.length("word"))).alias("path"),
            (letter(F.col("at") + 1) != letter(F.col("at") + 2)).alias("parts"),  # of equal neighbours only the last parts the paths
        )
    )
    one, other = spent.select("path", "at", F.col("word").alias("a"), F.col("n").alias("a_n")), spent.select("path", "at", F.col("word").alias("b"), F.col("n").alias("b_n"))
    replaced = one.join(other, ["path", "at"]).where("a < b").select("a", "a_n", "b", "b_n")
    shorter = top.select(F.col("word").alias("path"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    deleted = spent.where("parts").select("path", F.col("word").alias("a"), F.col("n").alias("a_n")).join(shorter, "path").select("a", "a_n", "b", "b_n")
    return inside.union(replaced).union(deleted)


def roots(forms: DataFrame) -> DataFrame:
    """From (word, form), without cycles: (word, root), the last of each chain."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        next_ = written(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        now = next_.select("word", "root")
        if next_.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, limit: int = SUBTREE) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = written(vocabulary(docs))
    pairs = written(near_pairs(words, limit))
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.union(pairs.select("b", "b_n", "a", "a_n"))
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= RATIO * F.col("n")
    best = written(best.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    last = roots(best.where("form is not null"))
    return words.join(best, "word", "left").join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
