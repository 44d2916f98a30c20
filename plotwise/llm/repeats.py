"""Operator 10: removal of repeated byte strings, by prefix doubling over the positions that can matter.

A byte goes if a string of ``SIZE`` bytes that covers it also starts earlier, in a smaller document or further left.
Names (ranks) of strings double in length: the name of 2n bytes at a position comes from the names of n bytes there
and n bytes on.  Positions are dropped as soon as their name is unique, so few ever reach the full length:

1. Names of ``GRAM`` bytes are doubled up in memory at every position.  In every string of ``SIZE`` bytes the least of
   them is its anchor, so that equal strings have equal anchors at equal places; only anchors go on, one in about 33.
2. Anchors are sorted by name and by the name of all ``SIZE`` - ``GRAM`` bytes around them.  Where the name occurs once,
   no string with this anchor repeats.  Where the long name occurs again, everything around all but its first place
   repeats.  What is left are first places of long names whose short name has several: the edges of repeats.
3. Only around these, the strings of ``SIZE`` bytes get their names; all but the first of a name go.  They meet under
   their anchor's name, or, where that is very frequent, under their own, so that no task gets them all.

Equal names are handled where they are made, before any shuffle: of copies in one batch only the first goes on.  The
sorted names are read as a stream, so that no unbounded group is held in memory.  Short names only select (a clash costs
time); long ones are 64 bits besides the short name's 64, and names of whole strings 128 bits.

Defined cases: null and empty texts, and those shorter than ``SIZE`` bytes, lose nothing; matches never cross
documents; a null doc_id comes before all others; rows of one doc_id (or without any) with different texts are documents
of their own, ordered by the MD5 digests of their texts; rows equal in both are one document, and each gets its row;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.operators.ranks import numbered

from .common import cut, portions, table, written
from .components import apart

SIZE, GRAM, HOT = 100, 36, 1024
REACH = SIZE - GRAM  # an anchor stands up to so many bytes after the start of its string
SLICE = 1 << 20
_BASE = np.random.default_rng(11).integers(1 << 20, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def gram_names(data: np.ndarray) -> np.ndarray:
    """Names of the ``GRAM`` bytes from each position, by doubling."""
    name, length, done, reached = _BASE[data], 1, None, 0
    while True:
        if GRAM & length:
            if done is None:
                done, reached = name, length
            else:
                n = len(name) - reached
                done = done[:n] * np.uint64(pow(_STEP, length, 1 << 64)) + name[reached:]
                reached += length
        length *= 2
        if length > GRAM:
            break
        half = length // 2
        name = name[: len(name) - half] * np.uint64(pow(_STEP, half, 1 << 64)) + name[half:]
    done = (done ^ (done >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return done ^ (done >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    reached = 1
    while reached * 2 <= width:
        values = best(values[:-reached], values[reached:])
        reached *= 2
    return best(values[: len(values) - (width - reached)], values[width - reached :]) if width > reached else values


def least_names(names: np.ndarray) -> np.ndarray:
    """For each string of ``SIZE`` bytes the least name in it."""
    return _sliding(names, REACH + 1, np.minimum)


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, names) of the anchors of all strings of ``SIZE`` bytes, a slice of the text at a time."""
    strings = len(data) - SIZE + 1
    for at in range(0, max(strings, 0), SLICE):
        view = np.frombuffer(data, np.uint8, min(SLICE, strings - at) + SIZE - 1, at)
        names = gram_names(view)
        least = least_names(names)
        edge = np.zeros(REACH, np.uint64)
        most = _sliding(np.concatenate([edge, least, edge]), REACH + 1, np.maximum)
        places = np.flatnonzero(most == names)
        yield places + at, names[places]


def _runs(positions: np.ndarray, chosen: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the stretches of chosen anchors between others."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], chosen.view(np.int8), [0]])))
    return [(int(positions[a]), int(positions[b - 1])) for a, b in zip(edges[::2], edges[1::2])]


def _first_of_each(order_by: list[np.ndarray], names: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows equal in the first ``names`` arrays: which is the first by all arrays, and which stand at another place."""
    order = np.lexsort(order_by[::-1])
    ordered = [a[order] for a in order_by]
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([a[1:] != a[:-1] for a in ordered[:names]], axis=0)
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else order
    elsewhere = np.any([a != a[start] for a in ordered[names:]], axis=0)
    first, again = np.empty(len(order), bool), np.empty(len(order), bool)
    first[order], again[order] = new, elsewhere
    return first, again


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, around, doc, pos, last): anchors; with null ``around``, stretches known to repeat."""
    for batch in batches:
        for part in portions(batch):
            docs, name, around, place = [], [], [], []
            for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist()):
                data = (text or "").encode("utf-8", "replace")
                digest = xxhash.xxh3_64_intdigest
                last = -1
                for places, names in anchors(data):
                    if last >= 0:
                        places, names = places[places > last], names[places > last]
                    if len(places):
                        last = int(places[-1])
                        name.append(names)
                        place.append(places)
                        # Cut off at an end of the text, what is around has another length or place in it.
                        around.append(np.array([digest(data[max(p - REACH, 0) : p + SIZE], min(p, REACH)) for p in places.tolist()], np.uint64))
                        docs.append(np.full(len(places), doc, np.int64))
            if not docs:
                continue
            doc, name, around, place = map(np.concatenate, (docs, name, around, place))
            first, again = _first_of_each([name, around, doc, place], 2)
            gone: list[tuple[int, int, int]] = []
            for at in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
                if again[at].any():
                    gone += [(int(doc[at[0]]), a, b) for a, b in _runs(place[at], again[at])]
            kept = np.flatnonzero(first)
            extra = np.array(gone, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([name[kept].view(np.int64), extra[:, 0] * 0x9E3779B1])),
                    pa.array(np.concatenate([around[kept].view(np.int64), extra[:, 0]]), mask=np.arange(len(kept) + len(extra)) >= len(kept)),
                    pa.array(np.concatenate([doc[kept], extra[:, 0]])),
                    pa.array(np.concatenate([place[kept], extra[:, 1]])),
                    pa.array(np.concatenate([place[kept], extra[:, 2]])),
                ],
                ["name", "around", "doc", "pos", "last"],
            )


def _settle_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted anchor rows: (name, doc, pos, last, edge); edge: first of a long name whose short name has another."""
    name_now, around_now, first_now, held, several = None, None, (0, 0), None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.column("around").is_null().to_numpy(zero_copy_only=False)
        name, doc, pos, last = (batch.column(c).to_numpy() for c in ("name", "doc", "pos", "last"))
        around = batch.column("around").fill_null(0).to_numpy()
        out = [(name[known], doc[known], pos[known], last[known], np.zeros(known.sum(), bool))]
        name, around, doc, pos = (x[~known] for x in (name, around, doc, pos))
        if len(name):
            new_name = np.concatenate([[name[0] != name_now], name[1:] != name[:-1]])
            new = new_name | np.concatenate([[around[0] != around_now], around[1:] != around[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            first_doc = np.where(at < 0, first_now[0], doc[at])
            first_pos = np.where(at < 0, first_now[1], pos[at])
            again = ~new & ((doc != first_doc) | (pos != first_pos))
            out.append((name[again], doc[again], pos[again], pos[again], np.zeros(again.sum(), bool)))
            # First rows of long names, by short name; the last short name may go on in the next batch.
            firsts = np.flatnonzero(new)
            group = np.cumsum(new_name)[firsts]  # 0: goes on from the batch before
            if len(firsts):
                counts = np.bincount(group, minlength=int(group.max()) + 1)
                if counts[0]:
                    if held is not None:
                        out.append((np.array([name_now]), np.array([held[0]]), np.array([held[1]]), np.array([held[1]]), np.ones(1, bool)))
                        held = None
                    several = True
                multi = (counts > 1) | ((np.arange(len(counts)) == 0) & several)
                if new_name.any():
                    held, several = None, False
                    tail = len(counts) - 1
                    if counts[tail] == 1:
                        held = (int(doc[firsts[-1]]), int(pos[firsts[-1]]))
                    else:
                        several = True
                edge = firsts[multi[group]]
                out.append((name[edge], doc[edge], pos[edge], pos[edge], np.ones(len(edge), bool)))
            name_now, around_now = name[-1], around[-1]
            first_now = (int(first_doc[-1]), int(first_pos[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["name", "doc", "pos", "last", "edge"])


def _own_strings(data: bytes, start: int, anchor: int) -> list[int]:
    """Starts of the strings in ``data``, which begins at byte ``start``, whose anchor is at byte ``anchor``."""
    names = gram_names(np.frombuffer(data, np.uint8))
    return (np.flatnonzero(least_names(names) == names[anchor - start]) + start).tolist()


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, low, doc, pos, start, around) from texts with their edges.

    An edge goes on with the bytes around it, under the anchor's name.  Those of very frequent names are cut into
    their strings here, one row each under the string's own name, so that they are dealt to many tasks; null ``low``
    and ``around``: known to repeat.
    """
    for batch in batches:
        for part in portions(batch, rows=512):
            edges_out, docs, starts, digests, done = [], [], [], [], set()
            for doc, text, edges in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "edges"))):
                data = (text or "").encode("utf-8", "replace")
                for edge in edges:
                    p, start = edge["pos"], max(0, edge["pos"] - REACH)
                    around = data[start : p + SIZE]
                    if len(around) < SIZE:
                        continue
                    if not edge["hot"]:
                        edges_out.append((edge["name"], doc, p, start, around))
                        continue
                    for s in _own_strings(around, start, p):
                        if (doc, s) not in done:
                            done.add((doc, s))
                            docs.append(doc)
                            starts.append(s)
                            digests.append(xxhash.xxh3_128_digest(data[s : s + SIZE]))
            rows = [pa.array(c, k) for c, k in zip(zip(*edges_out) if edges_out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            n = len(edges_out)
            yield pa.RecordBatch.from_arrays([rows[0], pa.nulls(n, pa.int64()), rows[1], rows[2], rows[3], rows[4]], ["key", "low", "doc", "pos", "start", "around"])
            if docs:
                doc, start = np.array(docs, np.int64), np.array(starts, np.int64)
                names = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                first, _ = _first_of_each([names[:, 0], names[:, 1], doc, start], 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(first, names[:, 0], doc * 0x9E3779B1)), pa.array(names[:, 1], mask=~first), pa.array(doc), pa.array(start), pa.array(start), pa.nulls(len(doc), pa.binary())],
                    ["key", "low", "doc", "pos", "start", "around"],
                )


def _repeated_strings(group: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """(doc, first, last) of the strings of a name's edges, in order, that another edge before has; neighbours merged."""
    seen: dict[bytes, tuple[int, int]] = {}
    for doc, pos, start, around in group:
        first = last = -1
        for s in _own_strings(around, start, pos):
            name = xxhash.xxh3_128_digest(around[s - start : s - start + SIZE])
            if seen.setdefault(name, (doc, s)) != (doc, s):
                if first >= 0 and s <= last + SIZE:
                    last = s
                    continue
                if first >= 0:
                    yield doc, first, last + SIZE
                first = last = s
        if first >= 0:
            yield doc, first, last + SIZE


def _settle_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted edge rows: (doc, first, last) of what repeats; at most ``HOT`` edges of one name are held at a time."""
    high_now, low_now, first_now = None, None, (0, 0)
    group_key, group = None, []
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        strings = batch.column("around").is_null().to_numpy(zero_copy_only=False)
        edges = batch.filter(pa.array(~strings))
        for key, *row in zip(*(edges.column(c).to_pylist() for c in ("key", "doc", "pos", "start", "around"))):
            if key != group_key:
                out += _repeated_strings(group)
                group_key, group = key, []
            group.append(tuple(row))
        batch = batch.filter(pa.array(strings))
        known = batch.column("low").is_null().to_numpy(zero_copy_only=False)
        high, doc, start = (batch.column(c).to_numpy() for c in ("key", "doc", "start"))
        low = batch.column("low").fill_null(0).to_numpy()
        gone = [(doc[known], start[known])]
        high, low, doc, start = (x[~known] for x in (high, low, doc, start))
        if len(high):
            new = np.concatenate([[(high[0] != high_now) or (low[0] != low_now)], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            first_doc, first_start = np.where(at < 0, first_now[0], doc[at]), np.where(at < 0, first_now[1], start[at])
            again = ~new & ((doc != first_doc) | (start != first_start))
            gone.append((doc[again], start[again]))
            high_now, low_now, first_now = high[-1], low[-1], (int(first_doc[-1]), int(first_start[-1]))
        yield _spans(out, gone)
    yield _spans(list(_repeated_strings(group)), [])


def _spans(rows: list[tuple[int, int, int]], strings: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = np.array(rows, np.int64).reshape(-1, 3)
    doc = np.concatenate([columns[:, 0], *(d for d, _ in strings)])
    first = np.concatenate([columns[:, 1], *(x for _, x in strings)])
    last = np.concatenate([columns[:, 2], *(x + SIZE for _, x in strings)])
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["doc", "first", "last"])


def removed_spans(size: int, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal [start, end) of the given ones within ``size`` bytes."""
    out: list[list[int]] = []
    for a, b in sorted((max(a, 0), min(b, size)) for a, b in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if a < b]


def repeated(docs: DataFrame) -> DataFrame:
    """From (doc, text): (doc, first, last), bytes [first, last) that repeat; they may overlap, and pass the text's end."""
    around = docs.mapInArrow(_anchor_rows, "name long, around long, doc long, pos long, last long")
    settled = around.repartition("name").sortWithinPartitions("name", "around", "doc", "pos")
    settled = cut(settled.mapInArrow(_settle_anchors, "name long, doc long, pos long, last long, edge boolean"))
    edges = settled.where("edge").select("name", "doc", "pos")
    hot = edges.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(apart("name").alias("name"), F.lit(True).alias("hot"))
    marked = edges.join(hot, "name", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    edges = marked.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("pos", "name", "hot"))).alias("edges"))
    rows = docs.join(edges, "doc").select("doc", "text", "edges").mapInArrow(_edge_rows, "key long, low long, doc long, pos long, start long, around binary")
    strings = rows.repartition("key").sortWithinPartitions("key", "low", "doc", "pos").mapInArrow(_settle_strings, "doc long, first long, last long")
    return settled.where("not edge").select("doc", (F.col("pos") - REACH).alias("first"), (F.col("last") + SIZE).alias("last")).union(strings)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    for batch in (part for whole in batches for part in portions(whole)):
        rows = []
        for doc, text, first, last in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "first", "last"))):
            data = (text or "").encode("utf-8", "replace")
            spans = removed_spans(len(data), list(zip(first or (), last or ())))
            digest, at = hashlib.sha256(), 0
            for a, b in [*spans, (len(data), len(data))]:
                digest.update(data[at:a])
                at = b
            rows.append((doc, len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_places(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text), where ``doc`` orders documents by doc_id, and those of one doc_id by the digest of their text; and (doc, doc_id).

    ``doc`` is the doc_id itself, without a second table, where each has one text, which is looked up first; else it is
    counted over sorted ranges.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")
    names = written(docs.select("doc_id", digest).distinct())
    if names.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).where((F.col("texts") > 1) | F.col("doc_id").isNull()).isEmpty():
        return docs.withColumnRenamed("doc_id", "doc"), None
    places = written(numbered(names, [F.col("doc_id").asc_nulls_first(), F.col("digest")], "doc"))
    own = docs.withColumn("digest", digest)
    own = own.join(places, own["doc_id"].eqNullSafe(places["doc_id"]) & (own["digest"] == places["digest"]))
    return own.select("doc", "text"), places.select("doc", "doc_id")


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ids = with_places(table(spark, sf_dir, "documents"))
    docs = docs.where("doc is not null")  # none is; the edges' join asks it, and only equal plans are dealt out together
    spans = repeated(docs).groupBy("doc").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    joined = docs.join(spans, "doc", "left")  # the texts are dealt out once, for the edges and again here
    found = joined.mapInArrow(_kept, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if ids is None:
        return found.withColumnRenamed("doc", "doc_id")
    return found.join(ids, "doc").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
