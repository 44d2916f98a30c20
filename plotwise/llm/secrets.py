"""Operator 4: secret scans.

``scan`` finds fixed patterns and, beside them, spans of high entropy: every maximal run of token characters is a
candidate; a window slides over it and keeps counts per character, from which the Shannon entropy is updated in
constant time a step, separately for each character class.  Windows above the class's threshold merge into spans;
spans that the allow-list covers are suppressed, and what a fixed pattern already reports is cut from them.

Letters of a single case without any digit are taken for words: by entropy alone they cannot be told from compounds.

Offsets are code points, ends exclusive.  Defined cases: null and empty texts have no spans; repeated rows each get
their row; very long texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

KINDS = ("assign", "access", "hex", "entropy")


def _either_case(words: tuple[str, ...]) -> str:
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in words)


#: Fixed patterns of the query's contract; letters of the names stand in either case.
_ASSIGN = re.compile("(" + _either_case(("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # as AKIA[A-Z0-9]+ of 20 characters or more: both end where the run ends
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Class: characters, window, least bits a character, least digits, upper-case and lower-case letters in the window.
#: Base32 (A-Z, 2-7) has a threshold of its own beside "upper", as fewer characters give fewer bits.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 20, 3.0, 3, 0, 0),
    ("base64", frozenset(_UPPER + _LOWER + _DIGITS + "+/_=-"), 20, 3.7, 2, 1, 1),
    ("mixed", frozenset(_UPPER + _LOWER + _DIGITS + "+/_=-"), 20, 3.5, 0, 4, 4),
    ("lower", frozenset(_LOWER + _DIGITS), 20, 3.4, 1, 0, 1),
    ("upper", frozenset(_UPPER + _DIGITS), 20, 3.4, 1, 1, 0),
    ("base32", frozenset(_UPPER + "234567"), 20, 3.3, 1, 1, 0),
)
_NAME = r"(?:[A-Z]+|[A-Z]?[a-z]*(?:[A-Z][a-z]{2,})*)"  # a word, or several in camel case
#: What a run of token characters, or a found span, may be as a whole.
ALLOWED = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUIDs
    rf"{_NAME}([_/-]{_NAME})*",  # words and paths of words
    r"[0-9]+([_/-][0-9]+)*",  # numbers, dates
)
#: What a found span, but not what stands beside it, may contain.
EXAMPLE = re.compile(r"(?i)example")
_TERM = [0.0] + [n * math.log2(n) for n in range(1, 65)]


def dense_windows(text: str, members: frozenset, window: int, bits: float, digits: int, upper: int, lower: int) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows of ``members`` that pass; counts move with the window, one step a character."""
    spans: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total, kinds, run = 0.0, [0, 0, 0], 0
    for at, c in enumerate(text):
        if c not in members:
            counts, total, kinds, run = {}, 0.0, [0, 0, 0], 0
            continue
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        kinds[0 if c.isdigit() else 1 if c.isupper() else 2] += 1
        run += 1
        if run > window:
            old = text[at - window]
            n = counts[old]
            counts[old] = n - 1
            total += _TERM[n - 1] - _TERM[n]
            kinds[0 if old.isdigit() else 1 if old.isupper() else 2] -= 1
        if run >= window and kinds[0] >= digits and kinds[1] >= upper and kinds[2] >= lower and math.log2(window) - total / window >= bits:
            start = at - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((start, at + 1))
    return spans


_ALLOWED = tuple(re.compile(p) for p in ALLOWED)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as disjoint spans, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def entropy_spans(text: str, base: list[tuple[str, int, int]], classes=CLASSES, allowed=_ALLOWED) -> list[tuple[str, int, int]]:
    """Spans that the windows add: their parts outside the base spans, unless on the allow-list."""
    taken = _joined([(s, e) for _, s, e in base])
    out, first = [], 0
    for m in _CANDIDATE.finditer(text):
        word = m.group()
        if any(p.fullmatch(word) for p in allowed):
            continue
        for s, e in _joined([x for _, *rule in classes for x in dense_windows(word, *rule)]):
            found = word[s:e]
            if EXAMPLE.search(found) or any(p.fullmatch(found) for p in allowed):
                continue
            at, end = s + m.start(), e + m.start()
            while first < len(taken) and taken[first][1] <= at:
                first += 1
            while first < len(taken) and taken[first][0] < end:
                if taken[first][0] > at:
                    out.append(("entropy", at, taken[first][0]))
                at = taken[first][1]
                if at >= end:  # may reach into the next span
                    break
                first += 1
            if at < end:
                out.append(("entropy", at, end))
    return out


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All (kind, start, end), by start and then by kind as listed in ``KINDS``."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + entropy_spans(text, base), key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each maximal stretch of spans replaced by ``mark``."""
    if not text:
        return text
    out, at, last = [], 0, None
    for kind, start, end in scan(text):
        if end <= at:
            continue
        if start > at or start == at and "entropy" not in (kind, last):  # what is cut from a span belongs to what it touches
            out += [text[at:start], mark]
        elif last is None:
            out.append(mark)
        at, last = end, kind
    return "".join([*out, text[at:]])


def _digest(doc_id, text) -> tuple:
    spans = scan(text)
    join = lambda kept: ",".join(f"{k}:{s}:{e}" for k, s, e in kept)
    base = [x for x in spans if x[0] != "entropy"]
    counts = [sum(x[0] == k for x in base) for k in KINDS[:3]]
    return (doc_id, *counts, hashlib.sha256(join(base).encode()).hexdigest(), join(spans))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return arrow_map(docs, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", _digest)
