"""Operator 7: byte-level BPE encoding and decoding.

Encoder.  The merges are a finite-state transducer over the bytes of a piece, determinised lazily.  A state is
the set of tokens that may be under way, of which the longest start tells all, and for each of these starts the token
that ended before it; states and moves are made when first needed.  A move tells the one token that ends at its byte:
of those that may end in the state, the one that can stand beside the token before it, because no merge would join the
two.  New words of many texts are read side by side, a byte of all of them at a time; a long piece is read alone.  There
a boundary is certain as soon as the ways back from all places where a token under way may have begun pass through it;
the tokens up to it are emitted.  The lookahead is bounded by the longest token.

Decoder.  Token bytes run through a UTF-8 state machine that hands out whole characters and holds back the bytes of
an unfinished one; bytes that are not UTF-8 pass as they are (or as U+FFFD in ``text``).

Defined cases: null and empty texts encode to no ids; repeated rows each get their row; a text of any length is
encoded whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, portions, table

#: Most pairs, pieces and words remembered, and the longest of these; bytes of a piece after which certain tokens are emitted.
PAIRS, PIECES, WORDS, PIECE_BYTES, LOOKAHEAD = 1_000_000, 100_000, 300_000, 48, 1024
#: Bytes of the beginnings of pieces after which the machine's reading is remembered, the longest first, and how many are.
HEADS, HEADS_KEPT = (13, 9, 6), 200_000
#: Most states remembered between pieces, pieces whose bytes are read side by side, and bytes of texts that are encoded together.
STATES, ABREAST, TOGETHER = 400_000, 16_384, 1 << 19
#: The pattern for which a blank between two words starts a piece: fixed by the public vocabulary.
WORDS_APART = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blank space beside blanks and line ends: fixed, as the pattern's ``\\s``.
RARE_BLANKS = [*map(chr, (9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)), "  ", "\n\n", " \n", "\n "]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        growing = {token[:n] for token in ranks for n in range(1, len(token))}
        self.growing = {start: start for start in growing} | {b"": b""}
        self.open: dict[bytes, tuple[bytes, ...]] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.halves: dict[bytes, list[bytes]] = {}
        self.own: dict[int, bool] = {}
        self.pairs: dict[int, dict[int, bool]] = {token: {} for token in self.tokens}  # of a token: what may stand before it
        self.known = 0
        self._forget()

    def _forget(self) -> None:
        self.heads: dict[bytes, tuple[int, tuple[int, ...]]] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.ending, self.lengths = array("i"), array("i")  # of a state: the token that ends there, and its length
        self.moves: dict[int, int] = {}  # state << 8 | byte: the next state, for pieces read alone
        self.slots = np.full(1 << 12, -1, np.int64), np.zeros(1 << 12, np.int32)  # the same for pieces read side by side, hashed
        self.filled = 0
        self._number((b"", -1), 0)

    def _number(self, state: tuple, length: int) -> int:
        """A state is the longest open start of a token, and for it and each shorter one the token that ended before it."""
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.ending.append(state[-1])
            self.lengths.append(length)
        return self.numbers[state]

    def _starts(self, longest: bytes) -> tuple[bytes, ...]:
        """The ends of some bytes that tokens start with, the longest first; the last is empty."""
        if (known := self.open.get(longest)) is None:
            known = self.open[longest] = tuple(self.growing[longest[k:]] for k in range(len(longest) + 1) if longest[k:] in self.growing)
        return known

    def _move(self, key: int) -> int:
        """The one token that ends after a byte: the longest that fits beside the token before it."""
        longest, *before = self.states[key >> 8]
        end, token, length, on, lefts = bytes((key & 255,)), -1, 0, None, []
        for start, left in zip(self._starts(longest), before):
            read = start + end
            if token < 0 and (ending := self.ranks.get(read)) is not None and (self._whole(ending) if left < 0 else self._side_by_side(left, ending)):
                token, length = ending, len(read)
            if read in self.growing:
                on = on or read
                lefts.append(left)
        if token < 0:
            raise ValueError("no token ends here")
        return self._number((self.growing[on or b""], *lefts, token), length)

    def _merged(self, data: bytes, below: int = 1 << 60) -> list[bytes]:
        """Merge by rank, the leftmost of the lowest first; only tokens come here."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """(bytes, rank, rank of the token it goes into) of the token and its parts along one edge."""
        if (known := self.spines[right].get(token)) is None:
            known, part, above = [], self.tokens[token], 1 << 60
            while True:
                rank = self.ranks[part]
                known.append((part, rank, above))
                if len(part) == 1:
                    break
                if part not in self.halves:
                    self.halves[part] = self._merged(part, rank)
                part, above = self.halves[part][-1 if right else 0], rank
            self.spines[right][token] = known
        return known

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether no merge joins the two tokens: none comes, or is leftmost, before both of its sides go elsewhere."""
        if (known := self.pairs[right].get(left)) is None:
            get, known = self.ranks.get, True
            for a, made_a, gone_a in self._spine(left, True):
                for b, made_b, gone_b in self._spine(right, False):
                    if made_b < gone_a and made_a < gone_b and (rank := get(a + b)) is not None:
                        when = max(rank, made_a, made_b)
                        if when < gone_a and (when < gone_b or rank == gone_b):
                            known = False
            self.pairs[right][left] = known
            self.known += 1
        return known

    def _whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives it."""
        if (known := self.own.get(token)) is None:
            known = self.own[token] = len(self._merged(self.tokens[token])) == 1
        return known

    def _bounded(self) -> None:
        if self.known > PAIRS:
            for pairs in self.pairs.values():
                pairs.clear()
            self.known = 0
        if len(self.states) > STATES:
            self._forget()

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        self._bounded()
        if len(self.heads) > HEADS_KEPT:
            self.heads.clear()
        size, state, ends, missed = 0, 0, [], []
        for head in HEADS:
            if head <= len(piece):
                if (known := self.heads.get(piece[:head])) is not None:
                    size, state, ends = head, known[0], list(known[1])
                    break
                missed.append(head)
        for stop in reversed(missed):
            state, ends = self._read(piece[size:stop], state, ends, [])
            self.heads[piece[:stop]] = state, tuple(ends)
            size = stop
        out: list[int] = []
        _, ends = self._read(piece[size:], state, ends, out)
        return out + self._path(ends, len(ends))

    def _read(self, data: bytes, state: int, ends: list[int], out: list[int]) -> tuple[int, list[int]]:
        """Go on from a state, with the token that ends at each byte not given out yet; certain tokens go to ``out``."""
        moves, ending = self.moves, self.ending
        for at in range(0, len(data), LOOKAHEAD):
            for byte in data[at : at + LOOKAHEAD]:
                key = state << 8 | byte
                if (state := moves.get(key)) is None:
                    state = moves[key] = self._move(key)
                ends.append(ending[state])
            if len(ends) > LOOKAHEAD:
                done = self._certain(ends, self.states[state][0])
                out += self._path(ends, done)
                ends = ends[done:]
                if len(self.states) > STATES:
                    kept, length = self.states[state], self.lengths[state]
                    self._forget()
                    state, moves, ending = self._number(kept, length), self.moves, self.ending
        return state, ends

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short pieces, whose bytes are read side by side; and for each piece where its ids end."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(pieces), ABREAST):
            self._bounded()
            found.append(self._abreast(pieces[at : at + ABREAST]))
        sizes = np.concatenate([n for _, n in found])
        return np.concatenate([ids for ids, _ in found]), np.cumsum(sizes)

    def _abreast(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        offsets = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        place, going = offsets[order], np.cumsum(np.bincount(sizes)[::-1])[::-1]  # going: how many have so many bytes
        state, states = np.zeros(len(pieces), np.int64), np.empty(len(data), np.int64)
        for n in going[1:].tolist():
            now = place[:n]
            state = states[now] = self._moved(state[:n] << 8 | data[now])
            place += 1
        ending, lengths = np.frombuffer(self.ending, np.int32)[states].astype(np.int64), np.frombuffer(self.lengths, np.int32)[states]
        whole = [(k, rank) for k, piece in enumerate(pieces) if (rank := self.ranks.get(piece)) is not None]
        if whole:
            last = (offsets + sizes - 1)[[k for k, _ in whole]]
            ending[last], lengths[last] = [rank for _, rank in whole], sizes[[k for k, _ in whole]]
        ends, at, begin = np.zeros(len(data), bool), offsets + sizes - 1, offsets
        while len(at):
            ends[at] = True
            at = at - lengths[at]
            more = at >= begin
            at, begin = at[more], begin[more]
        return ending[ends], np.add.reduceat(ends, offsets, dtype=np.int64)

    def _moved(self, keys: np.ndarray) -> np.ndarray:
        """The next states; moves that nobody made yet are made one by one."""
        found, missing = self._looked_up(keys)
        if len(missing):
            new = np.unique(keys[missing])
            made = np.array(list(map(self._move, new.tolist())), np.int32)
            found[missing] = made[np.searchsorted(new, keys[missing])]
            self.filled += len(new)
            if 2 * self.filled > len(self.slots[0]):
                held, old = self.slots[0] >= 0, self.slots
                self.slots = np.full(4 * len(held), -1, np.int64), np.zeros(4 * len(held), np.int32)
                self._file(old[0][held], old[1][held])
            self._file(new, made)
        return found

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B97F4A7C1 >> 20) & (len(self.slots[0]) - 1)

    def _looked_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, places of the keys that are not filed)."""
        filed, values = self.slots
        slot = self._slot(keys)
        there = filed[slot]
        found, missing = values[slot].astype(np.int64), []
        left = np.flatnonzero(there != keys)
        while len(left):
            empty = there[left] < 0
            missing.append(left[empty])
            left = left[~empty]
            slot[left] = (slot[left] + 1) & (len(filed) - 1)
            there[left] = filed[slot[left]]
            found[left] = values[slot[left]]
            left = left[there[left] != keys[left]]
        return found, np.concatenate(missing) if missing else left

    def _file(self, keys: np.ndarray, states: np.ndarray) -> None:
        """File keys that are different and not there yet, each in the first free slot from its own."""
        filed, values = self.slots
        slot = self._slot(keys)
        while len(keys):
            free = filed[slot] < 0
            filed[slot[free]] = keys[free]
            here = filed[slot] == keys
            values[slot[here]] = states[here]
            keys, states, slot = keys[~here], states[~here], (slot[~here] + 1) & (len(filed) - 1)

    def _path(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes, found from their end."""
        out = []
        while at > 0:
            out.append(ends[at - 1])
            at -= len(self.tokens[ends[at - 1]])
        return out[::-1]

    def _certain(self, ends: list[int], longest: bytes) -> int:
        """The last boundary on the ways back from every place where a token that goes on may have begun."""
        size, common = len(ends), None
        for start in self._starts(longest):
            at, way = size - len(start), {0}
            while at > 0:
                way.add(at)
                at -= len(self.tokens[ends[at - 1]])
            common = way if common is None else common & way
        return max(common)


class Utf8Stream:
    """Takes bytes in any portions; gives whole characters as soon as their last byte is there."""

    def __init__(self) -> None:
        self.held, self.need, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> list[tuple[bytes, bool]]:
        """(bytes, whether they are whole characters) in the order of the input."""
        if not self.need:
            end = len(data)
            while end and len(data) - end < 3 and data[end - 1] & 0xC0 == 0x80:
                end -= 1
            end -= end > 0 and data[end - 1] >= 0xC0  # the last character, which may be unfinished, goes byte by byte
            try:
                data[:end].decode()
                return [(data[:end], True)] * (end > 0) + self._steps(data[end:])
            except UnicodeDecodeError:
                pass
        return self._steps(data)

    def _steps(self, data: bytes) -> list[tuple[bytes, bool]]:
        out = []
        for byte in data:
            if self.need:
                if self.low <= byte <= self.high:
                    self.held += bytes((byte,))
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append((self.held, True))
                        self.held = b""
                    continue
                out.append((self.held, False))
                self.held, self.need = b"", 0
            self.low, self.high = 0x80, 0xBF
            if byte < 0x80:
                out.append((bytes((byte,)), True))
            elif 0xC2 <= byte <= 0xF4:
                self.held, self.need = bytes((byte,)), 1 + (byte >= 0xE0) + (byte >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            else:
                out.append((bytes((byte,)), False))
        return out

    def close(self) -> bytes:
        held, self.held, self.need = self.held, b"", 0
        return held


class Recent:
    """A bounded memory: when the newer half is full, it becomes the older half; what is used again is kept."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        if (found := self.new.get(key)) is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.new, self.old = {}, self.new
        self.new[key] = value


class Codec:
    """Encodes whole texts piece by piece; ids of common short words and pieces are remembered, as decimal text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine, self.split = Transducer(ranks), regex.compile(pattern)
        self.apart = pattern == WORDS_APART
        self.named = {str(rank): token for token, rank in ranks.items()}
        self.pieces, self.words = Recent(PIECES), Recent(WORDS)

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for portion in self._portions(text or "", self._words(text or "")) for x in " ".join(portion).split(" ")]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        stream = Utf8Stream()
        out = [part for token in ids for part, _ in stream.feed(self.machine.tokens[token])]
        return b"".join([*out, stream.close()])

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """Text in portions, as tokens arrive; what is not UTF-8 becomes U+FFFD."""
        stream = Utf8Stream()
        for token in ids:
            if part := "".join(x.decode() if whole else "\ufffd" for x, whole in stream.feed(self.machine.tokens[token])):
                yield part
        if stream.close():
            yield "\ufffd"

    def _piece(self, piece: str) -> str:
        if (found := self.pieces.get(piece)) is None:
            found = " ".join(map(str, self.machine.encode_piece(piece.encode("utf-8", "surrogatepass"))))
            if len(piece) <= PIECE_BYTES:
                self.pieces.put(piece, found)
        return found

    def _word(self, word: str) -> str:
        """Ids of a word and the blank or line end before it; it holds no other blank space. A blank is left out."""
        if (found := self.words.old.get(word)) is None:
            found = " ".join([self._piece(x) for x in self.split.findall(word if word[:1] == "\n" else " " + word)])
        if len(word) <= PIECE_BYTES:
            self.words.put(word, found)
        return found

    def _words(self, text: str) -> list[str] | None:
        """What stands between the blanks of a text; a word that starts a line has the line end before it.

        Pieces never reach over a blank between two words, nor over the line end before one: each word can be split
        alone. None: the text has other blank space.
        """
        if not text or not self.apart or text[0] in " \n" or text[-1] == " " or any(map(text.__contains__, RARE_BLANKS)):
            return None
        return text.replace("\n", " \n").split(" ")

    def learn(self, texts: Iterable[list[str] | None]) -> None:
        """Remember the words of some texts that are not known yet; all of their pieces are read side by side."""
        met = set()
        for words in filter(None, texts):
            met.update(words[1:])
        new = [x for x in met.difference(self.words.new) if len(x) <= PIECE_BYTES]
        for word in (old := [x for x in new if x in self.words.old]):
            self.words.put(word, self.words.old.get(word) or self._word(word))
        if not (new := list(set(new).difference(old))):
            return
        pieces = [self.split.findall(x if x[0] == "\n" else " " + x) for x in new]
        ids, ends = self.machine.encode_pieces([x.encode("utf-8", "surrogatepass") for found in pieces for x in found])
        names = list(map(str, ids.tolist()))
        stops = ends[np.cumsum(list(map(len, pieces))) - 1].tolist()
        for word, a, b in zip(new, [0, *stops], stops):
            self.words.put(word, " ".join(names[a:b]))

    def _portions(self, text: str, words: list[str] | None) -> Iterator[list[str]]:
        """Decimal ids of some thousand pieces or words at a time."""
        if words is None:
            found = self.split.findall(text)
            for at in range(0, len(found), 4096):
                yield [self._piece(x) for x in found[at : at + 4096]]
            return
        yield [self._piece(x) for x in self.split.findall(words[0])]
        for at in range(1, len(words), 4096):
            known = self.words.new.get
            yield [known(x) or self._word(x) for x in words[at : at + 4096]]

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids, SHA-256 of the bytes that they decode to."""
        words = [self._words(text or "") for text in texts]
        self.learn(words)
        return [self._digest(text or "", found) for text, found in zip(texts, words)]

    def digest(self, text: str | None) -> tuple[int, str, str]:
        return self._digest(text or "", self._words(text or ""))

    def _digest(self, text: str, words: list[str] | None) -> tuple[int, str, str]:
        n, ids, decoded, stream = 0, hashlib.sha256(), hashlib.sha256(), Utf8Stream()
        named = self.named.__getitem__
        for portion in self._portions(text, words):
            joined = " ".join(portion)
            ids.update((" " + joined if n else joined).encode())
            tokens = joined.split(" ")
            n += len(tokens)
            for part, _ in stream.feed(b"".join(map(named, tokens))):
                decoded.update(part)
        decoded.update(stream.close())
        return n, ids.hexdigest(), decoded.hexdigest()


_CODECS: dict[tuple, Codec] = {}


def codec(packed: bytes, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    key = (hashlib.sha256(packed).digest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec({base64.b64decode(t): int(r) for t, r in map(bytes.split, packed.splitlines())}, pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    with open(path, "rb") as f:  # a vocabulary: its size does not depend on the data
        packed = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(packed.value, pattern)
        for part in (part for batch in batches for part in portions(batch, size=TOGETHER)):
            n, ids, decoded = zip(*own.digests(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id and its ids."""
    with open(path, "rb") as f:
        packed = docs.sparkSession.sparkContext.broadcast(f.read())

    def row(doc_id, text):
        return doc_id, codec(packed.value, pattern).encode(text)

    return arrow_map(docs.select("doc_id", "text"), "doc_id long, ids array<int>", row)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
