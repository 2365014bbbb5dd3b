"""Token ids of whole texts, through the tokenizers library.

A byte-level BPE never merges across the pieces of its pre-tokenizer, so the ids
of a text are those of its pieces in order. The pieces of a batch are cut by numpy
passes over its code points; each distinct piece is encoded by the library once
and kept in a table by a 64-bit hash, from which the ids of the batch are gathered
at once. The table is emptied when it holds ``KNOWN_PIECES`` pieces or
``KNOWN_IDS`` ids. Texts that hold the string of an added token are encoded whole,
and texts over ``PART_CHARS`` in parts that end where a piece must end.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import regex

from .bytetext import mix, powers

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Bounds of what a worker remembers, some 32 MB: two workers stand beside an executor's heap.
KNOWN_PIECES = 700_000
KNOWN_IDS = 4_000_000
#: Code points that are cut and gathered at once; a pass holds some ten longs for each.
PART_CHARS = 1 << 17

#: Unicode's white space, and the contractions of the public pattern of byte-level BPE pre-tokenizers.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")
#: Stands between pieces that are spelled together; a piece that holds it is spelled alone.
MARK = "\U0010ffff"

OTHER, LETTER, NUMBER, WHITE = range(4)
BLANK, APOSTROPHE = 0x20, 0x27
_BITS = 20
_MASK = (1 << _BITS) - 1


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _kinds() -> np.ndarray:
    """Of each code point whether it is a letter, a number, white space or another."""
    every = "".join(map(chr, range(0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, f"[{SPACE}]+")):
        for found in regex.finditer(pattern, every):
            table[found.start() : found.end()] = kind
    return table


def _weighed(points: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


@cache
def _plane() -> np.ndarray:
    return _weighed(np.arange(1 << 16))


def _weights(points: np.ndarray) -> np.ndarray:
    """A weight for each code point, from a table where all are in the first plane."""
    return _weighed(points) if points.max(initial=0) >> 16 else _plane()[points]


@cache
def _spelling() -> dict[int, str]:
    """The letter that stands for each byte: itself where it can be seen, else the next from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)}


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer's pieces begin; ``first`` has the first code point of each text."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[points]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[n] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = start.copy()
    # of white space before something else the last sign stands alone, a blank goes with what follows
    after = np.flatnonzero(run[1:] & ~edge[1:n] & (kind[:-1] == WHITE)) + 1
    start[after - 1] = True
    start[after] = points[after - 1] != BLANK
    # an apostrophe that begins a piece takes one of the endings
    quote = np.flatnonzero((points[:-1] == APOSTROPHE) & start[:-1] & ~edge[1:n] & run[1:] & (kind[1:] == LETTER))
    one = points[quote + 1]
    two = np.where(edge[quote + 2], 0, points[np.minimum(quote + 2, n - 1)])
    length = np.where(np.isin(one, [ord(c) for c in SHORT_ENDINGS]), 2, 0)
    for a, b in LONG_ENDINGS:
        length[(one == ord(a)) & (two == ord(b))] = 3
    quote, length = quote[length > 0], length[length > 0]
    start[quote + 1] = False
    rest = quote + length
    start[rest[rest < n]] = True
    return np.flatnonzero(start)


class _Known:
    """Ids by 64-bit hash: open addressing, and the ids of all pieces end to end."""

    def __init__(self):
        self.keys = np.zeros(1 << _BITS, np.uint64)
        self.first = np.zeros(1 << _BITS, np.int32)
        self.count = np.zeros(1 << _BITS, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.pieces = self.used = 0

    def clear(self) -> None:
        self.keys[:] = 0
        self.pieces = self.used = 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each hash, and whether it is there."""
        slot = (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
        key = self.keys[slot]
        there = key == hashes
        left = np.flatnonzero(~there & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & _MASK
            key = self.keys[slot[left]]
            there[left] = key == hashes[left]
            left = left[(key != hashes[left]) & (key != 0)]
        return slot, there

    def add(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New distinct hashes, their ids end to end, and how many each has."""
        total = len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = ids
        firsts = (self.used + np.cumsum(counts) - counts).astype(np.int32)
        left = np.arange(len(hashes))
        while len(left):
            slot, _ = self.find(hashes[left])
            _, winner = np.unique(slot, return_index=True)
            at, who = slot[winner], left[winner]
            self.keys[at], self.first[at], self.count[at] = hashes[who], firsts[who], counts[who]
            left = np.delete(left, winner)
        self.pieces += len(hashes)
        self.used += total


class Encoder:
    """Ids of texts."""

    def __init__(self, name: str = DEFAULT_TOKENIZER):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        kind = self.library.pre_tokenizer
        if "ByteLevel(add_prefix_space=False" not in repr(kind) or self.library.normalizer is not None:
            raise ValueError(f"{name} is not a byte-level BPE without normalizer")
        self.cut = regex.compile(r"\p{L} (?=\p{L})")
        self.spelling = _spelling()
        self.mark = MARK.encode().decode("latin-1").translate(self.spelling)
        self.known = _Known()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has. Null reads as empty."""
        parts: list[str] = []
        owner: list[int] = []
        special: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(a in text for a in self.added):
                special[i] = self.whole(text)
                continue
            some = self._parts(text)
            parts += some
            owner += [i] * len(some)
        found: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(parts):
            end, chars = at, 0
            while end < len(parts) and (end == at or chars + len(parts[end]) <= PART_CHARS):
                chars += len(parts[end])
                end += 1
            ids, n = self._together(parts[at:end])
            found.append(ids)
            np.add.at(counts, owner[at:end], n)
            at = end
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        if special:
            ends = np.cumsum(counts)
            pieces = [special.get(i, ids[ends[i] - counts[i] : ends[i]]) for i in range(len(texts))]
            ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)
        return ids, counts

    def _parts(self, text: str) -> list[str]:
        """A long text in parts that end before a blank between two letters, where a piece must begin."""
        out, at = [], 0
        while len(text) - at > PART_CHARS:
            found = self.cut.search(text, at + PART_CHARS - 1)
            if found is None:
                break
            out.append(text[at : found.start() + 1])
            at = found.start() + 1
        return [*out, text[at:]]

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        points = points_of(joined)
        first = np.cumsum(lengths) - lengths
        starts = piece_starts(points, first)
        ends = np.append(starts[1:], len(points))
        hashes = self._hashes(points, starts, ends)
        slot, there = self.known.find(hashes)
        if not there.all():
            if not self._learn(joined, starts, ends, hashes, ~there):
                ids = [self.whole(t) for t in texts]
                return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
            slot, _ = self.known.find(hashes)
        count = self.known.count[slot].astype(np.int64)
        before = np.append(0, np.cumsum(count))
        at = np.repeat(self.known.first[slot] - before[:-1], count) + np.arange(before[-1])
        bound = np.searchsorted(starts, np.append(first, len(points)))
        return self.known.ids[at], np.diff(before[bound])

    @staticmethod
    def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        power, inverse = powers(len(points) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(_weights(points) * power[: len(points)], out=sums[1:])
            out = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        out[out == 0] = 1
        return out

    def _learn(self, joined: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, new: np.ndarray) -> bool:
        """Encode the pieces that are not known; False if a batch has more pieces than the table may hold."""
        if self.known.used > KNOWN_IDS:
            self.known.clear()
            new = np.ones(len(hashes), bool)
        at = np.flatnonzero(new)
        fresh, first = np.unique(hashes[at], return_index=True)
        if self.known.pieces + len(fresh) > KNOWN_PIECES:
            self.known.clear()
            at = np.arange(len(hashes))
            fresh, first = np.unique(hashes, return_index=True)
            if len(fresh) > KNOWN_PIECES:
                return False
        at = at[first]
        self.known.add(fresh, *self._encode_pieces([joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
        return True

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's model on the bytes of each piece, which its pre-tokenizer writes as letters."""
        spelled = MARK.join(pieces).encode().decode("latin-1").translate(self.spelling).split(self.mark)
        if len(spelled) != len(pieces):
            spelled = [p.encode().decode("latin-1").translate(self.spelling) for p in pieces]
        ids: list[int] = []
        counts: list[int] = []
        tokenize = self.library.model.tokenize
        for piece in spelled:
            tokens = tokenize(piece)
            ids += [t.id for t in tokens]
            counts.append(len(tokens))
        return np.array(ids, np.uint32), np.array(counts, np.int32)


_encoders: dict[str, Encoder] = {}


def encoder(name: str = DEFAULT_TOKENIZER) -> Encoder:
    """One per worker and vocabulary."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
