"""Vectorised text primitives over UTF-8 bytes of an Arrow batch.

Words are maximal runs outside ``\\x20\\x09-\\x0D`` and lines are split at ``\\n``.
Words, windows and lines are identified by 64-bit polynomial hashes taken from
prefix sums, so a batch costs a fixed number of numpy passes and no loop over
characters. Two different strings of one comparison share a hash with a chance
of about 2**-64 per pair compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 4096
#: The powers of shorter strings fill tables of this size.
SHORT = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240613)
_CASED = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _CASED.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _CASED[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """The powers of the base of polynomial hashes and of its inverse, n at least."""
    if len(_powers[0]) < n:
        size = next((s for s in (SHORT + 1, CHUNK_BYTES + 1) if n <= s), n)
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Text:
    """The texts of a batch: bytes end to end, and where each text begins. Null reads as empty."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.data = (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = len(column)
        self._sums: dict[int, np.ndarray] = {}

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each word; a word never runs across texts."""
        return self._runs(~_SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end and text number of each line; n newlines make n + 1 lines."""
        newline = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], newline + 1]), kind="stable")
        ends = np.sort(np.concatenate([newline, self.offsets[1:]]), kind="stable")
        own = np.repeat(np.arange(self.n), 1 + self.between(newline))
        return starts, ends, own

    def _runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        first, last = inside.copy(), inside.copy()
        if len(inside):
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last[:-1] &= ~inside[1:] | edge[1:-1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def between(self, positions: np.ndarray) -> np.ndarray:
        """How many of these sorted byte positions lie in each text."""
        return np.diff(np.searchsorted(positions, self.offsets))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each byte span; with fold, A-Z count as a-z."""
        with np.errstate(over="ignore"):
            power, inverse = powers(len(self.data) + 1)
            if fold not in self._sums:
                sums = np.zeros(len(self.data) + 1, np.uint64)
                np.cumsum((_FOLDED if fold else _CASED)[self.data] * power[: len(self.data)], out=sums[1:])
                self._sums[fold] = sums
            sums = self._sums[fold]
            return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP[15])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` neighbours, in order; texts are not told apart."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out += hashes[i : i + n] * _STEP[i]
    return mix(out ^ np.uint64(size))


def inner(counts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of the ``total - size + 1`` windows lie within one text, given its number of words."""
    n = max(0, total - size + 1)
    ok = np.ones(n + size, bool)
    ends = np.cumsum(counts)
    for back in range(1, size):
        at = ends - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok[:n]


def shingles(text: Text, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct case-folded word shingles of each text, ascending, and how many each has.

    A text with fewer than ``size`` words has its whole sequence as its one
    shingle, and none when it has no word.
    """
    starts, ends = text.words()
    counts = text.between(starts)
    hashed = text.hashes(starts, ends, fold=True)
    keep = inner(counts, size, len(hashed))
    found = windows(hashed, size)[keep]
    own = np.repeat(np.arange(text.n), np.maximum(counts - size + 1, 0))
    first = np.cumsum(counts) - counts
    short = [found]
    owners = [own]
    for length in range(1, size):
        at = np.flatnonzero(counts == length)
        if len(at):
            short.append(windows(hashed, length)[first[at]])
            owners.append(at)
    found, own = np.concatenate(short), np.concatenate(owners)
    order = np.lexsort((found, own))
    found, own = found[order], own[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (own[1:] != own[:-1])
    found, own = found[fresh], own[fresh]
    return found, np.bincount(own, minlength=text.n)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text and at most ``rows`` rows each, so memory does not follow the batch."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // limit + np.arange(batch.num_rows) // rows * (int(sizes.sum()) // limit + 2)
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def array_chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[pa.Array]:
    """As ``chunks``, for a single column."""
    for part in chunks(pa.RecordBatch.from_arrays([column], ["text"]), "text", limit, rows):
        yield part.column(0)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from its values end to end and its lengths."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
