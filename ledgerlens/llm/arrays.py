"""Vectorised text helpers used inside Arrow tasks: byte buffers, word hashes, shingles."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once inside a task; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words split on ASCII white space: every byte but 0x20 and 0x09-0x0D belongs to a word.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words of letters, digits and all bytes beyond ASCII.
ALNUM = np.ones(256, bool)
ALNUM[:48] = ALNUM[58:97] = ALNUM[123:128] = False
ALNUM[65:91] = True  # read as a-z


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (first, last+1) of a column of about CHUNK_BYTES each, with their bytes and offsets."""
    raw, off = buffers(column)
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + CHUNK_BYTES, "right")) - 1)
        yield first, last, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def words(raw: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each lower-cased (A-Z) word, its first byte, and the n+1 offsets of rows in words.

    ``member`` says which bytes belong to words. Words never cross rows."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = member[raw]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    edge = off[(off > 0) & (off < n)]
    before[edge] = False
    after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[raw]] * _power(_BASE, n), out=total[1:])
    code = (total[ends] - total[starts]) * _power(_INVERSE, n)[starts]
    return mix(code + (ends - starts).astype(np.uint64)), starts, np.searchsorted(starts, off)


def span_hashes(raw: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [first, past) of each span, as they are."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), out=total[1:])
    return mix((total[past] - total[first]) * _power(_INVERSE, len(raw) + 1)[first] + (past - first).astype(np.uint64))


_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingles(code: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; a row of fewer words is one shingle of all of them."""
    n = len(code)
    whole = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        whole += code[j : n - k + 1 + j] * _PLACE[j] if n >= k else 0
    whole = mix(whole)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            s = np.sort(whole[a : b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield mix(np.atleast_1d((code[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + U64(b - a)))
        else:
            yield np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def release() -> None:
    """Gives memory that Arrow and the allocator keep for later back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, ending with ``release``: workers live on from task to task, so what one task took would stay beside the next one's."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


class Seen:
    """Digests that a task has met, at most ``most`` at once: a text that a task holds a thousand times is worked on once.

    What is met again after the set was emptied is worked on again, so callers drop repeats later."""

    def __init__(self, most: int = 200_000):
        self.most, self.have = most, set()

    def new(self, keys: list[bytes]) -> list[int]:
        """Places of the keys that were not met before."""
        if len(self.have) > self.most:
            self.have.clear()
        out = []
        for i, key in enumerate(keys):
            if key not in self.have:
                self.have.add(key)
                out.append(i)
        return out


class Filter:
    """A set of digests as a bit array of at most 2**LOG bits: says yes to all that are in it, and to few others while it is sparse.

    Its size is bounded whatever it holds; beyond some ten million digests it lets more and more through, and what reads it
    must check again."""

    LOG = 27

    def __init__(self, words: np.ndarray, bits: np.ndarray):
        self.words = np.zeros(1 << (self.LOG - 6), np.uint64)
        self.words[words] = bits

    @classmethod
    def places(cls, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word and bit of each digest, of which the first eight bytes are read."""
        x = np.frombuffer(b"".join([k[:8] for k in keys]), "<u8") >> U64(64 - cls.LOG)
        return (x >> U64(6)).astype(np.int64), U64(1) << (x & U64(63))

    def has(self, keys: list[bytes]) -> np.ndarray:
        at, bit = self.places(keys)
        return (self.words[at] & bit) != 0
