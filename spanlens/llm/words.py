"""Vectorised word tables: word boundaries and 64-bit word hashes of many texts at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D in UTF-8, which is the regular expression
``[^\\x20\\x09-\\x0D]+`` on code points. A word's hash is a polynomial over random byte values modulo 2**64,
read off prefix sums, so no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK = 1 << 18
SLICE = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**64 - 1, size=(2, 256), dtype=U)
#: 5 modulo 8: powers of such a number differ in all but their lowest bits.
FACTOR = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED0D)


_LIBC: list = []


def trim() -> None:
    """Gives free memory back to the system: a Python worker outlives its tasks, and others need the room.

    From the first call on, the worker's arrays over 1 MB go back as soon as they are freed."""
    pa.default_memory_pool().release_unused()
    if not _LIBC:
        try:
            _LIBC.append(ctypes.CDLL("libc.so.6"))
            _LIBC[0].mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        except OSError:
            _LIBC.append(None)
    if _LIBC[0] is not None:
        _LIBC[0].malloc_trim(0)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    done = 1
    while done < n:
        step = U(pow(base, done, 2**64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


_POW: dict[tuple, np.ndarray] = {}


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """The first n powers of a factor, or of its inverse modulo 2**64."""
    have = _POW.get((which, inverse))
    if have is None or len(have) < n:
        base = FACTOR[which]
        have = _POW[which, inverse] = _powers(pow(base, -1, 2**64) if inverse else base, max(n, 2 * BLOCK))
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    return h


def spans_of(raw: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    word = np.empty(len(raw) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(space[raw], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of byte spans; computed over blocks so that memory stays small for a text of any length."""
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        lo = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = int(ends[b - 1])
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(BYTE[which][raw[lo:hi]] * powers(hi - lo, which), out=total[1:])
        s = starts[a:b] - lo
        out[a:b] = mix((total[ends[a:b] - lo] - total[s]) * powers(hi - lo + 1, which, True)[s])
        a = b
    return out


def hash_windows(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.empty(n, U)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        total = np.zeros(b - a + size, U)
        np.cumsum(h[a : b + size - 1] * powers(b - a + size - 1, which), out=total[1:])
        out[a:b] = mix((total[size:] - total[:-size]) * powers(b - a, which, True))
    return out


def lookup(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Positions of ``key`` in the sorted ``keys``; -1 where it isn't."""
    if not len(keys):
        return np.full(len(key), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, at, -1)


#: Polynomials modulo a prime: their collisions have nothing to do with those modulo 2**64.
PRIME = 2**31 - 1
PRIME_BYTE = np.random.Generator(np.random.PCG64(17)).integers(1, PRIME, size=256, dtype=U)
PRIME_FACTOR = (1_103_515_245, 1_664_525_077 % PRIME)


def _prime_powers(n: int, which: int, inverse: bool) -> np.ndarray:
    have = _POW.get((which, inverse, PRIME))
    if have is None or len(have) < n:
        base = pow(PRIME_FACTOR[which], -1, PRIME) if inverse else PRIME_FACTOR[which]
        have, done = np.ones(max(n, 2 * BLOCK), U), 1
        while done < len(have):
            take = min(done, len(have) - done)
            have[done : done + take] = have[:take] * U(pow(base, done, PRIME)) % U(PRIME)
            done += take
        _POW[which, inverse, PRIME] = have
    return have[:n]


def _prime_sums(values: np.ndarray, which: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * _prime_powers(len(values), which, False) % U(PRIME), out=total[1:])
    return total


def prime_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """31-bit hashes of byte spans modulo a prime."""
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        lo = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = int(ends[b - 1])
        total = _prime_sums(PRIME_BYTE[raw[lo:hi]], 0)
        s = starts[a:b] - lo
        out[a:b] = (total[ends[a:b] - lo] - total[s]) % U(PRIME) * _prime_powers(hi - lo + 1, 0, True)[s] % U(PRIME)
        a = b
    return out


def prime_windows(h: np.ndarray, size: int) -> np.ndarray:
    """31-bit hashes of all runs of ``size`` consecutive hashes below the prime."""
    n = max(0, len(h) - size + 1)
    out = np.empty(n, U)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        total = _prime_sums(h[a : b + size - 1] + U(1), 1)
        out[a:b] = (total[size:] - total[:-size]) % U(PRIME) * _prime_powers(b - a, 1, True) % U(PRIME)
    return out


class Words:
    """Words of several texts. ``doc[i]`` is the text that word i is in, ``first[d]:first[d + 1]`` are the words of text d."""

    def __init__(self, texts: list[bytes | None], lower: bool = False, space: np.ndarray = SPACE):
        parts = [t or b"" for t in texts]
        self.raw = np.frombuffer(b"\n".join(parts), np.uint8)
        if lower:
            self.raw = LOWER[self.raw]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.offset = np.concatenate([[0], np.cumsum(size)])
        self.starts, self.ends = spans_of(self.raw, space)
        self.first = np.searchsorted(self.starts, self.offset)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(parts), dtype=np.int32), self.n)

    def hashes(self, which: int = 0) -> np.ndarray:
        return hash_spans(self.raw, self.starts, self.ends, which)

    def windows(self, h: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of windows that lie in one text, and the words where they start."""
        w = hash_windows(h, size, which)
        inside = self.doc[: len(w)] == self.doc[size - 1 :] if len(w) else np.empty(0, bool)
        at = np.flatnonzero(inside)
        return w[at], at


def pack(e: np.ndarray) -> bytes:
    """Sorted numbers as the width of a difference in bytes, and their differences."""
    d = np.diff(e, prepend=U(0))
    width = max(1, -(-int(d.max(initial=0)).bit_length() // 8))
    return bytes([width]) + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(n: int, data: bytes) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(data, np.uint8, n * data[0], 1).reshape(n, data[0])
    return np.cumsum(out.view("<u8").ravel(), dtype=U)


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = SLICE, text: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text; one longer text is a slice of its own."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column("text") if text is None else text), 0), np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(total, total[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
    trim()
