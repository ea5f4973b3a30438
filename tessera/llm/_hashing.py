"""Vectorised hashing of words and word windows for the Arrow-backed operators.

Everything works on one byte buffer holding many texts, so the cost is a few numpy passes
per word and nothing per row. Words are hashed eight bytes at a time, each step mixing all
bits, so no pattern of bytes cancels out; there are two lanes with nothing in common, for
hashes of 128 bits. Hashes are pure functions of the bytes: no process state, so a task that
is run again after a lost executor gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Start and multiplier of each lane.
_LANES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0x243F6A8885A308D3, 0x9FB21C651E98DF25))
#: Longer words, of bytes, are hashed one by one.
_LONG = 64
_WORD_MULTS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers_cache: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(mult: int, n: int) -> np.ndarray:
    """mult ** 0..n-1 modulo 2**64; grown on demand and kept for the worker's life."""
    have = _powers_cache.get(mult)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), mult, dtype=U64)
        out[0] = 1
        have = _powers_cache[mult] = np.cumprod(out, dtype=U64)
    return have[:n]


def _ranges(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, mult: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of codes[s:e] for all ranges, by one prefix sum."""
    inverse = pow(mult, -1, 1 << 64)
    sums = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(codes * powers(inverse, len(codes)), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(mult, len(codes) + 1)[starts]


class Words:
    """The words of several texts: maximal runs of bytes that are no ASCII white space.

    ``starts``/``ends`` are byte places in ``buf``; ``counts`` has the words of each text;
    ``first`` has the index of each text's first word (with a closing entry).
    """

    def __init__(self, blobs: Sequence[bytes | None], lower: bool = False) -> None:
        parts = [b"" if b is None else b for b in blobs]
        joined = b" ".join(parts) + b" "
        self.data = joined.lower() if lower else joined
        self.buf = np.frombuffer(self.data, dtype=np.uint8)
        blank = _SPACES[self.buf]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(self.buf) and not blank[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        limits = np.cumsum(lengths + 1)
        self.first = np.concatenate([[0], np.searchsorted(self.starts, limits)]).astype(np.int64)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A hash of each word; lanes 0 and 1 are independent."""
        start, mult = (U64(x) for x in _LANES[lane])
        size = self.ends - self.starts
        out = mix(size.astype(U64) * mult + start)
        # the eight bytes from any place on, as one number
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(padded) - 7,), (1,))
        at = np.flatnonzero(size <= _LONG)
        for k in range(0, _LONG, 8):
            at = at[size[at] > k]
            if not len(at):
                break
            rest = np.minimum(size[at] - k, 8).astype(U64) * U64(8)
            chunk = eight[self.starts[at] + k] & (U64(2**64 - 1) >> (U64(64) - rest))
            out[at] = mix((out[at] ^ chunk) * mult + start)
        if (long := np.flatnonzero(size > _LONG)).size:
            import xxhash

            for i in long.tolist():
                both = xxhash.xxh3_128_digest(self.data[self.starts[i] : self.ends[i]])
                out[i] = int.from_bytes(both[8 * lane : 8 * lane + 8], "little")
        return out


def window_hashes(words: np.ndarray, starts: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
    """Hash of the ``size`` words from each start; ``words`` are the hashes of the lane of that kind."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    return mix(_ranges(words, starts, starts + size, _WORD_MULTS[kind]))


def window_starts(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (over all words) of the windows that lie within one text, and their places in it."""
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = np.maximum(counts - size + 1, 0)
    total = int(n.sum())
    inside = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + inside, inside


def slices(blobs: Sequence[bytes | None], limit: int) -> Iterator[slice]:
    """Consecutive slices of about ``limit`` bytes of text; a longer text stands alone."""
    begin = size = 0
    for i, b in enumerate(blobs):
        n = len(b) if b else 0
        if i > begin and size + n > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(blobs):
        yield slice(begin, len(blobs))
