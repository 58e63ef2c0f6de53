"""Words, n-grams and their hashes over many texts at once, in NumPy arrays of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are laid out at a time; a longer text is laid out alone.
CHUNK = 1 << 20
#: A random value for each byte and the base of the polynomial: any fixed odd numbers do, as long as all tasks agree.
_RANDOM = np.random.default_rng(20240229)
BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of a word up to which a polynomial hashes it; modulo a power of two, long words can be made to clash.
LONG_WORD = 24
#: Space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of texts; text i of a run is bytes[bounds[i]:bounds[i + 1]]. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    known = 1
    while known < n:  # doubling: the second half is the first one times base ** known
        take = min(known, n - known)
        out[known : known + take] = out[:take] * np.uint64(pow(base, known, 1 << 64))
        known += take
    return out


class Powers:
    """Powers of the base and of its inverse, grown as longer buffers come."""

    def __init__(self) -> None:
        self.up, self.down = powers(BASE, 2), powers(INVERSE, 2)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)
        return self.up, self.down


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of h stirred, so that low ones depend on high ones."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


def prefix_sums(data: np.ndarray, power: Powers, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """sums[i]: the polynomial of data[:i]."""
    up, _ = power(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, power: Powers) -> np.ndarray:
    """Hashes of data[start:end], which depend on their content alone."""
    _, down = power(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


#: A prime modulus beside the power of two: strings that clash modulo all powers of two, whatever the base, don't modulo this.
PRIME, PRIME_BASE = (1 << 31) - 1, 1_103_515_245
PRIME_INVERSE = pow(PRIME_BASE, -1, PRIME)


def prime_powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, modulo PRIME."""
    out = np.ones(n, np.uint64)
    known = 1
    while known < n:
        take = min(known, n - known)
        out[known : known + take] = out[:take] * np.uint64(pow(base, known, PRIME)) % np.uint64(PRIME)
        known += take
    return out


class PrimeHashes:
    """Hashes below PRIME of any stretches of buffers of bytes; powers are grown as longer buffers come."""

    def __init__(self) -> None:
        self.up, self.down = prime_powers(PRIME_BASE, 2), prime_powers(PRIME_INVERSE, 2)
        self.sums = np.zeros(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        if len(self.up) <= len(data):
            self.up, self.down = prime_powers(PRIME_BASE, len(data) + 1), prime_powers(PRIME_INVERSE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)  # of terms below 2 ** 39, added up by pieces that stay below 2 ** 64
        for at in range(0, len(data), 1 << 20):
            some = slice(at, min(at + (1 << 20), len(data)))
            np.cumsum((data[some].astype(np.uint64) + np.uint64(1)) * self.up[some], out=self.sums[at + 1 : some.stop + 1])
            self.sums[at + 1 : some.stop + 1] = (self.sums[at + 1 : some.stop + 1] + self.sums[at]) % np.uint64(PRIME)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p = np.uint64(PRIME)
        return (self.sums[ends] + p - self.sums[starts]) % p * self.down[starts] % p


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the runs of bytes that aren't white space; no word crosses the bounds of a text."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = IS_SPACE[data]
    starts = np.flatnonzero(~gap[:-1] & np.concatenate([[True], gap[:-2]])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[~gap[cut] & ~gap[cut - 1]])
    if len(cut):  # two texts meet without white space between them
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, power: Powers) -> np.ndarray:
    """A hash of each word data[start:end]: its polynomial, of long words xxh3."""
    length = ends - starts
    out = mixed(span_hashes(prefix_sums(data, power), starts, ends, power) + length.astype(np.uint64) * np.uint64(BASE))
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out
