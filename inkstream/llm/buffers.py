"""Vectorised work on the UTF-8 bytes of Arrow text columns.

Inside a task the texts of a few rows lie end to end in one ``uint8`` array
with row offsets.  Words are runs of bytes of a class; runs are hashed by one
prefix sum over the whole array, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are worked on in pieces of about this many bytes; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash (splitmix64), elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


BYTE_VALUE = stream(1, 256)
#: ASCII capitals to small letters, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(pattern_excludes: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes outside the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for lo, hi in pattern_excludes:
        table[lo : hi + 1] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are small letters
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(n + 1, base, dtype=U64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


#: A long array's prefix sums start again after so many elements, so powers of the base are held for that many alone.
STRETCH = 1 << 21


class RunHash:
    """Hashes of any runs ``[start, end)`` of a byte array, or of an array of 64-bit values."""

    def __init__(self, buf: np.ndarray):
        step = min(len(buf), STRETCH)
        self.up, self.down = powers(step)
        self.sums = np.zeros(len(buf) + max(1, -(-len(buf) // STRETCH)), dtype=U64)
        at = 0
        with np.errstate(over="ignore"):
            for a in range(0, len(buf), STRETCH):
                part = buf[a : a + STRETCH]
                values = BYTE_VALUE[part] if part.dtype == np.uint8 else part
                np.cumsum(values * self.up[: len(part)], dtype=U64, out=self.sums[at + 1 : at + 1 + len(part)])
                at += STRETCH + 1
        self.one = len(buf) <= STRETCH

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            if self.one:
                return (self.sums[end] - self.sums[start]) * self.down[start]
            first, last = start // STRETCH, np.maximum(end - 1, start) // STRETCH
            own = start - first * STRETCH
            base = first * (STRETCH + 1)
            out = (self.sums[base + np.minimum(end - first * STRETCH, STRETCH)] - self.sums[base + own]) * self.down[own]
            far, whole = U64(1), self.up[STRETCH]
            over = np.flatnonzero(last > first)
            part = first[over] + 1
            while len(over):
                till = np.minimum(end[over] - part * STRETCH, STRETCH)
                out[over] += self.sums[part * (STRETCH + 1) + till] * self.up[STRETCH - own[over]] * far
                far = far * whole
                going = last[over] > part
                over, part = over[going], part[going] + 1
            return out

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self.raw(start, end) + (end - start).astype(U64))


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Names for further columns that no column of a table has, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and int64 row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    buf = buf[offs[0] : offs[-1]]
    return buf, offs - offs[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[a, b)`` of a text column with their bytes and offsets, about ``limit`` bytes at a time."""
    if not len(column):
        return
    buf, offs = text_arrays(column)
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def runs(buf: np.ndarray, offs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of wanted bytes; none crosses a row's end."""
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = wanted[buf]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    cut = cut[inside[cut] & inside[cut + 1]]
    starts[cut] = True
    ends[cut - 1] = True
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def counts_in(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For sorted positions, the index of the first at or after each row offset (one more than rows)."""
    return np.searchsorted(starts, offs, side="left")


def owners(first: np.ndarray) -> np.ndarray:
    """The row of each element, from the bounds that ``counts_in`` gives."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
