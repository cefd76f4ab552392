"""Vectorised hashing of texts that lie one after another in an Arrow string buffer.

Words (or lines) are found and hashed for many documents at once with numpy: a polynomial
prefix sum over the bytes gives the hash of any byte range as one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MULT = 0xD1342543DE82EF95
_INVERSE = pow(_MULT, -1, 1 << 64)
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _M1
        x = (x ^ (x >> U64(27))) * _M2
        return x ^ (x >> U64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """A hash of 64-bit values, another one for each salt."""
    return mix(x ^ mix(np.full(1, salt, U64) + _BASE))


class _Powers:
    """Growing tables of powers of one odd multiplier and of its inverse modulo 2**64."""

    def __init__(self, multiplier: int):
        self.multiplier, self.size = multiplier, 0
        self.inverse = pow(multiplier, -1, 1 << 64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            tables = []
            for m in (self.multiplier, self.inverse):
                table = np.full(size, m, U64)
                table[0] = 1
                with np.errstate(over="ignore"):
                    tables.append(np.multiply.accumulate(table))
            self.size, self.up, self.down = size, *tables
        return self.up[:n], self.down[:n]


_POWERS, _ORDER_POWERS = _Powers(_MULT), _Powers(0xA0761D6478BD642F)
_RANDOM = mix(np.arange(1, 257, dtype=U64) * _BASE)

_byte = np.arange(256)
_upper = (_byte >= 65) & (_byte <= 90)
#: Bytes that part words: ASCII white space; or all of ASCII but letters and digits; or the line feed.
SPACES = np.isin(_byte, [9, 10, 11, 12, 13, 32])
NOT_WORD = (_byte < 128) & ~(_upper | ((_byte >= 97) & (_byte <= 122)) | ((_byte >= 48) & (_byte <= 57)))
NEWLINE = _byte == 10
EXACT, FOLDED = _RANDOM, np.where(_upper, _RANDOM[(_byte + 32) % 256], _RANDOM)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows, without a copy; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together hold about ``limit`` bytes; a longer row comes alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def tokens(data: np.ndarray, at: np.ndarray, parts: np.ndarray = SPACES, table: np.ndarray = EXACT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes in ``data``) of each token of the rows ``at``, and where each row's tokens begin (n + 1)."""
    low, high = int(at[0]), int(at[-1])
    a = data[low:high]
    n = len(a)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, np.zeros(len(at), np.int64)
    inside = ~parts[a]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    rows = at[1:-1] - low
    rows = rows[(rows > 0) & (rows < n)]
    first[rows] = inside[rows]
    last[rows - 1] = inside[rows - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, _ = _POWERS.upto(n)
    down = _POWERS.down
    with np.errstate(over="ignore"):
        prefix = np.empty(n + 1, U64)
        prefix[0] = 0
        np.cumsum(table[a] * up, out=prefix[1:])
        h = mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))
    return h, starts + low, ends + low, np.searchsorted(starts, at - low)


def rolling(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """The hash of each run of ``n`` values of ``h`` (empty when there are fewer)."""
    if len(h) < n:
        return np.zeros(0, U64)
    up, _ = _ORDER_POWERS.upto(len(h) + 1)
    down = _ORDER_POWERS.down
    with np.errstate(over="ignore"):
        prefix = np.empty(len(h) + 1, U64)
        prefix[0] = 0
        np.cumsum((salted(h, salt) if salt else h) * up[: len(h)], out=prefix[1:])
        return mix((prefix[n:] - prefix[:-n]) * down[: len(h) - n + 1] + U64(n))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
