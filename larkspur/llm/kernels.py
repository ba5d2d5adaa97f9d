"""Vectorised byte and word kernels used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 1 << 18

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is neither letter nor digit; bytes of other scripts count as letters.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * SLICE_BYTES)
        down = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", down)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.cumprod(table)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at.astype(np.int64)


def folded_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column, the same bytes in lower case, and the offsets that both have.

    A text whose lower case has another length in bytes counts as lower case throughout.
    """
    column = pc.fill_null(column, "")
    low = pc.utf8_lower(column)
    same = pc.equal(pc.binary_length(column), pc.binary_length(low))
    if not pc.all(same, min_count=0).as_py():
        column = pc.if_else(same, column, low)
    data, offsets = text_bytes(column)
    folded, at = text_bytes(low)
    return data[offsets[0] : offsets[-1]], folded[at[0] : at[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, first_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts (or of their first bytes), ASCII case folded, and each text's range of them.

    `data` holds the bytes from offsets[0] to offsets[-1]; words never cross texts.
    """
    offsets = offsets - offsets[0]
    gap = separators[data]
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    start = ~gap
    start[1:] &= gap[:-1] | first[1:]
    stop = ~gap
    stop[:-1] &= gap[1:] | first[1:]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    if first_bytes:
        stops = np.minimum(stops, starts + first_bytes)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = (total[stops] - total[starts]) * down[starts]
        h = mix(h + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` words.

    A text of fewer words has one, its whole sequence; a text without words has none.
    """
    out = []
    with np.errstate(over="ignore"):
        if len(h) >= size:
            m = len(h) - size + 1
            rolled = np.zeros(m, np.uint64)
            for i in range(size):
                rolled = mix(rolled * np.uint64(31) + h[i : m + i])
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= size:
                out.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                one = np.array([b - a], np.uint64)
                for i in range(a, b):
                    one = mix(one * np.uint64(33) + h[i : i + 1] + np.uint64(7))
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def code_points(texts: list[str]) -> np.ndarray:
    """Code points of some texts, one after another."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def per_character(codes: np.ndarray, value, dtype) -> np.ndarray:
    """value(character) for each code point, worked out once for each character that occurs."""
    occurs = np.flatnonzero(np.bincount(codes)) if len(codes) else np.zeros(0, np.int64)
    table = np.zeros(int(occurs[-1]) + 1 if len(occurs) else 1, dtype)
    table[occurs] = [value(chr(c)) for c in occurs.tolist()]
    return table[codes]


def sums(codes: np.ndarray) -> np.ndarray:
    """Running sums from which `spans` takes the hash of any stretch."""
    total = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes) + 1)[0][: len(codes)], out=total[1:])
    return total


def spans(total: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of stretches of what `sums` was made of; equal content has equal hashes."""
    with np.errstate(over="ignore"):
        return mix((total[stops] - total[starts]) * powers(len(total))[1][starts] + (stops - starts).astype(np.uint64))


class HashIndex:
    """Positions of hashes in a list, found through a table of their upper bits."""

    def __init__(self, h: np.ndarray):
        self.order = np.argsort(h, kind="stable")
        h = h[self.order]
        bits = max(4, int(len(h)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(h >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)
        self.deep = int(np.diff(self.first).max()) if len(h) else 0
        self.h = np.concatenate([h, np.zeros(self.deep, np.uint64)])
        self.n = len(h)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Position of each hash, -1 if it is not there."""
        at = self.first[(q >> self.shift).astype(np.int64)]
        out = np.full(len(q), -1)
        for c in range(self.deep):
            hit = np.flatnonzero((self.h[at + c] == q) & (at + c < self.n))
            out[hit] = self.order[at[hit] + c]
        return out
