"""Vectorised text primitives over Arrow string arrays.

Everything here works on the raw UTF-8 buffer of a whole batch with numpy, so
a word costs tens of nanoseconds instead of a Python object.  Words are the
maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; as those bytes never
occur inside a multi-byte character this equals the character-level rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Odd multipliers of the byte and word polynomials, one per hash function.
BYTE_MUL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORD_MUL = (0xBF58476D1CE4E5BD, 0x94D049BB133111E5)
#: A batch is worked on in pieces of about so many bytes of text.
PIECE_BYTES = 1 << 20


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls read as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES):
    """Ranges (first, last) of rows of about ``limit`` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the row of each; a row's end ends a word."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    space = SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0] = True
    before[1:] = space[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    before[edges] = True
    after = np.empty(len(raw), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[edges - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, ends, rows


_POWERS: dict[int, np.ndarray] = {}


def powers(mul: int, n: int) -> np.ndarray:
    """The first n powers; a worker keeps those up to PIECE_BYTES."""
    known = _POWERS.get(mul, ())
    if n <= len(known):
        return known[:n]
    out = np.full(n, mul, dtype=U64)
    if n:
        out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= PIECE_BYTES + 1:
        out.flags.writeable = False
        _POWERS[mul] = out
    return out


def inverse(mul: int) -> int:
    return pow(mul, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, mul: int) -> np.ndarray:
    """64-bit polynomial hashes of ``values[start:end]`` for all spans, through one prefix sum."""
    prefix = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(mul, len(values)), out=prefix[1:])
    back = powers(inverse(mul), len(values) + 1)
    h = (prefix[ends] - prefix[starts]) * back[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return span_hashes(raw, starts, ends, BYTE_MUL[which])


def window_hashes(words: np.ndarray, firsts: np.ndarray, n, which: int = 0) -> np.ndarray:
    """Hashes of the ``n`` words from each of ``firsts`` on (``n``: one number or one per window)."""
    return span_hashes(words, firsts, firsts + n, WORD_MUL[which])


def row_bounds(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets of each row's words: row i has words bounds[i]:bounds[i+1]."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def window_starts(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``n`` words inside one row, and their rows."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return bounds[rows] + at, rows


def cuts(part: np.ndarray, limit: int) -> list[int]:
    """Places that cut a text into runs of whole words of about ``limit`` bytes; a longer word stays whole."""
    out, at = [0], limit
    while at < len(part):
        space = np.flatnonzero(SPACE[part[at : at + limit]])
        if len(space):
            out.append(at + int(space[0]))
        at = (out[-1] if len(space) else at) + limit
    return [*out, len(part)]


def hashed_words(raw: np.ndarray, offsets: np.ndarray, n_hashes: int = 1, lower: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """(``n_hashes`` hashes of every word, offsets of each row's words) of a whole batch, piece by piece, and a very long text run by run."""
    found: list[list[np.ndarray]] = [[np.zeros(0, U64)] for _ in range(n_hashes)]
    counts = [np.zeros(1, np.int64)]

    def add(part: np.ndarray, inner: np.ndarray) -> np.ndarray:
        starts, ends, rows = word_spans(part, inner)
        text = LOWER[part] if lower else part
        for i in range(n_hashes):
            found[i].append(word_hashes(text, starts, ends, i))
        return np.bincount(rows, minlength=len(inner) - 1)

    for a, b in pieces(offsets):
        part, inner = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if b - a == 1 and len(part) > PIECE_BYTES:
            at = cuts(part, PIECE_BYTES)
            runs = [part[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
            counts.append(sum(add(run, np.array([0, len(run)])) for run in runs))
        else:
            counts.append(add(part, inner))
    return [np.concatenate(f) for f in found], np.cumsum(np.concatenate(counts))
