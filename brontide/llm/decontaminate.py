"""Benchmark decontamination by q-gram lemma filtering.

A text region that is within ``k`` edits of an item of ``m`` characters shares at
least ``m + 1 - q - k*q`` of its q-grams, and they lie on diagonals no more than
``k`` apart.  All positions of a document whose q-gram occurs in an item are
found through a bitmap and a sorted table; hits are counted per item in
overlapping bands of diagonals (width 2(k+1), step k+1, so any k+1 consecutive diagonals
lie in one band); bands with enough hits are verified by banded alignment, which
gives the least number of edits of the whole item against any region there.

Texts are compared after lower-casing A-Z and replacing each run of white space
by one space, byte by byte.  The edit budget is RATE of an item's bytes; an item's q is the largest
allowed for which the lemma still asks for LEAST shared q-grams.

The benchmark is the query set: it is collected only in blocks of BLOCK_CHARS
characters, and each block is one pass over the documents; with more than one block, each pass is written before
the next begins, so one block is held at a time.  One pass needs no shuffle: a document with its hits stays in its row.
Hits are made in parts of about PART at most: where a text and a block have more (a phrase of many items, a text of
one repeated phrase), item by item, and then in overlapping pieces of the text.

Defined cases: null or empty documents and items, and items of under 4 bytes,
match nothing; short items get fewer edits, so that the lemma still asks for one q-gram; equal items are all
reported; of equally near regions of a document the one that ends first counts; repeated documents, and those of a null or repeated doc_id, are each reported; a very
long text is searched whole; columns of other names are not read (``without_leaks`` keeps them); an empty benchmark finds nothing, an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brontide.llm import textops as T
from brontide.llm.shared import materialize, table

RATE = 0.07
Q_SIZES = (12, 8)
LEAST = 8
BLOCK_CHARS = 4 << 20
BITMAP_BITS = 22
PIECE_BYTES = 2 << 20
#: Most hits that are held at a time, but for a text piece of four times an item's length.
PART = 1 << 20
#: Stands beyond a text's ends; no UTF-8 text has it.
BEYOND = 0xFF


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, place of each byte in ``raw``) with lower case and single spaces."""
    space = T.SPACE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[(offsets > 0) & (offsets < len(raw))]] = True
    text = T.LOWER[raw]
    text[space] = 0x20
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return text[keep], total[offsets], np.flatnonzero(keep)


def gram_keys(text: np.ndarray, q: int) -> np.ndarray:
    """64-bit keys of all q-grams (q a multiple of 4): eight bytes make a word, words are mixed."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, T.U64)
    two = text[:-1].astype(T.U64) | text[1:].astype(T.U64) << T.U64(8)
    four = two[:-2] | two[2:] << T.U64(16)
    h = four[:n] * T.U64(0x9E3779B97F4A7C15)
    for at in range(4, q, 4):
        h = (h ^ h >> T.U64(29)) * T.U64(0xBF58476D1CE4E5B9) + four[at : at + n] * T.U64(0x94D049BB133111EB)
    return h ^ h >> T.U64(32)


def budget(m: int, rate: float = RATE) -> tuple[int, int, int]:
    """(edits, q, q-grams that a region within the edits must share) for an item of m characters."""
    k = int(rate * m)
    for q in Q_SIZES:
        need = m + 1 - q - k * q
        if need >= LEAST:
            return k, q, need
    q = Q_SIZES[-1] if m >= Q_SIZES[-1] else 4
    k = min(k, max(0, (m - q) // q))
    return k, q, max(1, m + 1 - q - k * q)


class Items:
    """A block of benchmark items with their q-gram tables."""

    def __init__(self, ids: list[int], texts: list[str], rate: float = RATE):
        raw, offsets = T.string_buffers(pa.array(texts, pa.string()))
        text, offsets, _ = normalise(raw, offsets)
        self.ids = ids
        self.texts = [text[a:b].tobytes().strip(b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.budgets = [budget(len(t), rate) for t in self.texts]
        self.tables = {}
        for q in sorted({b[1] for b, t in zip(self.budgets, self.texts, strict=True) if t}):
            keys, items, places = [], [], []
            for i, (t, b) in enumerate(zip(self.texts, self.budgets, strict=True)):
                if t and b[1] == q and len(t) >= q:
                    k = gram_keys(np.frombuffer(t, np.uint8), q)
                    keys.append(k)
                    items.append(np.full(len(k), i))
                    places.append(np.arange(len(k)))
            if keys:
                keys, items, places = np.concatenate(keys), np.concatenate(items), np.concatenate(places)
                order = np.argsort(keys, kind="stable")
                bitmap = np.zeros(1 << BITMAP_BITS, bool)
                bitmap[keys & T.U64((1 << BITMAP_BITS) - 1)] = True
                self.tables[q] = keys[order], items[order], places[order], bitmap

    def hits(self, text: np.ndarray, q: int):
        """(place in the text, item, place in the item) of shared q-grams, in parts that each have all hits of some items in some text."""
        keys, items, places, bitmap = self.tables[q]
        found = gram_keys(text, q)
        at = np.flatnonzero(bitmap[found & T.U64((1 << BITMAP_BITS) - 1)])
        found = found[at]
        lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
        at, found, lo, n = at[hi > lo], found[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if n.sum() <= PART:
            yield expanded(at, lo, n, items, places)
            return
        for item in np.unique(items):
            own = np.flatnonzero(items == item)
            low, high = np.searchsorted(keys[own], found, "left"), np.searchsorted(keys[own], found, "right")
            here = high > low
            at_i, low, n = at[here], low[here], (high - low)[here]
            # A region and its q-grams span less than ``overlap`` bytes, so they lie in one piece whole.
            overlap = 2 * len(self.texts[item])
            step = max(overlap, PART // max(1, int(n.max(initial=1))) - overlap)
            first = 0
            while first < len(at_i):
                begin = at_i[first]
                part = slice(first, int(np.searchsorted(at_i, begin + step + overlap)))
                yield expanded(at_i[part], low[part], n[part], items[own], places[own])
                first = int(np.searchsorted(at_i, begin + step)) if part.stop < len(at_i) else len(at_i)


def expanded(at: np.ndarray, lo: np.ndarray, n: np.ndarray, items: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n), items[which], places[which]


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least edits of the whole item, its diagonal at the end) within a band of diagonals, for each window.

    Row i of the programme has the cells of item byte i on the band's W diagonals; on diagonal t it meets
    byte i + t of the window, which is len(item) + W - 1 long.  Alignments begin and end on any diagonal.
    """
    width = windows.shape[1] - len(item) + 1
    row = np.zeros((len(windows), width), np.int32)
    steps = np.arange(width, dtype=np.int32)
    for i, c in enumerate(item):
        new = row + (windows[:, i : i + width] != c)
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])  # an item byte that the window lacks
        new -= steps
        np.minimum.accumulate(new, axis=1, out=new)  # window bytes that the item lacks
        new += steps
        row = new
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end


def window(text: np.ndarray, base: int, size: int, first: int, last: int) -> np.ndarray:
    """``text[base : base + size]``, with BEYOND where that leaves text[first:last]."""
    out = np.full(size, BEYOND, np.uint8)
    a, b = max(base, first), min(base + size, last)
    if a < b:
        out[a - base : b - base] = text[a:b]
    return out


def candidates(items: Items, q: int, at: np.ndarray, item: np.ndarray, inner: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(row, item, band) with as many shared q-grams as the lemma asks for."""
    row = np.searchsorted(starts, at, side="right") - 1
    inside = at + q <= starts[row + 1]
    at, item, inner, row = at[inside], item[inside], inner[inside], row[inside]
    k, need, size = (np.array(x, np.int64) for x in ([b[0] for b in items.budgets], [b[2] for b in items.budgets], [len(t) for t in items.texts]))
    diagonal = at - starts[row] - inner + size[item]  # shifted, so never negative
    band = diagonal // (k[item] + 1)
    # A band covers 2(k+1) diagonals: each hit counts in its own band and the one before.
    key = np.stack([np.concatenate([x, y]) for x, y in ((row, row), (item, item), (band, band - 1), (inner, inner))])
    key = key[:, np.lexsort(key[::-1])]
    new = np.ones(key.shape[1], bool)
    new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    key = key[:, new]  # each q-gram of the item counts once a band
    first = np.ones(key.shape[1], bool)
    first[1:] = (key[:3, 1:] != key[:3, :-1]).any(axis=0)
    group = np.flatnonzero(first)
    enough = np.diff(np.append(group, key.shape[1])) >= need[key[1, group]]
    return key[:3, group[enough]]


def find(items: Items, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first byte, end byte) of the best region of each item found in each row."""
    text, starts, place = normalise(raw, offsets)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for q in items.tables:
        for part in items.hits(text, q):
            if not len(part[0]):
                continue
            found = candidates(items, q, *part, starts)
            for i in np.unique(found[1]):
                item, k = np.frombuffer(items.texts[i], np.uint8), items.budgets[i][0]
                m, width = len(item), 2 * (k + 1)
                rows, bands = found[0, found[1] == i], found[2, found[1] == i]
                at_once = max(1, PART // (m + width))
                for a in range(0, len(rows), at_once):
                    rs = rows[a : a + at_once]
                    bases = starts[rs] + bands[a : a + at_once] * (k + 1) - m
                    edits, ends = align(item, np.stack([window(text, b, m + width - 1, starts[r], starts[r + 1]) for r, b in zip(rs, bases, strict=True)]))
                    for r, e, end in zip(rs.tolist(), edits.tolist(), np.minimum(bases + ends + m, starts[rs + 1]).tolist(), strict=True):
                        if e <= k and (e, end) < best.get((r, i), (k + 1, 0)):
                            best[r, i] = (e, end)
    out = []
    for (r, i), (edits, end) in sorted(best.items()):
        # Backwards from its end the region begins on one of the diagonals that so many edits reach.
        item = np.frombuffer(items.texts[i], np.uint8)[::-1]
        m = len(item)
        back = window(text, end - m - edits, m + 2 * edits, starts[r], end)[::-1]
        _, diagonal = align(item, back[None])
        begin = max(int(starts[r]), end - (int(diagonal[0]) - edits + m))
        out.append((int(r), int(i), edits, int(place[begin]) - int(offsets[r]), int(place[end - 1]) + 1 - int(offsets[r])))
    return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS):
    """The items (id, text) in blocks of bounded size, by streaming the table in id order."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id").toLocalIterator():
        if ids and size + len(r["text"] or "") > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"] or "")
        size += len(texts[-1])
    if ids:
        yield ids, texts


FOUND = "doc_id long, item_id long, edits long, first_byte long, end_byte long"


def one_at_a_time(parts, name: str):
    """The parts; if there are several, each is written before the next is asked for."""
    parts = iter(parts)
    first, second = next(parts, None), next(parts, None)
    if second is None:
        return [] if first is None else [first]
    return [materialize(p, name) for p in itertools.chain([first, second], parts)]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for each document and item found in it: edits and the byte span of the region in the text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def part(shared):
        def run(batches):
            block = Items(*shared.value, rate)
            for batch in batches:
                raw, offsets = T.string_buffers(batch.column(1))
                ids = batch.column(0)
                rows = []
                for a, b in T.pieces(offsets, PIECE_BYTES):
                    rows += [(a + r, block.ids[i], e, s, t) for r, i, e, s, t in find(block, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "item_id", "edits", "first_byte", "end_byte"])

        return texts.mapInArrow(run, FOUND)

    # A broadcast is at most BLOCK_CHARS and one item more.
    found = one_at_a_time((part(spark.sparkContext.broadcast(block)) for block in blocks(benchmark)), "found")
    return functools.reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without those that hold an item, one filtering pass for each block of items; all columns stay."""
    spark, at = docs.sparkSession, docs.columns.index("text")

    def part(docs, shared):
        def run(batches):
            block = Items(*shared.value, rate)
            for batch in batches:
                raw, offsets = T.string_buffers(batch.column(at))
                clean = np.ones(batch.num_rows, bool)
                for a, b in T.pieces(offsets, PIECE_BYTES):
                    for r, *_ in find(block, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                        clean[a + r] = False
                yield batch.filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema)

    for number, block in enumerate(blocks(benchmark)):
        docs = part(materialize(docs, "clean") if number else docs, spark.sparkContext.broadcast(block))
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and item with the edits and the region's place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark"))
