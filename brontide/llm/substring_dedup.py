"""Substring deduplication: count-min prefilter, then exact grouping of what may repeat.

A window is WINDOW consecutive words of one text.  Pass one: every shard makes
a count-min sketch of its windows (ROWS rows; width a power of two, at least SPREAD
times the number of windows, so it grows with the corpus).  The shards' sketches are sparse, so
they travel as sorted cells with counts; each range of cells is merged by one
reducer, and a shard gets back which of its cells count twice or more in the
merged sketch.  A count-min estimate is never too low, so no repeated window is
lost.  Pass two: only windows whose estimate is two or more in every row are
grouped exactly, by 96 bits of hash, to the least doc_id that has them.

Words covered by a window that also starts in a text of smaller doc_id are
removed; windows are judged on the input.  Nothing is broadcast or collected; a hot
window is one entry a shard.

Defined cases: null, empty and short texts (under WINDOW words) have no windows and keep
all words; a very long text is one row of its shard, whole; texts of equal doc_id (repeated rows
too) never remove each other's words; a null doc_id counts as the greatest; columns of any other name travel along in
``without_repeats`` and are not read elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from brontide.llm import exchange as X
from brontide.llm import textops as T
from brontide.llm.shared import table

WINDOW, ROWS, SPREAD = 50, 2, 16
#: Kinds of request: one for each row of the sketch, then the exact pass.
EXACT = ROWS
#: A word takes about so many bytes of text, for the sketch's width.
WORD_BYTES = 6
LOW32 = T.U64((1 << 32) - 1)


def sketch_bits(n_bytes: int) -> int:
    return max(16, math.ceil(math.log2(SPREAD * max(1, n_bytes) / WORD_BYTES)))


class Windows:
    """The windows of a shard's texts."""

    def __init__(self, t: pa.Table, size: int = WINDOW):
        self.raw, self.offsets = T.string_buffers(t["text"])
        hashes, self.bounds = T.hashed_words(self.raw, self.offsets, 2)
        self.firsts, self.rows = T.window_starts(self.bounds, size)
        self.a, self.b = (T.window_hashes(h, self.firsts, size, i) for i, h in enumerate(hashes))
        ids = t["doc_id"].combine_chunks()
        self.ids = X.signed_order(np.where(ids.is_null(), np.iinfo(np.int64).max, ids.fill_null(0)))

    def cells(self, bits: int) -> list[np.ndarray]:
        return [h >> T.U64(64 - bits) for h in (self.a, self.b)]

    def suspects(self, answers: pa.Table, bits: int) -> np.ndarray:
        """Windows that the merged sketch counts twice or more in every row."""
        out = np.ones(len(self.firsts), bool)
        for kind, cells in enumerate(self.cells(bits)):
            _, at = np.unique(cells, return_inverse=True)
            out &= X.answers_of(answers, kind)[at] > 0
        return np.flatnonzero(out)

    def distinct(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order of ``which`` by window, number of each one's distinct window in that order)."""
        a, b = self.a[which], self.b[which] & LOW32
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return order, np.cumsum(new) - 1


def _send_sketch(n_ranges: int, bits: int, size: int):
    def run(t: pa.Table) -> pa.Table:
        windows, shard, rows = Windows(t, size), t["shard"][0].as_py(), []
        for kind, cells in enumerate(windows.cells(bits)):
            keys, counts = np.unique(cells, return_counts=True)
            rows += X.requests(kind, shard, keys, n_ranges, np.minimum(counts, 255).astype(T.U64), bits=bits)
        return X.to_table(rows, X.REQUEST_ARROW)

    return run


RULES = {**dict.fromkeys(range(ROWS), (2,)), EXACT: X.LEAST_SENT}


def _send_suspects(n_ranges: int, bits: int, size: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return X.to_table([], X.REQUEST_ARROW)
        windows = Windows(t, size)
        which = windows.suspects(answers, bits)
        order, group = windows.distinct(which)
        first = np.flatnonzero(np.diff(group, prepend=-1))
        ids = np.minimum.reduceat(windows.ids[windows.rows[which[order]]], first) if len(first) else np.zeros(0, T.U64)
        at = which[order[first]]
        return X.to_table(list(X.requests(EXACT, t["shard"][0].as_py(), windows.a[at], n_ranges, ids, windows.b[at] & LOW32)), X.REQUEST_ARROW)

    return run


def _remove(bits: int, size: int, with_text: bool):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        n = t.num_rows
        if not n:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string()), "kept_text": pa.array([], pa.string())})
        windows = Windows(t, size)
        which = windows.suspects(answers, bits)
        order, group = windows.distinct(which)
        least = np.empty(len(which), T.U64)
        least[order] = X.answers_of(answers, EXACT)[group]
        gone = which[least < windows.ids[windows.rows[which]]]
        edge = np.zeros(int(windows.bounds[-1]) + 1, np.int64)
        np.add.at(edge, windows.firsts[gone], 1)
        np.add.at(edge, windows.firsts[gone] + size, -1)
        removed = np.cumsum(edge)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(removed)])
        n_removed = total[windows.bounds[1:]] - total[windows.bounds[:-1]]
        hashes, texts = [], []
        for i in range(n):
            raw = windows.raw[windows.offsets[i] : windows.offsets[i + 1]]
            words = raw.tobytes().split()  # bytes.split() parts at exactly these six characters
            if n_removed[i]:
                drop = removed[windows.bounds[i] : windows.bounds[i + 1]]
                words = [w for w, d in zip(words, drop, strict=True) if not d]
            kept = b" ".join(words)
            hashes.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if with_text and n_removed[i] else None)
        return pa.table({"doc_id": t["doc_id"], "n_words": pa.array(np.diff(windows.bounds)), "n_removed": pa.array(n_removed), "kept_sha256": pa.array(hashes, pa.string()), "kept_text": pa.array(texts, pa.string())})

    return run


def asked(by_shard, n: int, bits: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Answers of the merged sketch, and of the exact pass over its suspects."""
    sketch = X.ask(by_shard.applyInArrow(_send_sketch(X.ranges(n), bits, size), X.REQUEST), RULES, n, bits=dict.fromkeys(range(ROWS), bits))
    return sketch, X.ask(by_shard.cogroup(sketch.groupBy("shard")).applyInArrow(_send_suspects(X.ranges(n), bits, size), X.REQUEST), RULES, n)


def deduplicate(docs: DataFrame, size: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of each row.

    ``kept_text`` is the kept words joined by spaces where words were removed (and
    ``with_text`` asks for it), else null.
    """
    n_bytes = X.text_bytes(docs)
    n, bits = X.shard_count(n_bytes), sketch_bits(n_bytes)
    dealt = X.sharded(docs, n)
    by_shard = dealt.groupBy("shard")
    sketch, exact = asked(by_shard, n, bits, size)
    found = by_shard.cogroup(sketch.unionAll(exact).groupBy("shard"))
    return found.applyInArrow(_remove(bits, size, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def without_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without repeated words: a text that loses words becomes its kept words joined by spaces.

    A text that loses all words is dropped; a text that loses none stays as it is. The rows'
    other columns travel with the text, so nothing is joined back.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    n_bytes = X.text_bytes(docs)
    n, bits = X.shard_count(n_bytes), sketch_bits(n_bytes)
    dealt = X.sharded(docs, n, F.struct(F.col("text").isNull().alias("_null_text"), *(F.col(f"`{c}`") for c in rest)).alias("rest"))
    by_shard = dealt.groupBy("shard")
    sketch, exact = asked(by_shard, n, bits, size)
    remove = _remove(bits, size, True)
    kind = dealt.schema["rest"].dataType
    schema = StructType([StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("text", StringType()), StructField("rest", kind)])
    arrow = to_arrow_schema(schema)

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return arrow.empty_table()
        found = remove(t, answers)
        return pa.table([found["doc_id"], found["n_words"], found["n_removed"], pc.coalesce(found["kept_text"], t["text"]), t["rest"]], schema=arrow)

    out = by_shard.cogroup(sketch.unionAll(exact).groupBy("shard")).applyInArrow(run, schema)
    out = out.where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("rest._null_text"), None).otherwise(F.col("text"))
    columns = {c: F.col(f"rest.`{c}`") for c in rest} | {"doc_id": F.col("doc_id"), "text": text}
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept_text")
