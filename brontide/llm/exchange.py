"""Packed look-ups: bring corpus-wide facts about keys back to the texts they came from.

Several operators need, for each of a text's many 64-bit keys (n-grams, windows,
signatures), something that only the whole corpus knows: a count, or the least
doc_id.  A join would shuffle a row per occurrence.  Here documents are dealt
into shards of bounded size by hash of doc_id and text; a shard sends each *distinct* key
once, packed with its neighbours in key order into one binary per key range; a
range's reducer merges what it was sent and answers each shard in the order
it asked.  Beyond FAN shards, keys go through relays, each of which merges the keys that FAN shards
have in one range and asks for all of them, so no sender cuts its keys into more than FAN rows, no
reducer hears more than FAN senders, and rows grow with the shards (at most FAN a shard and hop), not with their square.  So

* a hot key costs one entry a shard, whatever its number of occurrences;
* a hot (or null) doc_id is dealt out by its texts;
* key ranges are ranges of a hash, so reducers are even;
* nothing goes to the driver and nothing is broadcast;
* every step is an ordinary shuffle, which Spark recomputes if an executor is lost.

Sorted keys travel as byte planes of their differences, whose leading planes are
zeros and vanish in the shuffle's compression.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that a shard holds on average.
SHARD_BYTES = 8 << 20
LEAST = 24
#: Most rows that a sender cuts its keys into, and most senders that a reducer hears.
FAN = 4096


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one aggregation over the scan."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def shard_count(n_bytes: int, shard_bytes: int = SHARD_BYTES) -> int:
    return max(LEAST, math.ceil(n_bytes / shard_bytes))


def shard_of(n: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def pack(values: np.ndarray) -> bytes:
    """The least value, then byte planes of what is above it; only as many planes as the largest needs."""
    values = np.ascontiguousarray(values, dtype="<u8")
    if not len(values):
        return b""
    base = values.min()
    values = values - base
    width = (int(values.max()).bit_length() + 7) // 8
    return base.tobytes() + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, U64)
    planes = np.frombuffer(data, np.uint8, offset=8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel() + np.frombuffer(data, "<u8", 1)[0]


def pack_sorted(keys: np.ndarray) -> bytes:
    """The first key, then the packed differences."""
    keys = np.asarray(keys, "<u8")
    return keys[:1].tobytes() + pack(np.diff(keys))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    if n:
        out[0] = np.frombuffer(data, "<u8", 1)[0]
        out[1:] = unpack(data[8:], n - 1)
    return np.cumsum(out, dtype=U64)


def signed_order(ids: np.ndarray) -> np.ndarray:
    """Signed integers as unsigned ones in the same order, and back."""
    return np.asarray(ids).astype(np.int64).view(U64) ^ U64(1 << 63)


def range_of(keys: np.ndarray, n_ranges: int) -> np.ndarray:
    """Equal ranges of the key space, in key order."""
    return ((keys >> U64(32)) * U64(n_ranges)) >> U64(32)


def slices(keys: np.ndarray, n_ranges: int, bits: int = 64):
    """(range, first, last) of the sorted keys, which have so many bits."""
    at = range_of(keys << U64(64 - bits), n_ranges).astype(np.int64)
    used, first = np.unique(at, return_index=True)
    for r, a, b in zip(used, first, [*first[1:], len(keys)][: len(used)], strict=True):
        yield int(r), int(a), int(b)


REQUEST = "kind int, rng int, shard int, n long, keys binary, more binary, extra binary"
ANSWER = "kind int, rng int, shard int, n long, data binary"


def ranges(n: int) -> int:
    """The ranges into which each of ``n`` shards cuts its keys."""
    return min(n, FAN)


def requests(kind: int, shard: int, keys: np.ndarray, n_ranges: int, more: np.ndarray | None = None, extra: np.ndarray | None = None, bits: int = 64):
    """Rows of REQUEST for sorted distinct keys of so many bits; ``more`` and ``extra`` are unsigned columns beside them."""
    for r, a, b in slices(keys, n_ranges, bits):
        yield kind, r, shard, b - a, pack_sorted(keys[a:b]), None if more is None else pack(more[a:b]), None if extra is None else pack(extra[a:b])


def to_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


REQUEST_ARROW = pa.schema([("kind", pa.int32()), ("rng", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("extra", pa.binary())])
ANSWER_ARROW = pa.schema([("kind", pa.int32()), ("rng", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])


def answers_of(table: pa.Table, kind: int) -> np.ndarray:
    """All of a shard's answers of one kind, in key order."""
    rows = sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r["rng"])
    return np.concatenate([unpack(r["data"], r["n"]) for r in rows]) if rows else np.zeros(0, U64)


#: What a range tells about a key: the sum of what was sent, the least sent, or (a tuple) how many of these levels the sum reaches.
SUM, LEAST_SENT = "sum", "least"
Rule = str | tuple[int, ...]


def ask(requests_df: DataFrame, rules: dict[int, Rule], n: int, facts=None, bits: dict[int, int] | None = None) -> DataFrame:
    """Answers for the ``n`` shards that made REQUEST rows; ``rules`` tells what to answer for each kind.

    ``facts(kind, parts)`` may return numbers about a range's distinct keys; they come as rows of shard -1.
    """
    return _ask(requests_df, rules, n, 1, facts, bits or {}, FAN)


def _ask(df: DataFrame, rules: dict[int, Rule], senders: int, cells: int, facts, bits: dict[int, int], fan: int) -> DataFrame:
    """The key space has so many cells; each hears so many senders, whose number in the cell is ``shard`` modulo that."""
    if senders <= fan:
        return df.groupBy("rng").applyInArrow(_answerer(rules, facts), ANSWER)
    groups = math.ceil(senders / fan)
    by_node = df.withColumn("node", F.expr(f"cast(rng * {groups} + (shard % {senders}) div {fan} AS int)")).groupBy("node")
    cells *= fan
    relayed = by_node.applyInArrow(_relay(rules, cells * min(groups, fan), bits), REQUEST)
    answers = _ask(relayed, rules, groups, cells, facts, bits, fan)
    out = by_node.cogroup(answers.where("shard >= 0").groupBy("shard")).applyInArrow(_expander(rules), ANSWER)
    return out.unionAll(answers.where("shard < 0")) if facts else out


def _parts(table: pa.Table):
    """(kind, its rows, their (keys, more, extra)) of each kind in REQUEST rows."""
    by_kind: dict[int, list[dict]] = {}
    for r in table.to_pylist():
        by_kind.setdefault(r["kind"], []).append(r)
    for kind, rs in sorted(by_kind.items()):
        yield kind, rs, [(unpack_sorted(r["keys"], r["n"]), unpack(r["more"], r["n"]) if r["more"] is not None else None, unpack(r["extra"], r["n"]) if r["extra"] is not None else None) for r in rs]


def _answerer(rules: dict[int, Rule], facts):
    def run(table: pa.Table) -> pa.Table:
        rows = []
        for kind, rs, given in _parts(table):
            if facts:
                rows.append((kind, rs[0]["rng"], -1, 0, np.array(facts(kind, given), "<i8").tobytes()))
            _, _, value, at = merged(given, rules[kind])
            if isinstance(rules[kind], tuple):
                value = np.searchsorted(np.array(rules[kind], U64), value, "right").astype(U64)
            for r, found in zip(rs, parted(value[at], given), strict=True):
                rows.append((kind, r["rng"], r["shard"], r["n"], pack(found)))
        return to_table(rows, ANSWER_ARROW)

    return run


def _relay(rules: dict[int, Rule], n_ranges: int, bits: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        node, rows = table["node"][0].as_py(), []
        for kind, _, given in _parts(table):
            keys, extra, value, _ = merged(given, rules[kind])
            rows += requests(kind, node, keys, n_ranges, value, extra, bits.get(kind, 64))
        return to_table(rows, REQUEST_ARROW)

    return run


def _expander(rules: dict[int, Rule]):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for kind, rs, given in _parts(table):
            *_, at = merged(given, rules[kind])
            for r, found in zip(rs, parted(answers_of(answers, kind)[at], given), strict=True):
                rows.append((kind, r["rng"], r["shard"], r["n"], pack(found)))
        return to_table(rows, ANSWER_ARROW)

    return run


def parted(values: np.ndarray, given: list[tuple]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(k) for k, _, _ in given])[:-1])


def merged(given: list[tuple], rule: Rule) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """(distinct keys, their extras, sum or least of ``more``, the distinct key of each given one), in order of (key, extra)."""
    keys = np.concatenate([k for k, _, _ in given])
    more = np.concatenate([m for _, m, _ in given])
    extra = np.concatenate([e for _, _, e in given]) if given[0][2] is not None else None
    order = np.argsort(keys, kind="stable") if extra is None else np.lexsort((extra, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if extra is not None:
        e = extra[order]
        new[1:] |= e[1:] != e[:-1]
    first = np.flatnonzero(new)
    value = (np.minimum if rule == LEAST_SENT else np.add).reduceat(more[order], first) if len(first) else more
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return k[first], None if extra is None else e[first], value, at


def sharded(docs: DataFrame, n: int, *columns: Column) -> DataFrame:
    """(shard, doc_id, text, columns): what the operators group and cogroup by shard."""
    ids, text = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(shard_of(n, ids, text).alias("shard"), ids, text, *columns)
