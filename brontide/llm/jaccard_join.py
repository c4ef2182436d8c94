"""N-gram Jaccard self-join by PartEnum signatures, with the groups that its links form.

A text is the set of its distinct SHINGLE-word shingles (lower-cased A-Z), as 64-bit
hashes.  Texts of one set form a class and only the class's least doc_id (its
representative) goes on.  Two representatives link when |A & B| >= 0.75 |A | B|.

PartEnum: sizes are cut into bands; sets that link differ in at most
k elements of the symmetric difference for their band.  The feature domain is cut by hash
into n1 first-level partitions, more than the k differences can spoil, and each
into N2 second-level ones; a signature is a set's projection on K_KEPT of the N2.  If at
most N2 - K_KEPT differences fall into a first-level partition, some signature is shared.
A projection without elements says nothing, and one of hot shingles only (those that HOT texts or more have, by a
merged count-min row) would bring all texts with a common passage together, so neither is emitted; n1 has slack
partitions over, and a set with more such ones than that also emits
the elements of its prefix (its first n - ceil(0.75 n) + 1 elements, hot ones last, then in hash order).  Linked sets of
which one is not so deficient share a PartEnum signature, as equal projections are hot or empty alike; two deficient ones share a prefix
element.  So no link is lost, and a bucket of HOT documents or more is one of sets that are hot in over 75 % of their elements.

Before that, a set that links with another has at least 75 % of its shingles in it, so sets
with fewer shingles that the same row estimates to occur twice are out; the
estimate is never too low.

Links are verified exactly, never by all pairs of a group.  The least document of each
signature's bucket is its pivot.  A pair of pivot and document is first held against two exact bounds:
their sizes, and the parities of their elements' places (a set's ``parity`` has a bit for each place, and
each differing bit is an element that only one set has).  What passes is measured with the whole sets: first each
document with its least pivot, whose links form components, then the pairs that these leave apart.
Documents that are still outside of their pivot's component meet all of the pivot's documents in blocks
of BLOCK by BLOCK parities, and those with a partner by the bounds meet as whole sets, block by block; a block
gives at most one link to each component.

All exchanges are those of ``exchange`` (a hot set or signature is one entry a shard) or joins
of representatives, dealt by salted pivot; components stay distributed.

Defined cases: texts without words are empty and linked with nothing, each its own component; texts of under
SHINGLE words are the one shingle of all their words; a very long text is one row of its shard, whole; equal doc_ids are one document of the
component, with the links of all their texts; a null doc_id never is a component's least id, which is null where there
is no other (ids from NULL_IDS on stand for null ones and should not occur beside them); ids may be of any size; other columns are not
read; an empty table gives an empty result.  Links inside a component are not all verified, so their number is not an output.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brontide.llm import exchange as X
from brontide.llm import textops as T
from brontide.llm.shared import forget, materialize, table

SHINGLE = 5
#: Jaccard threshold as a fraction: NUM / DEN.
NUM, DEN = 75, 100
N2, K_KEPT = 3, 2
SPREAD, WORD_BYTES = 16, 6
CLASS, SKETCH = 0, 1
#: Texts that make a shingle hot.
HOT = 1024
#: From here on ids stand for classes of null doc_ids.
NULL_IDS = (1 << 63) - (1 << 48)
#: Documents of a pivot, and outsiders, that meet in one block.
BLOCK = 256
#: A pivot's documents are dealt over so many tasks.
SALT = 32


def shingle_sets(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets of the rows, rows' word counts): each row's distinct shingles in hash order."""
    raw, offsets = T.string_buffers(t["text"])
    (words,), bounds = T.hashed_words(raw, offsets, 1, lower=True)
    n = len(bounds) - 1
    firsts, rows = T.window_starts(bounds, SHINGLE)
    found = T.window_hashes(words, firsts, SHINGLE)
    sizes = np.diff(bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    alone = T.window_hashes(words, bounds[short], sizes[short])
    rows, found = np.concatenate([rows, short]), np.concatenate([found, alone])
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    rows, found = rows[new], found[new]
    return found, np.searchsorted(rows, np.arange(n + 1)), sizes


def set_hashes(found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = (T.span_hashes(found, bounds[:-1], bounds[1:], m) for m in T.WORD_MUL)
    return a, b & T.U64((1 << 32) - 1)


def sketch_bits(n_bytes: int) -> int:
    return max(16, math.ceil(math.log2(SPREAD * max(1, n_bytes) / WORD_BYTES)))


def _ids(t: pa.Table, hashes: np.ndarray) -> np.ndarray:
    """doc_ids; for null ones a stand-in of their sets' hashes."""
    ids = t["doc_id"].combine_chunks()
    return np.where(ids.is_null(), NULL_IDS + (hashes >> T.U64(16)).astype(np.int64), ids.fill_null(0)).astype(np.int64)


def classes(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(non-empty rows by class and then id, whether each begins a class)."""
    full = np.flatnonzero(sizes)
    order = full[np.lexsort((ids[full], b[full], a[full]))]
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order, new


def _send(n_ranges: int, bits: int):
    def run(t: pa.Table) -> pa.Table:
        found, bounds, _ = shingle_sets(t)
        a, b = set_hashes(found, bounds)
        ids = X.signed_order(_ids(t, a))
        order, new = classes(a, b, np.diff(bounds), ids)
        at, shard = order[new], t["shard"][0].as_py()
        rows = list(X.requests(CLASS, shard, a[at], n_ranges, ids[at], b[at]))
        cells, counts = np.unique(found >> T.U64(64 - bits), return_counts=True)
        rows += X.requests(SKETCH, shard, cells, n_ranges, np.minimum(counts, 255).astype(T.U64), bits=bits)
        return X.to_table(rows, X.REQUEST_ARROW)

    return run


def parity(found: np.ndarray) -> bytes:
    """One bit for each of 64 * 2**k places, at least one a place for each element: whether oddly many elements fall there."""
    places = max(64, 1 << (len(found) - 1).bit_length())
    at = T.mix(found ^ T.U64(0x9FB21C651E98DF25)) & T.U64(places - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=places).astype(np.uint8) & 1).tobytes()


def folded(parities: np.ndarray, places: int) -> np.ndarray:
    """Rows of parity bytes for fewer places."""
    while parities.shape[1] * 8 > places:
        half = parities.shape[1] // 2
        parities = parities[:, :half] ^ parities[:, half:]
    return parities


def may_link(na, nb, differing):
    """Whether sets of these sizes, with so many differing parities, can link: by size and symmetric difference."""
    return (NUM * np.maximum(na, nb) <= DEN * np.minimum(na, nb)) & ((DEN + NUM) * differing <= (DEN - NUM) * (na + nb))


#: A document with its class; ``shingles`` (packed), ``hot`` (a bit for each) and ``parity`` only of representatives that may link.
SETS = "shard int, doc_id long, n_shingles long, rep long, shingles binary, hot binary, parity binary"
SETS_ARROW = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("rep", pa.int64()), ("shingles", pa.binary()), ("hot", pa.binary()), ("parity", pa.binary())])


def _receive(bits: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return SETS_ARROW.empty_table()
        found, bounds, _ = shingle_sets(t)
        a, b = set_hashes(found, bounds)
        sizes, ids = np.diff(bounds), _ids(t, a)
        order, new = classes(a, b, sizes, X.signed_order(ids))
        rep = ids.copy()
        if len(order):
            least = X.answers_of(answers, CLASS)[np.cumsum(new) - 1]
            rep[order] = (least ^ T.U64(1 << 63)).view(np.int64)
        _, at = np.unique(found >> T.U64(64 - bits), return_inverse=True)
        level = X.answers_of(answers, SKETCH)[at]
        twice = np.concatenate([[0], np.cumsum(level > 0)])
        shared = twice[bounds[1:]] - twice[bounds[:-1]]
        able = np.zeros(len(ids), bool)
        able[order[new]] = True  # a class once a shard
        able &= (rep == ids) & (DEN * shared >= NUM * sizes)
        each = lambda values, f: pa.array([f(values[bounds[i] : bounds[i + 1]]) if able[i] else None for i in range(t.num_rows)], pa.binary())
        hot = each(level > 1, lambda x: np.packbits(x).tobytes())
        return pa.table([t["shard"], t["doc_id"], pa.array(sizes), pa.array(rep), each(found, X.pack_sorted), hot, each(found, parity)], schema=SETS_ARROW)

    return run


@functools.lru_cache(maxsize=4096)
def band_of(size: int) -> int:
    """Bands have ends e(0) = 0, e(i + 1) = floor((e(i) + 1) / threshold)."""
    band, end = 0, 0
    while size > end:
        band, end = band + 1, (end + 1) * DEN // NUM
    return band


@functools.lru_cache(maxsize=4096)
def band_plan(band: int) -> tuple[int, int, int]:
    """(k, first-level partitions, slack) for sets of this band and the one before."""
    end = 0
    for _ in range(band):
        end = (end + 1) * DEN // NUM
    k = (DEN - NUM) * 2 * end // (DEN + NUM)
    good = k // (N2 - K_KEPT + 1) + 1
    slack = 2 + good // 6
    return k, good + slack, slack


def signatures(found: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Signatures of one set (sorted hashes, and which are hot), for its band and the next one."""
    out = []
    size = len(found)
    for band in (band_of(size), band_of(size) + 1):
        _, n1, slack = band_plan(band)
        place = T.mix(found ^ T.U64(0x2545F4914F6CDD1D))
        first = ((place >> T.U64(32)) * T.U64(n1) >> T.U64(32)).astype(np.int64)
        second = (place & T.U64(0xFFFFFFFF)) * T.U64(N2) >> T.U64(32)
        cell = first * N2 + second.astype(np.int64)
        # A projection's hash is the sum of its elements' hashes, mixed with its place.
        sums = np.zeros(n1 * N2, T.U64)
        np.add.at(sums, cell, T.mix(found + T.U64(0x9E3779B97F4A7C15)))
        cold = np.bincount(cell[~hot], minlength=n1 * N2).reshape(n1, N2)
        sums = sums.reshape(n1, N2)
        for out_of in range(N2):  # K_KEPT = N2 - 1: leave one out
            keep = [j for j in range(N2) if j != out_of]
            h = sums[:, keep].sum(axis=1)
            at = np.flatnonzero(cold[:, keep].sum(axis=1))
            out.append(T.mix(h[at] ^ T.mix((at * N2 + out_of + (band << 40)).astype(T.U64))))
        unused = (cold.sum(axis=1)[:, None] - cold == 0).any(axis=1).sum()
        if unused > slack:
            prefix = np.concatenate([found[~hot], found[hot]])[: size - -(-NUM * size // DEN) + 1]
            out.append(T.mix(prefix ^ T.mix(np.array([(1 << 50) + band], T.U64))))
    return np.unique(np.concatenate(out))


def _shard_signatures(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(signature, doc_id) of all sets of a shard, sorted."""
    docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, T.U64)]
    for doc, size, data, hot in zip(t["doc_id"].to_pylist(), t["n_shingles"].to_pylist(), t["shingles"], t["hot"], strict=True):
        keys.append(signatures(X.unpack_sorted(data.as_py(), size), np.unpackbits(np.frombuffer(hot.as_py(), np.uint8), count=size).astype(bool)))
        docs.append(np.full(len(keys[-1]), doc))
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((docs, keys))
    return keys[order], docs[order]


def _send_signatures(n_ranges: int):
    def run(t: pa.Table) -> pa.Table:
        keys, docs = _shard_signatures(t)
        keys, first = np.unique(keys, return_index=True)
        return X.to_table(list(X.requests(CLASS, t["shard"][0].as_py(), keys, n_ranges, X.signed_order(docs[first]))), X.REQUEST_ARROW)

    return run


def _pivots(t: pa.Table, answers: pa.Table) -> pa.Table:
    """Distinct (a, b): b of this shard shares a signature whose least document is a."""
    keys, docs = _shard_signatures(t)
    _, at = np.unique(keys, return_inverse=True)
    least = (X.answers_of(answers, CLASS)[at] ^ T.U64(1 << 63)).view(np.int64)
    pairs = np.unique(np.stack([least, docs])[:, least != docs], axis=1)
    return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})


def _near_batches(batches):
    """``near``: whether the pair can link, by sizes and parities."""
    for batch in batches:
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        differing = np.zeros(len(na), np.int64)
        for i, (p, q) in enumerate(zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)):
            if NUM * max(na[i], nb[i]) <= DEN * min(na[i], nb[i]):
                p, q = (np.frombuffer(x, np.uint8)[None] for x in (p, q))
                places = 8 * min(p.shape[1], q.shape[1])
                differing[i] = np.bitwise_count(folded(p, places) ^ folded(q, places)).sum()
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(may_link(na, nb, differing))], names=["a", "b", "near"])


VERIFIED = "a long, na long, b long, nb long, apart long"


def _verify_batches(batches):
    """``apart``: the size of the symmetric difference of each pair's sets."""
    for batch in batches:
        apart = []
        cache: tuple = (None, None)
        for a, na, sa, nb, sb in zip(*(batch.column(c).to_pylist() for c in ("a", "na", "sa", "nb", "sb")), strict=True):
            if cache[0] != a:
                cache = (a, X.unpack_sorted(sa, na))
            apart.append(na + nb - 2 * len(np.intersect1d(cache[1], X.unpack_sorted(sb, nb), assume_unique=True)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "na", "b", "nb")), pa.array(apart, pa.int64())], names=["a", "na", "b", "nb", "apart"])


def _block_near(t: pa.Table) -> pa.Table:
    """The block's outsiders and documents that have a partner of another component, by sizes and parities."""
    comps, outside, sizes = (t[c].to_numpy() for c in ("cb", "outside", "n_shingles"))
    parities = [np.frombuffer(x.as_py(), np.uint8) for x in t["parity"]]
    widths = np.array([len(p) for p in parities])
    keep = np.zeros(t.num_rows, bool)
    outer = np.flatnonzero(outside)
    for width in np.unique(widths):
        inner = np.flatnonzero(~outside & (widths == width))
        if not len(inner):
            continue
        own = np.stack([parities[i] for i in inner])
        narrow = folded(own, 4 * width)
        for x in outer[(widths[outer] <= 2 * width) & (2 * widths[outer] >= width)]:
            there = own if widths[x] >= width else narrow
            differing = np.bitwise_count(there ^ folded(parities[x][None], 8 * there.shape[1])).sum(axis=1, dtype=np.int64)
            near = may_link(sizes[inner], sizes[x], differing) & (comps[inner] != comps[x])
            if near.any():
                keep[x] = True
                keep[inner[near]] = True
    return t.select(["a", "oc", "mc", "b", "cb", "outside"]).filter(pa.array(keep))


def _block_links(t: pa.Table) -> pa.Table:
    """Links (a, b) between a block's outsiders and its documents of other components: one to each component."""
    ids, comps, outside, sizes = (t[c].to_numpy() for c in ("b", "cb", "outside", "n_shingles"))
    sets = [X.unpack_sorted(s.as_py(), int(n)) for s, n in zip(t["shingles"], sizes, strict=True)]
    inner, outer = np.flatnonzero(~outside), np.flatnonzero(outside)
    links: list[tuple[int, int]] = []
    if len(inner):
        keys, words = np.unique(np.concatenate([sets[i] for i in inner]), return_inverse=True)
        firsts = np.concatenate([[0], np.cumsum(sizes[inner])[:-1]])
        for x in outer:
            at = np.minimum(np.searchsorted(keys, sets[x]), len(keys) - 1)
            has = np.zeros(len(keys), np.int64)
            has[at[keys[at] == sets[x]]] = 1
            both = np.add.reduceat(has[words], firsts)
            near = inner[(DEN * both >= NUM * (sizes[inner] + sizes[x] - both)) & (comps[inner] != comps[x])]
            _, one = np.unique(comps[near], return_index=True)
            links += [(int(ids[x]), int(ids[y])) for y in near[one]]
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


#: |A & B| >= threshold * |A | B|, in terms of the symmetric difference.
LINK = f"{DEN + NUM} * apart <= {DEN - NUM} * (na + nb)"


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their sets' sizes and exact symmetric difference."""
    left = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("shingles").alias("sa")), "a")
    return both.select("a", "na", "sa", "b", "nb", "sb").mapInArrow(_verify_batches, VERIFIED)


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (doc, comp) after merging the groups that edges (a, b) connect: least label along links.

    Works on groups, not documents; alternates large-star and small-star steps
    until they change nothing, in the logarithm of the longest chain.
    """
    left, right = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    links = materialize(edges.join(left, "a").join(right, "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("u"), F.least("ca", "cb").alias("v")).distinct(), "links")
    if links.isEmpty():
        return labels
    before = None
    while True:
        around = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, links = links, materialize(small, "links")
        forget(old)
        now = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if now == before:
            break
        before = now
    top = links.groupBy("u").agg(F.min("v").alias("m"))
    return labels.join(top, labels["comp"] == top["u"], "left").select("doc", F.coalesce("m", "comp").alias("comp"))


def linked(sets: DataFrame, n_shards: int) -> DataFrame:
    """(doc, comp) of the representatives with shingles, by PartEnum and verification."""
    labels = sets.select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("comp")).distinct()
    by_shard = sets.select("shard", "doc_id", "n_shingles", "shingles", "hot").groupBy("shard")
    least = X.ask(by_shard.applyInArrow(_send_signatures(X.ranges(n_shards)), X.REQUEST), {CLASS: X.LEAST_SENT}, n_shards)
    pairs = by_shard.cogroup(least.groupBy("shard")).applyInArrow(_pivots, "a long, b long")
    star = materialize(bounded(pairs, sets), "pivot-pairs")
    near = star.where("near").select("a", "b")
    first = measured(near.groupBy("b").agg(F.min("a").alias("a")), sets)
    labels = materialize(components(first.where(LINK).select("a", "b"), labels), "components")
    apart = placed(near, labels).where("ca <> cb").select("a", "b").distinct()
    labels = materialize(components(measured(apart, sets).where(LINK).select("a", "b"), labels), "components")
    # Two documents of one bucket are with its pivot in ``star``. Those that its component doesn't hold
    # (outsiders) are compared with all documents of the same pivot, in blocks of bounded size.
    known = placed(star, labels).select("a", "b", "cb", F.expr("ca <> cb").alias("outside"), F.expr(f"pmod(xxhash64(b, 2), {SALT})").alias("salt"))
    known = materialize(known.distinct(), "pivot-groups")
    sizes = known.groupBy("a").agg(F.count("*").alias("m"), F.count_if("outside").alias("o")).where("o > 0")
    sizes = sizes.select("a", F.expr(f"(m + {BLOCK - 1}) div {BLOCK}").alias("m"), F.expr(f"(o + {BLOCK - 1}) div {BLOCK}").alias("o"), F.explode(F.expr(f"sequence(0L, {SALT - 1}L)")).alias("salt"))
    dealt = known.join(sizes, ["a", "salt"]).select("a", "b", "cb", "outside", "m", "o", F.expr("pmod(xxhash64(b), m)").alias("mc"), F.expr("pmod(xxhash64(b, 1), o)").alias("oc"))
    inside = dealt.select("a", "b", "cb", F.lit(False).alias("outside"), "mc", F.explode(F.expr("sequence(0L, o - 1)")).alias("oc"))
    outside = dealt.where("outside").select("a", "b", "cb", "outside", F.explode(F.expr("sequence(0L, m - 1)")).alias("mc"), "oc")
    rows = inside.unionByName(outside).join(sets.select(F.col("doc_id").alias("b"), "n_shingles", "parity"), "b")
    partners = rows.groupBy("a", "oc", "mc").applyInArrow(_block_near, "a long, oc long, mc long, b long, cb long, outside boolean")
    whole = partners.distinct().join(sets.select(F.col("doc_id").alias("b"), "n_shingles", "shingles"), "b")
    edges = whole.groupBy("a", "oc", "mc").applyInArrow(_block_links, "a long, b long")
    return components(edges, labels)


def placed(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` with the components ca and cb of a and b."""
    return pairs.join(labels.toDF("b", "cb"), "b").join(labels.toDF("a", "ca"), "a")


def bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with ``near``: not shown unable to link by sizes and parities."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "na", "pa", "b", "nb", "pb").mapInArrow(_near_batches, "a long, b long, near boolean")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, rep (least doc_id of the class) and component_id of each row."""
    n_bytes = X.text_bytes(docs)
    n, bits = X.shard_count(n_bytes), sketch_bits(n_bytes)
    by_shard = X.sharded(docs, n).groupBy("shard")
    answers = X.ask(by_shard.applyInArrow(_send(X.ranges(n), bits), X.REQUEST), {CLASS: X.LEAST_SENT, SKETCH: (2, HOT)}, n, bits={SKETCH: bits})
    found = materialize(by_shard.cogroup(answers.groupBy("shard")).applyInArrow(_receive(bits), SETS), "shingle-sets")
    sets = found.where("shingles IS NOT NULL").select("shard", F.col("rep").alias("doc_id"), "n_shingles", "shingles", "hot", "parity")
    labels = linked(sets, n)
    out = found.select("doc_id", "n_shingles", "rep").join(labels.toDF("rep", "component_id"), "rep", "left")
    component = F.coalesce("component_id", "rep")
    unknown = F.col("doc_id").isNull() & (component >= NULL_IDS)
    null_if = lambda c: F.when(~unknown, c)
    return out.select("doc_id", "n_shingles", null_if(F.col("rep")).alias("rep"), null_if(component).alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
