"""Language-model scoring by deleted interpolation.

P(w | h) = l2(b) c(h, w) / c(h)  +  l1(b) c(w) / N  +  l0(b) / (V + 1)

where b is the bucket of the context's frequency c(h), and the mixture weights of
each bucket are learned by expectation-maximisation on held-out counts: every
training token in turn is deleted from the counts (c - 1) that predict it.

Counts are taken over all training texts through the packed look-ups of
``exchange``: a shard sends each distinct word and word pair with its count and
gets the corpus's count back, so a frequent pair costs one entry a shard.  What
returns is kept as one packed row for each document in the shared folder; EM's
statistics (a histogram over bucket and binned probabilities) and the scores are
then plain passes over it.  Only that histogram, of at most BUCKETS * (BINS + 1)**2
cells, and N and V reach the driver.

Words are counted by 64 bits of hash, pairs by ``pair_bits``, which grow with the input.

Defined cases: a null or empty text is its end token alone; a very long text is one row of its shard, whole;
repeated rows count and score each, rows of one doc_id too; a null doc_id is not held out; equal counts need no
order; other columns are not read; an empty table gives an empty result; without training text N
and V are 0 and the model is the uniform 1 / (V + 1).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brontide.llm import exchange as X
from brontide.llm import textops as T
from brontide.llm.shared import materialize, table

END = T.U64(0x1F83D9ABFB41BD6B)
START = T.U64(0x5BE0CD19137E2179)
WORD, PAIR = 1, 2
#: Context-frequency buckets: 0, then doubling.
BUCKETS = 24
#: Probabilities in EM's statistics are binned by this fraction of an octave.
OCTAVE, BINS = 8, 320
ITERATIONS = 60
SPARE = 20


def held_out_fold(folds: int = 10) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(False))


def token_keys(table_: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word key of each token, pair key of each token, token offsets of the rows)."""
    raw, offsets = T.string_buffers(table_["text"])
    (hashes,), bounds = T.hashed_words(raw, offsets, 1, lower=True)
    n = len(bounds) - 1
    ends = bounds[1:] + np.arange(n)
    words = np.empty(len(hashes) + n, T.U64)
    mask = np.ones(len(words), bool)
    mask[ends] = False
    words[mask], words[ends] = hashes, END
    before = np.empty_like(words)
    before[1:] = words[:-1]
    starts = np.concatenate([[0], ends + 1])
    before[starts[:-1]] = START
    return words, T.mix(before * T.U64(0x9E3779B97F4A7C15) + T.mix(words + T.U64(0x632BE59BD9B4E019))), starts


def pair_bits(n_bytes: int) -> int:
    """Bits of a pair's key: with SPARE more than its number needs, a pair shares its key with a chance of under 2**-SPARE."""
    return min(64, math.ceil(math.log2(max(2, n_bytes))) + SPARE)


def _send(n_ranges: int, bits: int):
    def run(t: pa.Table) -> pa.Table:
        words, pairs, starts = token_keys(t)
        pairs >>= T.U64(64 - bits)
        train = np.repeat(~t["held_out"].to_numpy(), np.diff(starts))
        shard, rows = t["shard"][0].as_py(), []
        for kind, keys, size in ((WORD, words, 64), (PAIR, pairs, bits)):
            found, at = np.unique(keys, return_inverse=True)
            counts = np.bincount(at, weights=train, minlength=len(found)).astype(np.int64)
            rows += X.requests(kind, shard, found, n_ranges, counts.astype(T.U64), bits=size)
        return X.to_table(rows, X.REQUEST_ARROW)

    return run


def _facts(kind: int, given: list[tuple]) -> tuple[int, int]:
    """(tokens, distinct tokens in training) of a range of words."""
    if kind != WORD:
        return 0, 0
    counts = np.concatenate([m for _, m, _ in given])
    keys = np.concatenate([k for k, _, _ in given])[counts > 0]
    return int(counts.sum()), len(np.unique(keys))


#: A row is a document with its tokens' corpus counts, or (``facts``) a key range's tokens and distinct tokens.
COUNTS = "doc_id long, held_out boolean, n_tokens long, c1 binary, c2 binary, facts boolean, distinct long"


def _receive(bits: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            found = np.array([np.frombuffer(x.as_py(), "<i8") for x in answers["data"]], np.int64).reshape(-1, 2)
            n = len(found)
            columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(found[:, 0]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(np.ones(n, bool)), pa.array(found[:, 1])]
        else:
            words, pairs, starts = token_keys(t)
            found, at = np.unique(words, return_inverse=True)
            c1 = X.answers_of(answers, WORD)[at]
            found, at = np.unique(pairs >> T.U64(64 - bits), return_inverse=True)
            c2 = X.answers_of(answers, PAIR)[at]
            packed = [pa.array([X.pack(c[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary()) for c in (c1, c2)]
            columns = [t["doc_id"], t["held_out"], pa.array(np.diff(starts)), *packed, pa.array(np.zeros(t.num_rows, bool)), pa.nulls(t.num_rows, pa.int64())]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "c1", "c2", "facts", "distinct"])

    return run


def counted(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(documents with the packed corpus counts of their tokens, N, V)."""
    n_bytes = X.text_bytes(docs)
    n = X.shard_count(n_bytes)
    dealt = X.sharded(docs, n, held_out_fold().alias("held_out"))
    bits = pair_bits(n_bytes)
    answers = X.ask(dealt.groupBy("shard").applyInArrow(_send(X.ranges(n), bits), X.REQUEST), {WORD: X.SUM, PAIR: X.SUM}, n, _facts, {PAIR: bits})
    rows = materialize(dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_receive(bits), COUNTS), "token-counts")
    total = rows.where("facts").agg(F.sum("n_tokens").alias("n"), F.sum("distinct").alias("v")).first()
    return rows.where("NOT facts").drop("facts", "distinct"), total["n"] or 0, total["v"] or 0


def _counts(batch: pa.RecordBatch, at: int):
    """(c(w), c(h, w), c(h), token offsets) of all rows; START's count is END's, one a text."""
    sizes = batch.column(at).to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    c1, c2 = (np.concatenate([np.zeros(0, T.U64), *(X.unpack(x.as_py(), int(n)) for x, n in zip(batch.column(at + k), sizes, strict=True))]).astype(np.int64) for k in (1, 2))
    ch = np.empty_like(c1)
    ch[1:] = c1[:-1]
    ch[starts[:-1]] = c1[starts[1:] - 1]
    return c1, c2, ch, starts


def bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(float))[1], BUCKETS - 1)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for p = 0, else 1 + eighths of octaves below 1."""
    with np.errstate(divide="ignore"):
        at = np.rint(-np.log2(p) * OCTAVE)
    return np.where(p > 0, 1 + np.minimum(at, BINS - 1), 0).astype(np.int64)


def histogram(rows: DataFrame, tokens: int) -> list[tuple[int, int, int, float]]:
    """(bucket, bin of the pair's probability, bin of the word's, tokens) after deleting each training token."""

    def run(batches):
        for batch in batches:
            c1, c2, ch, _ = _counts(batch, 0)
            a = (c2 - 1) / np.maximum(ch - 1, 1)
            b = (c1 - 1) / max(tokens - 1, 1)
            cell = (bucket(ch - 1) * (BINS + 1) + _bin(a)) * (BINS + 1) + _bin(b)
            keys, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["cell", "n"])

    cells = rows.where("NOT held_out").select("n_tokens", "c1", "c2").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return [(r["cell"] // (BINS + 1) ** 2, r["cell"] // (BINS + 1) % (BINS + 1), r["cell"] % (BINS + 1), float(r["n"])) for r in cells]


def learn(cells: list[tuple[int, int, int, float]], distinct: int) -> np.ndarray:
    """Weights [bucket, (pair, word, uniform)] by EM over the histogram; buckets that it lacks keep even weights."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    data = np.array(sorted(cells), float).reshape(-1, 4)
    p = np.where(data[:, 1:3] > 0, 2.0 ** (-(data[:, 1:3] - 1) / OCTAVE), 0)
    p = np.column_stack([p, np.full(len(p), 1 / (distinct + 1))])
    for b in np.unique(data[:, 0]).astype(int):
        here, n = p[data[:, 0] == b], data[data[:, 0] == b, 3]
        for _ in range(ITERATIONS):
            share = here * weights[b]
            share /= share.sum(axis=1, keepdims=True)
            weights[b] = n @ share + 1e-3 * (np.arange(3) == 2)
            weights[b] /= weights[b].sum()
    return weights


def token_probabilities(c1, c2, ch, tokens: int, distinct: int, weights: np.ndarray) -> np.ndarray:
    w = weights[bucket(ch)]
    return w[:, 0] * c2 / np.maximum(ch, 1) + w[:, 1] * c1 / max(tokens, 1) + w[:, 2] / (distinct + 1)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    rows, tokens, distinct = counted(docs)
    weights = learn(histogram(rows, tokens), distinct)

    def run(batches):
        for batch in batches:
            c1, c2, ch, starts = _counts(batch, 2)
            if not batch.num_rows:
                continue
            base = np.log10((c1 + 0.1) / (tokens + 0.1 * (distinct + 1)))
            model = np.log10(np.maximum(token_probabilities(c1, c2, ch, tokens, distinct, weights), 1e-300)) if tokens else np.full(len(c1), -np.log10(distinct + 1))
            sums = [np.add.reduceat(x, starts[:-1]) for x in ((c1 > 0).astype(np.int64), base, model)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums[0]), pa.array(np.full(batch.num_rows, tokens)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.select("doc_id", "held_out", "n_tokens", "c1", "c2").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
