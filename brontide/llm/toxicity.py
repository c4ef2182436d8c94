"""Toxicity by subword-bag embeddings under a linear softmax.

A word's vector is the sum of its character n-gram vectors (hashed, with word
boundary marks) and a text's vector is the average over all its words; a softmax over two classes reads it.  Embeddings and
softmax are trained jointly in numpy on the driver.  A misspelt or newly inflected word shares most n-grams with the
words seen in training.

The training sample is bounded: at most TRAIN_DOCS labelled documents, chosen by hash
of doc_id, of which those count whose bags fit into TRAIN_BYTES.  Their n-grams are counted on the executors; what reaches the
driver is those sparse bags.  Scoring is one pass of Arrow batches
without shuffle: with two classes a word only needs the difference of the two
class logits, so the model that travels is one float per bucket.

Defined cases: a null or empty text scores by the bias alone; a very long text is scored whole, piece of words by
piece; repeated rows score alike, and a doc_id that is repeated is learned from once, by its least text, with its greatest label; a null
doc_id is not held out and has no label; labels that are null are not learned from; without labels of both classes
every score is 0; a score of exactly 0.5 is predicted toxic; a column named like the score is kept if another name is given; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from brontide.llm import textops as T
from brontide.llm.shared import forget, give_back, materialize, table

#: Most labelled documents that are learned from, whole texts each, and most bytes of their bags.
TRAIN_DOCS, TRAIN_BYTES = 4_000, 192 << 20
BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIMENSIONS = 8
EPOCHS, RATE, SEED = 10, 0.02, 7
#: The softmax learns slower than the embeddings, by this factor.
SLOWER = 1 / 16
#: Share of the training texts that an n-gram must occur in: one of fewer tells those texts, not their class.
LEAST_SHARE = 1 / 150
#: The average of a text is multiplied by so much before the softmax.
SCALE = 60.0
#: Spread of the first embeddings.
INIT = 0.01
EDGE = 0x1F


def word_grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all character-byte n-grams of ``<word>``, lower-cased, and of the word itself."""
    lengths = ends - starts + 2
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    text = np.full(offsets[-1], EDGE, np.uint8)
    inner = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    body = (inner > 0) & (inner < np.repeat(lengths, lengths) - 1)
    text[body] = T.LOWER[raw[(np.repeat(starts, lengths) + inner - 1)[body]]]
    left = np.repeat(lengths, lengths) - inner  # bytes from here to the word's end
    words = np.repeat(np.arange(len(starts)), lengths)
    out_words, out_buckets = [np.arange(len(starts))], [T.span_hashes(text, offsets[:-1], offsets[1:], T.BYTE_MUL[1]) % T.U64(BUCKETS)]
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        h = np.zeros(len(at), T.U64)
        for k in range(n):
            h = h * T.U64(1099511628211) + text[at + k] + T.U64(1)
        out_words.append(words[at])
        out_buckets.append(T.mix(h + T.U64(n)) % T.U64(BUCKETS))
    return np.concatenate(out_words), np.concatenate(out_buckets).astype(np.int64)


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each distinct lower-cased word, and the distinct word of each word."""
    h = T.word_hashes(T.LOWER[raw], starts, ends)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    return first, which


def _training_batches(batches):
    """Sparse bags: for each row its buckets and their weights (average over words), with the label."""
    for batch in batches:
        raw, offsets = T.string_buffers(batch.column(1))
        for i in range(batch.num_rows):
            a, b = int(offsets[i]), int(offsets[i + 1])
            part = raw[a:b]
            starts, ends, _ = T.word_spans(part, np.array([0, b - a]))
            first, which = distinct_words(part, starts, ends)
            words, buckets = word_grams(part, starts[first], ends[first])
            share = np.bincount(which, minlength=len(first)) / max(1, len(starts))
            keys, at = np.unique(buckets, return_inverse=True)
            weights = np.bincount(at, weights=share[words], minlength=len(keys)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, 1), batch.column(0).slice(i, 1), pa.array([keys.astype("<i4").tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary())], names=["doc_id", "toxic", "buckets", "weights"])


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """The bags of at most ``limit`` labelled documents outside the held-out fold, by hash order of doc_id."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return texts.select("toxic", "text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_training_batches, "doc_id long, toxic int, buckets binary, weights binary")


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): joint stochastic gradient descent on embeddings and softmax, reduced to class 1 minus class 0."""
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    seen = np.zeros(BUCKETS, np.int32)
    for b, _ in bags:
        seen[b] += 1  # a bag has each bucket once
    seen = seen >= LEAST_SHARE * len(bags)
    bags = [(b[seen[b]], w[seen[b]] * np.float32(SCALE)) for b, w in bags]
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, INIT, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    # The bias stays at the classes' shares, so a text of unseen words scores the share of toxic ones.
    bias = np.log(np.bincount(labels, minlength=2) / len(labels)).astype(np.float32)
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs))
        for i in rng.permutation(len(bags)):
            buckets, weights = bags[i]
            vectors = embed[buckets]
            x = weights @ vectors
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            embed[buckets] = vectors - (rate * weights)[:, None] * (out @ p)
            out -= rate * np.float32(SLOWER) * np.outer(x, p)
    edge = (out[:, 1] - out[:, 0]) * np.float32(SCALE)
    return ((embed @ edge) * seen).astype(np.float32), float(bias[1] - bias[0])


def text_scores(raw: np.ndarray, offsets: np.ndarray, model: np.ndarray, bias: float) -> np.ndarray:
    starts, ends, rows = T.word_spans(raw, offsets)
    n = len(offsets) - 1
    z = np.zeros(n)
    if len(starts):
        first, which = distinct_words(raw, starts, ends)
        words, buckets = word_grams(raw, starts[first], ends[first])
        by_word = np.bincount(words, weights=model[buckets], minlength=len(first))
        z = np.bincount(rows, weights=by_word[which], minlength=n) / np.maximum(np.bincount(rows, minlength=n), 1)
    return 1 / (1 + np.exp(-np.clip(z + bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, bool]:
    rows = training_rows(docs, labels).select("*", F.xxhash64("doc_id").alias("place"))
    rows = materialize(rows, "bags")
    size, chosen = 0, set()
    for r in sorted(rows.select("place", "doc_id", F.octet_length("buckets").alias("n")).collect()):  # TRAIN_DOCS at most
        size += 2 * r["n"]
        if size <= TRAIN_BYTES or not chosen:
            chosen.add(r["doc_id"])
    # In order of doc_id: training doesn't depend on how rows are dealt out.
    given = sorted((r["doc_id"], r["toxic"], bytes(r["buckets"]), bytes(r["weights"])) for r in rows.toLocalIterator() if r["doc_id"] in chosen)
    bags = [(np.frombuffer(b, "<i4"), np.frombuffer(w, np.float32)) for _, _, b, w in given]
    y = [toxic for _, toxic, _, _ in given]
    forget(rows)
    model, bias = train(bags, y)
    del given, bags
    give_back()
    return model, bias, len(set(y)) > 1


def score(docs: DataFrame, model: np.ndarray, bias: float, fitted: bool = True, name: str = "toxicity") -> DataFrame:
    """``docs`` (all its columns) with a column ``name`` between 0 and 1, replacing one of that name."""
    docs = docs.drop(name)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((model, bias))  # BUCKETS floats, a fixed size

    def run(batches):
        model, bias = shared.value
        for batch in batches:
            raw, offsets = T.string_buffers(batch.column(at))
            parts = [text_scores(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], model, bias) for a, b in T.pieces(offsets)]
            found = np.concatenate(parts) if fitted and parts else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, *fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
