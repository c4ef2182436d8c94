"""Quality rules by weak supervision.

Each rule looks at a document's statistics and votes good, votes bad or
abstains.  Expectation-maximisation over the histogram of vote patterns (at
most 3**len(RULES) rows, so bounded whatever the corpus) estimates every rule's
accuracy; a document's verdict is its posterior
probability of being good.  ``base_failed`` documents are rejected outright.

Plan: one pass of Arrow batches computes the statistics, which are written to
the shared folder (numbers only), one small aggregation gives the patterns, and
the verdict joins the bounded pattern table back.  No text is shuffled.

Defined cases: a null or empty text has no words, so it is base_failed; a very long text is one row, counted whole; repeated
rows, and rows of a null doc_id, get an answer each; a posterior of exactly KEEP_AT keeps, and where all rules abstain it is
PRIOR; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brontide.llm import textops as T
from brontide.llm.shared import materialize, table

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[list(range(0x41, 0x5B))] = True
STOP_MARKS = np.zeros(256, bool)
STOP_MARKS[list(b".!?")] = True
REPEAT_WINDOW = 5

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops", "n_bytes")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)

#: Share of good documents; a rule's accuracy before the first iteration, and its weight as a share of all documents.
PRIOR, ACCURACY, SMOOTH, ITERATIONS, KEEP_AT = 0.5, 0.8, 0.01, 200, 0.5


def votes() -> dict[str, tuple[Column, Column]]:
    """Rule name: (votes good, votes bad); neither is an abstention."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    symbols = F.col("n_symbols") / words
    upper = F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    repeats = F.col("n_repeat_words") / words
    dups = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / words
    stops = F.col("n_stops") / words
    none = F.lit(False)
    usual = (symbols < 0.02) & (upper < 0.15) & mean.between(3, 9) & stops.between(0.005, 0.3) & (words >= 20)
    return {
        "prose": (usual, none),
        "symbols": (none, symbols > 0.1),
        "upper": (none, upper > 0.4),
        "repeats": (none, repeats > 0.1),
        "duplicate_lines": (none, dups > 0.2),
        "word_length": (none, (mean < 2.5) | (mean > 12)),
        "sentences": (none, stops > 0.6),
        "varied": ((F.col("n_repeat_words") == 0) & (F.col("n_dup_lines") == 0) & (words >= 100) & (symbols < 0.05), none),
    }


def text_stats(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of all rows of one piece."""
    n = len(offsets) - 1

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    starts, ends, rows = T.word_spans(raw, offsets)
    bounds = T.row_bounds(rows, n)
    out = {"n_words": np.diff(bounds), "n_symbols": per_row(SYMBOLS[raw]), "n_upper": per_row(UPPER[raw]), "n_stops": per_row(STOP_MARKS[raw]), "n_bytes": np.diff(offsets)}
    out["word_chars"] = per_row(~T.SPACE[raw] & ((raw & 0xC0) != 0x80))

    # Lines with a word, equal to an earlier line of the same text.
    breaks = np.flatnonzero(raw == 0x0A)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    # a break at a text's end starts an empty line in no row's bytes; it has no word, so it never counts
    line_rows = np.searchsorted(offsets, line_starts, side="right") - 1
    fine = (line_rows < n) & (line_starts < len(raw))
    line_starts, line_rows = line_starts[fine], line_rows[fine]
    nexts = np.append(line_starts[1:], len(raw))
    line_ends = np.minimum(nexts, offsets[line_rows + 1])
    line_ends = line_ends - ((line_ends > line_starts) & (raw[np.maximum(line_ends - 1, 0)] == 0x0A))
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_rows = line_starts[has_word], line_ends[has_word], line_rows[has_word]
    key = np.stack([line_rows.astype(T.U64), T.word_hashes(raw, line_starts, line_ends, 0), T.word_hashes(raw, line_starts, line_ends, 1)])
    _, first = np.unique(key, axis=1, return_index=True) if key.shape[1] else (0, np.zeros(0, int))
    out["n_lines"] = np.bincount(line_rows, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_rows[first], minlength=n)

    # Words covered by 5-word windows that the text has twice or more.
    out["n_repeat_words"] = np.zeros(n, np.int64)
    firsts, wrows = T.window_starts(bounds, REPEAT_WINDOW)
    if len(firsts):
        a, b = (T.window_hashes(T.word_hashes(raw, starts, ends, i), firsts, REPEAT_WINDOW, i) for i in (0, 1))
        order = np.lexsort((b, a, wrows))
        same = (wrows[order][1:] == wrows[order][:-1]) & (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        twice = np.zeros(len(firsts), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, firsts[twice], 1)
        np.add.at(edge, firsts[twice] + REPEAT_WINDOW, -1)
        covered = np.cumsum(edge)[:-1] > 0
        out["n_repeat_words"] = np.bincount(rows[covered], minlength=n)
    return out


def _stats_batches(batches):
    for batch in batches:
        raw, offsets = T.string_buffers(batch.column(1))
        ids = batch.column(0).cast(pa.int64())
        for a, b in T.pieces(offsets):
            got = text_stats(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(got[c].astype(np.int64)) for c in STATS)], names=["doc_id", *STATS])


def statistics(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_stats_batches, SCHEMA)


def fit(patterns: list[tuple[tuple[int, ...], int]], k: int) -> np.ndarray:
    """Accuracy of each of k rules by EM on (votes in -1/0/1, count) rows.

    A rule's accuracy is the chance that its vote is right where it votes; an
    abstention says nothing.  The class balance is fixed at PRIOR (it can't be told
    from one-sided rules), accuracies start at ACCURACY with the weight of SMOOTH votes.
    """
    right = np.full(k, ACCURACY)
    if not patterns:
        return right
    votes_at = np.array([p for p, _ in patterns]).reshape(len(patterns), k)
    weight = np.array([c for _, c in patterns], float)
    smooth = SMOOTH * weight.sum() + 1
    for _ in range(ITERATIONS):
        good = posterior(votes_at, right)[:, None]
        agree = np.where(votes_at > 0, good, 1 - good) * (votes_at != 0)
        right = (weight @ agree + smooth * ACCURACY) / (weight @ (votes_at != 0) + smooth)
        right = np.clip(right, 0.5, 0.999)
    return right


def posterior(votes_at: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Probability of good: log odds of the prior and of each vote cast."""
    z = np.log(PRIOR / (1 - PRIOR)) + np.asarray(votes_at) @ np.log(right / (1 - right))
    return 1 / (1 + np.exp(-z))


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, all statistics, base_failed, quality (posterior) and kept."""
    rules = votes()
    stats = statistics(docs)
    for name, (good, bad) in rules.items():
        stats = stats.withColumn(f"vote_{name}", F.when(bad, -1).when(good, 1).otherwise(0))
    stats = materialize(stats, "quality-stats")
    names = [f"vote_{name}" for name in rules]
    rows = stats.groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    right = fit([(tuple(r[n] for n in names), r["count"]) for r in rows], len(names))
    known = [tuple(r[n] for n in names) for r in rows]
    quality = posterior(np.array(known), right) if known else []
    spark = docs.sparkSession
    code = sum(((F.col(n) + 1) * 3**i for i, n in enumerate(names)), F.lit(0))
    made = spark.createDataFrame([(int(sum((v + 1) * 3**i for i, v in enumerate(p))), float(q)) for p, q in zip(known, quality, strict=True)], "_code int, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = stats.withColumn("_code", code).join(F.broadcast(made), "_code", "left").drop("_code", *names)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= KEEP_AT))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
    return assess(table(spark, sf_dir, "documents")).select(*columns)
