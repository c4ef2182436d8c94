import hashlib
import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from brontide.llm import decontaminate, substring_dedup, toxicity

from tests.llm import cases
from tests.llm.test_decontaminate import best_edits, plain
from tests.llm.test_jaccard_join import expected as components
from tests.llm.test_jaccard_join import near_copies
from tests.llm.test_substring_dedup import expected as kept
from tests.llm.test_toxicity import corpus

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus(200)
    item = "a passage of the benchmark which some texts hold and which is long enough to count"
    rows += [(2000 + r[0], *r[1:]) for r in near_copies(n=60)] + [(5000 + r[0], *r[1:]) for r in cases.documents()]
    rows += [(9000 + i, f"some words {i} before {item.upper()} and {i} after", None, "x", 1, 1, True, 1) for i in range(4)]
    path = cases.write(spark, tmp_path, rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    model = toxicity.fit(cases.frame(spark, rows), spark.read.parquet(f"{path}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(cases.frame(spark, rows), *model).where("toxicity >= 0.5").collect()}
    assert len(toxic & {i for i in range(200) if i % 5 == 0}) > 36
    docs, now = spark.read.parquet(f"{path}/documents.parquet"), rows
    for name, stage in pipeline.STAGES:
        columns = docs.columns
        docs = pipeline.materialize(stage(spark, docs, path), name)
        if name == "toxicity":
            now = [r for r in now if r[0] not in toxic]
        elif name == "near_duplicates":
            c = components(now)
            now = [r for r in now if c[r[0]][1] == r[0]]
        elif name == "substring_dedup":
            k = kept(now, substring_dedup.WINDOW)
            now = [(r[0], k[r[0]][3] if k[r[0]][1] else r[1], *r[2:]) for r in now if not k[r[0]][1] or k[r[0]][3]]
        elif name == "decontamination":
            now = [r for r in now if not r[1] or best_edits(plain(item), plain(r[1])) > decontaminate.budget(len(plain(item)))[0]]
        if name != "tokens":
            assert docs.columns == columns
            assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, now)), name
    got = {r.doc_id: r.decoded_sha256 for r in docs.collect()}
    assert got == {r[0]: hashlib.sha256((r[1] or "").encode()).hexdigest() for r in now}
    assert {r.doc_id for r in pipeline.run(spark, path).collect()} == set(got)


SCHEMA = "doc_id long, text string, toxicity string, shard string, component_id string, rest string"


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_null_and_repeated_ids_and_clashing_names(spark, tmp_path):
    """A user's columns keep their values; of a doc_id's rows one stays; rows without id stay."""
    path = str(tmp_path)
    rows, labels = corpus(120)
    copy = rows[1][1]
    given = [(i, t) for i, t, *_ in rows] + [(1, copy), (1, copy), (7, "a text of its own for a repeated id"), (None, copy), (None, None), (500, copy), (501, "")]
    docs = spark.createDataFrame([(i, t, "keep", "me", "too", "x") for i, t in given], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name in ("toxicity", "near_duplicates", "substring_dedup", "decontamination"):
        docs = pipeline.materialize(stage(name)(spark, docs, path), name)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert {tuple(r)[2:] for r in docs.collect()} == {("keep", "me", "too", "x")}
    found = docs.select("doc_id", "text").collect()
    ids = [r.doc_id for r in found]
    assert ids.count(1) == 1 and ids.count(7) == 1 and ids.count(None) == (1 if len(copy.split()) >= substring_dedup.WINDOW else 2) and 500 not in ids and 501 in ids
    assert next(r.text for r in found if r.doc_id == 7) == min(rows[7][1], "a text of its own for a repeated id")


def test_empty_tables(spark, tmp_path):
    path = cases.write(spark, tmp_path, [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert pipeline.run(spark, path).collect() == []


def test_near_duplicates_join_texts_once(spark, tmp_path):
    """Ids are known before texts are read again: the result scans the texts once, beside no step of the search."""
    path = cases.write(spark, tmp_path, near_copies(n=60))
    kept = stage("near_duplicates")(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan
    assert len(re.findall(r"FileScan parquet \[[^\]]*text#", plan)) == 1


READ = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from brontide.llm.shared import table

spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "512m").config("spark.ui.enabled", "false").getOrCreate()
print("READ", table(spark, sys.argv[1], "documents").agg(F.sum(F.length("text").cast("long")), F.count(F.xxhash64("text"))).first()[1])
"""


def test_long_texts_are_read_in_a_small_heap(spark, tmp_path):
    """Four tasks read texts of 16 kB; batches of 4096 rows are arrays of over 64 MB each, more than the heap."""
    docs = spark.range(0, 16384, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.expr("repeat(' word', 3200)")).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK", "SPARK"))} | {"PYTHONPATH": root}
    out = subprocess.run([sys.executable, "-c", READ, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert "READ 16384" in out.stdout, out.stderr[-2000:]
