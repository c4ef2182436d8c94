"""Every query of the catalogue against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from brontide.plans import core, functions, tpch

from tests.oracle import compare

CATALOGUES = (core.c, functions.c, tpch.c)
QUERIES = {n: q for c in CATALOGUES for n, q in c.queries.items()}
ORACLES = {n: q for c in CATALOGUES for n, q in c.oracles.items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    assert ORACLES[name]
    assert compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("setting", [{"spark.sql.shuffle.partitions": "1"}, {"spark.sql.shuffle.partitions": "13"}, {"spark.sql.autoBroadcastJoinThreshold": "-1"}, {"spark.sql.adaptive.enabled": "false"}])
def test_results_do_not_depend_on_the_plan(spark, sf_dir, duck, setting):
    old = {k: spark.conf.get(k) for k in setting}
    try:
        for k, v in setting.items():
            spark.conf.set(k, v)
        for name in ("J04_full", "J12_left_residual", "J16_skewed_key", "A16_count_distinct", "U07_nested", "O07_with_ties", "W04_frames", "Q09_product_profit", "Q21_waiting_suppliers"):
            assert compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == "", name
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_import_needs_no_session_and_no_training_data_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("brontide", "__spark_entry__.py"):
        copy = shutil.copytree if (root / name).is_dir() else shutil.copy
        copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"
    shutil.rmtree(tmp_path / "brontide/llm", ignore_errors=True)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == int(out[2]) == len(QUERIES) and out[1] == "False"
