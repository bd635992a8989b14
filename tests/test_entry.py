"""The registered queries against their SQL, and that the engine stands without its optional part."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import oracle, queries

from .conftest import ROOT, SF

FAST = ["vectorize", "quantize", "mcc_lookup", "parse_valid", "parse_reject_reason", "route_status", "knn_brute", "score", "http_response", "ivf_adaptive", "ivf_scancap", "ivf_cluster_stats", "cells_knn", "index_roundtrip", "stream_score", "nprobe_sweep", "cells_budget", "cells_refined", "boxes_descent", "boxes_relaxed", "visits_sweep", "ivf_pruned", "ivf_build", "binary_clustered", "corpus_scan", "confusion", "latency_percentiles", "load_report"]


def plain(rows):
    return sorted(tuple("null" if x is None else f"{float(x):.9g}" if isinstance(x, (int, float)) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in ("lineitem", "orders", "events", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(oracle.ORACLE[name])
    assert sorted(d[0] for d in want.description) == names
    rows = con.execute(f"select {', '.join(names)} from ({oracle.ORACLE[name]})").fetchall()
    assert plain(got.select(*names).collect()) == plain(rows)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["qid", "frauds", "fraud_score", "approved"]


def test_without_the_optional_part(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'score' in q and not [x for x in q if x.startswith('op') or x == 'pipeline'], q"
    alone = os.environ | {"PYTHONPATH": str(tmp_path / "repo")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=alone, check=True, timeout=120)
    # the tests of the rest pass there, of which some are run
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_evaluate.py", "tests/test_features.py"], cwd=tmp_path / "repo", env=alone, check=True, timeout=300)


def test_refined_is_exact():
    """Every query is searched to the end: the SQL has no early stop."""
    assert oracle.ORACLE["cells_refined"] == oracle.ORACLE["knn_brute"]
