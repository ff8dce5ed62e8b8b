"""A cross-section of the registry against DuckDB on the smallest tables; the full comparison is
``tools/check_oracles.py``."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import __spark_entry__ as entry  # noqa: E402
from check_oracles import TABLES, normal  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["a1_cell_statistics", "c4_shipped_band", "e1_scored_pairs", "e4_regime_unseen_family", "ex_observations", "ex22_reject_log",
          "u1_exact_cluster_bootstrap", "u6_intraclass_correlation", "v3_flags", "b6_censoring_backtest", "m10_best_neighbour", "q1_contract_validation", "q13_secret_scan"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, duck, name):
    got = normal(entry.queries()[name](spark, SF).toPandas())
    want = normal(duck.execute(entry.oracle_sql()[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert len(a) == len(b)
        # a mean that ends in an exact half at the seventh place may round either way
        assert all(x == pytest.approx(y, abs=2e-6) if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)


def test_flagship(spark):
    d = entry.entry(spark)
    assert d.columns == ["scheme", "n", "coverage", "coverage_one_sided", "mean_half_width", "mae"] and d.count() > 0


def test_request_log_follows_as_stream(spark, tmp_path):
    from pairmeter.sources import sinks
    from pairmeter.streaming.demand import follow_demand
    path = str(tmp_path / "log")
    assert sinks.log_request(spark, path, ["nf", "af"], refused=["nf|<2B"])
    q = follow_demand(spark, path).writeStream.outputMode("complete").format("memory").queryName("demand").start()
    q.processAllAvailable()
    assert sinks.log_request(spark, path, ["af"])
    q.processAllAvailable()
    q.stop()
    assert {r.scheme: r.n_requests for r in spark.table("demand").collect()} == {"af": 2, "nf": 1}
    assert {r.scheme: r.n_refused for r in spark.table("demand").collect()} == {"af": 1, "nf": 1}


def test_intermediate_tables_live_in_the_applications_folder(spark):
    from pairmeter.plans.staging import session_dir, shared_dir, stage
    own = session_dir(spark)
    assert own == f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    assert stage(spark.range(3)).inputFiles()[0].removeprefix("file://").startswith(own)
