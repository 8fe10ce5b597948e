"""Registered queries against their SQL twins on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tidemark.catalog import load
from tidemark.catalog.registry import WIDE_TICKS
from tidemark.catalog.sqltext import IN_DATE_ORDER, settled, with_stages
from tidemark.catalog.stages import Stages
from tools.check import canonical, compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "e2e_day1_regret", "e2e_02_daily_table", "fea_17_build_features", "lab_09_labelled_table", "sel_06_all_policies",
    "agg_03_metrics_with_wealth", "agg_06_oracle_profile", "sta_02_block_bootstrap", "sta_05_holdout",
    "src_09_monthly_closes", "dq_08_prediction_months", "join_05_asof_prior_session", "ml_02_median_fill",
)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not at hand")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    case = load()[name]
    got = case.run(spark, FOLDER).toPandas()
    want = connect(FOLDER).sql(case.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and compare(canonical(got), canonical(want)) == ""


def test_rounding_text():
    assert settled("SELECT round(a, 2) AS a, round(b) FROM t") == "SELECT floor((a) * 1e2 + 0.5001e0) / 1e2 AS a, round(b) FROM t"
    assert settled("round(max(round(x, 1)), 6)").count("floor(") == 2


def test_names_are_unique_and_nearly_all_have_sql():
    cases = load()
    assert len(cases) > 120 and sum(case.sql is None for case in cases.values()) < 15


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not at hand")
@pytest.mark.parametrize("stage, value", [("adjusted", "total_return_index"), ("adjusted", "adjusted_open"), ("features", "rsi_14")])
def test_ordered_sql_equals_the_operators_to_the_last_bit(spark, stage, value):
    """Rounding hides nothing here: a step lies somewhere in a large market's values."""
    text = with_stages(f"SELECT symbol, CAST(date AS VARCHAR) AS date, {value} FROM {stage}", **IN_DATE_ORDER)
    want = connect(FOLDER).execute(text.replace(*WIDE_TICKS)).fetchall()
    got = getattr(Stages(spark, FOLDER, "supplier"), stage).selectExpr("symbol", "CAST(date AS STRING)", value).collect()
    assert len(got) > 1000 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="tables are not at hand")
@pytest.mark.parametrize("name", ["lab_10_monthly_oracle_wide", "e2e_01_prepare_wide"])
def test_a_value_beside_a_rounding_step(spark, tmp_path, name):
    """The adjusted open of S722 in June 1999 is 12.5734524999 but for its last digits."""
    for table in ("lineitem", "orders"):
        rows = spark.read.parquet(f"/root/testdata/sf0.1/{table}.parquet")
        (rows.where("l_suppkey = 722") if table == "lineitem" else rows).write.parquet(str(tmp_path / f"{table}.parquet"))
    case = load()[name]
    connection = duckdb.connect()
    for table in ("lineitem", "orders"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got, want = case.run(spark, str(tmp_path)).toPandas(), connection.sql(case.sql).df()
    assert len(got) and compare(canonical(got), canonical(want)) == ""


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not at hand")
def test_outside_series_are_read_from_the_orders_once(spark):
    """The leads read each series several times over; the orders are too large for that."""
    stages = Stages(spark, FOLDER, "flag")
    read = [file for series in (stages.tsm, stages.sox, stages.fx) for file in series.inputFiles()]
    assert read and not any("orders.parquet" in file for file in read)
    plain = spark.read.parquet(f"{FOLDER}/orders.parquet").where("o_orderpriority = '3-MEDIUM'")
    want = plain.groupBy("o_orderdate").avg("o_totalprice").collect()
    got = {row.date: row.usd_twd for row in stages.fx.collect()}
    assert got == pytest.approx({row[0].date(): row[1] for row in want})
