"""Published runs and checks that ride on writes."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import day, rows
from tests.test_ingest import frames, payload, texts
from tidemark.operators import observed as O
from tidemark.operators.quality import DataQualityError
from tidemark.plans.daily import daily_from_files, daily_from_sources, parse_sources
from tidemark.session import children, delete, fresh_path, scratch, shared_folder
from tidemark.sources import landed, runs

SCHEMA = "symbol string, date date, close double"


def bars(spark, *more):
    made = [("A", day("2024-03-01"), 1.0), ("A", day("2024-03-04"), 2.0), ("B", day("2024-03-01"), 3.0), *more]
    return spark.createDataFrame(made, SCHEMA)


def executions(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_a_lost_run_is_never_seen(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(DataQualityError, match="no published run"):
        runs.latest(spark, folder)
    first = runs.publish({"a": bars(spark), "deep/b": bars(spark).where("symbol = 'B'")}, folder, {"lines": bars(spark).limit(1)})
    broken = bars(spark).withColumn("close", F.raise_error(F.lit("gone")).cast("double"))
    with pytest.raises(Exception, match="gone"):
        runs.publish({"a": bars(spark, ("C", None, 4.0)), "deep/b": broken}, folder)
    assert len(children(spark, f"{folder}/runs")) == 2
    found = runs.latest(spark, folder)
    assert {name: table.count() for name, table in found.items()} == {"a": 3, "deep/b": 1, "lines": 1}
    assert found["a"].schema == bars(spark).schema
    assert {r["name"]: r["rows"] for r in rows(runs.manifest(spark, folder))} == {"a": 3, "deep/b": 1, "lines": 1}
    second = runs.publish({"a": bars(spark, ("C", None, 4.0))}, folder)
    assert runs.latest(spark, folder)["a"].count() == 4 and runs.latest(spark, folder, first)["a"].count() == 3
    gone = runs.prune(spark, folder, keep=1)
    assert first in gone and len(gone) == 2 and children(spark, f"{folder}/runs") == [second]
    assert runs.latest(spark, folder)["a"].count() == 4


def test_a_run_needs_names_of_its_own(spark, tmp_path):
    for tables, lines in (({}, {}), ({"a": bars(spark)}, {"a": bars(spark)})):
        with pytest.raises(ValueError):
            runs.publish(tables, str(tmp_path / "out"), lines)


def test_checks_start_no_job_of_their_own(spark):
    before = executions(spark)
    kept = O.written_checked(bars(spark), "bars", O.unique("repeated"), O.Check("cheap", F.col("close") <= 0), empty="empty")
    assert executions(spark) == before + 1
    assert kept.columns == ["symbol", "date", "close"] and kept.count() == 3


@pytest.mark.parametrize("more, message", [
    ((("A", day("2024-03-04"), 5.0),), 'repeated: 2 rows, such as {"symbol":"A","date":"2024-03-04"}'),
    (((None, day("2024-03-04"), 5.0),), 'repeated: 1 rows, such as {"date":"2024-03-04"}'),
    ((("C", day("2024-03-04"), -5.0),), "cheap: 1 rows"),
    ((("C", day("2024-03-04"), None),), "cheap: 1 rows"),
])
def test_a_bad_table_is_deleted(spark, more, message):
    path = fresh_path(spark, "bad")
    with pytest.raises(DataQualityError) as error:
        O.written_checked(bars(spark, *more), "bars", O.unique("repeated"), O.Check("cheap", F.col("close") <= 0), path=path)
    assert message in str(error.value) and not os.path.exists(path)


def test_an_empty_table_and_reserved_names(spark):
    assert O.written_checked(bars(spark).where("false"), "bars", O.unique("repeated")).count() == 0
    with pytest.raises(DataQualityError, match="nothing"):
        O.written_checked(bars(spark).where("false"), "bars", O.unique("repeated"), empty="nothing")
    with pytest.raises(DataQualityError, match="reserved"):
        O.written_checked(bars(spark).withColumn("_rows_of_symbol_date", F.lit(1)), "bars", O.unique("repeated"))


def test_months_must_be_full(spark):
    def month(*days, probability=0.5):
        return spark.createDataFrame([("A", "2024-03", d, 3, probability, 1.0, 1.0) for d in days],
                                     "symbol string, month string, trading_day int, days_in_month int, near_probability double, "
                                     "adjusted_open double, reservation_adjusted double")

    check = O.full_months("unusable")
    assert O.written_checked(month(2, 1, 3), "months", check).count() == 3
    for bad in (month(1, 2), month(1, 2, 2), month(1, 2, 4), month(1, 2, 3, 3), month(1, 2, 3, probability=1.5), month(1, 2, 3, probability=None)):
        with pytest.raises(DataQualityError, match="unusable"):
            O.written_checked(bad, "months", check)


def test_the_daily_job_writes_each_table_once(spark, tmp_path):
    for name, text in texts().items():
        folder = tmp_path / "landed" / name / "symbol=X"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text(text)
    before, held = executions(spark), set(children(spark, f"{shared_folder(spark)}/tidemark"))
    out = daily_from_files(spark, str(tmp_path / "landed"), str(tmp_path / "daily"))
    # six sources, the table, its published copy and the manifest; then the manifest is looked up in two
    assert executions(spark) - before <= 11
    assert set(children(spark, f"{shared_folder(spark)}/tidemark")) == held  # nothing is left behind
    assert landed.read_daily(spark, str(tmp_path / "daily")).count() == out.count() == 3
    bad = [{"date": "2024-05-06", "MarginPurchaseTodayBalance": 4, "ShortSaleTodayBalance": 2}] * 2
    (tmp_path / "landed" / "margin" / "symbol=X" / "a.json").write_text(payload(bad))
    with pytest.raises(DataQualityError, match="margin"):
        daily_from_files(spark, str(tmp_path / "landed"), str(tmp_path / "daily"))
    assert landed.read_daily(spark, str(tmp_path / "daily")).count() == 3


def test_scratch_is_cleared_after_errors_too(spark):
    with pytest.raises(ZeroDivisionError), scratch(spark):
        path = fresh_path(spark, "mine")
        bars(spark).write.parquet(path)
        assert os.path.exists(path)
        raise ZeroDivisionError
    assert not os.path.exists(path)
    delete(spark, path)  # nothing there is no error


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_bucketed_table_saves_the_exchange(spark, tmp_path):
    from tidemark import schemas
    from tidemark.operators.features import build_features

    made = spark.range(400).select(
        F.concat(F.lit("S"), F.col("id") % 40).alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 40).cast("int")).alias("date"),
        *[F.lit(None).cast(field.dataType).alias(field.name) if field.name not in ("open", "high", "low", "close", "volume") else
          (F.lit(10.0) + F.col("id") % 7).cast(field.dataType).alias(field.name)
          for field in schemas.DAILY.fields if field.name not in ("symbol", "date")])
    table = landed.write_bucketed(made, str(tmp_path / "daily"), 8)
    files = [name for name in os.listdir(tmp_path / "daily") if name.endswith(".parquet")]
    assert len(files) <= 8 and table.count() == 400
    features = build_features(table)
    assert "Exchange" not in plan_of(features) and "Window" in plan_of(features)
    assert "Exchange" in plan_of(build_features(made))
    months = table.groupBy("symbol").agg(F.max("date").alias("last"))
    assert "Exchange" not in plan_of(table.hint("merge").join(months, "symbol"))
    again = landed.read_bucketed(spark, str(tmp_path / "daily"), made.schema, 8)
    compared = ["symbol", "date", "rsi_14", "ret_5"]
    key = lambda row: (row["symbol"], row["date"])
    assert sorted(build_features(again).select(*compared).collect(), key=key) == sorted(build_features(made).select(*compared).collect(), key=key)


def test_series_are_read_in_blocks(spark, monkeypatch):
    import datetime as dt
    import random

    from tidemark.functions import windows
    from tidemark.operators import leads

    monkeypatch.setattr(windows, "BLOCK_DAYS", 9)
    draw = random.Random(5)
    first = dt.date(2023, 12, 1)
    dates = sorted(draw.sample([first + dt.timedelta(days=n) for n in range(300)], 120))
    values = [None if draw.random() < 0.2 else round(30 + draw.random(), 3) for _ in dates]
    rates = spark.createDataFrame(list(zip(dates, values)), "date date, usd_twd double")
    known, ups, before = [], [], None
    for value in values:
        now = before if value is None else value
        ups.append(bool(now is not None and before is not None and now / before - 1 > 0))
        known.append(now)
        before = now
    want = [(d, float(up), float(n >= 2 and all(ups[n - 2:n + 1]))) for n, (d, up) in enumerate(zip(dates, ups))]
    assert sorted(tuple(row) for row in leads.currency_signals(rates).collect()) == want and any(row[2] for row in want)
    prices = rates.withColumnRenamed("usd_twd", "adj_close")
    returns = leads.session_returns(prices, "tsm_lead_ret")
    got = {row["date"]: row["value"] for row in returns.collect()}
    for n, d in enumerate(dates):
        back = known[n - 1] if n else None
        assert got[d] == pytest.approx(known[n] / back - 1) if known[n] is not None and back is not None else got[d] is None
    targets = spark.createDataFrame([(first + dt.timedelta(days=n),) for n in range(0, 310, 3)], "date date")
    aligned = leads.align_prior_session(returns, targets, ("tsm_lead_ret",))
    for row in aligned.collect():
        earlier = [got[d] for d in dates if d < row["date"] and got[d] is not None]
        assert row["value"] == (earlier[-1] if earlier else None)
    for line in plan_of(aligned).splitlines():
        if "Window [" in line and "block" not in line:
            raise AssertionError(f"a window without blocks: {line}")
