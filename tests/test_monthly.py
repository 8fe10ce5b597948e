"""Labels, leads, selection and metrics on literal cases and against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import column, day, days, rows
from tidemark import schemas
from tidemark.config import Policy
from tidemark.operators import compare as C, leads as L, metrics as M, quality as Q, selection as S
from tidemark.operators.labels import add_monthly_labels, monthly_oracle
from tidemark.operators.filters import from_month, last_complete_month

DAILY = "symbol string, date date, open double, adjusted_open double, adjusted_close double"


def daily(spark, dates, opens, symbol="X"):
    return spark.createDataFrame([(symbol, d, float(o), float(o), float(o) + 0.5) for d, o in zip(dates, opens)], DAILY)


def test_first_of_equal_lows_is_the_oracle(spark):
    dates = [day(f"2022-{d}") for d in ("05-02", "05-03", "05-04", "05-05", "06-01", "06-02", "07-01")]
    out = add_monthly_labels(daily(spark, dates, [20, 17, 18, 17, 25, 22, 30]), "2022-06")
    got = rows(out, "date")
    assert [r["date"] for r in got if r["is_oracle"]] == [day("2022-05-03"), day("2022-06-02")]
    assert [r["oracle_date"].day for r in got] == [3, 3, 3, 3, 2, 2]
    assert [r["remaining_min_adjusted_open"] for r in got] == [17, 17, 17, 17, 22, 22]
    assert [r["previous_adjusted_close"] for r in got] == [None, 20.5, 17.5, 18.5, 17.5, 25.5]
    assert got[4]["remaining_min_log_ratio"] == pytest.approx(np.log(22 / 17.5))
    oracle = rows(monthly_oracle(out), "month")
    assert [(r["month"], r["oracle_trading_day"], r["days_in_month"]) for r in oracle] == [("2022-05", 2, 4), ("2022-06", 2, 2)]


def test_prior_close_survives_the_first_month_cut(spark):
    dates = [day("2024-01-31"), day("2024-02-01"), day("2024-03-01")]
    out = add_monthly_labels(daily(spark, dates, [10, 9, 8]), first_month="2024-02")
    assert column(out, "previous_adjusted_close") == [10.5]
    assert column(last_complete_month(daily(spark, dates, [10, 9, 8])), "complete_through") == ["2024-02"]


def test_no_complete_month_keeps_the_schema(spark):
    out = add_monthly_labels(daily(spark, [day("2024-01-02")], [10]))
    assert out.count() == 0 and "remaining_min_log_ratio" in out.columns


@pytest.mark.parametrize("bad", [-1.0, 0.0, float("inf"), None])
def test_unusable_opens_fail(spark, bad):
    frame = daily(spark, days("2024-01-02", 3), [1, 2, 3]).withColumn("adjusted_open", F.lit(bad).cast("double"))
    with pytest.raises(PySparkException):
        add_monthly_labels(frame, "2024-01").collect()


def test_parameters_are_checked(spark):
    frame = daily(spark, days("2024-01-02", 3), [1, 2, 3])
    for call in (lambda: add_monthly_labels(frame, "2024-13"), lambda: add_monthly_labels(frame, near_threshold=1.5),
                 lambda: from_month(frame, "2024-1"), lambda: S.fixed_day(0), lambda: Policy("x", 1.5),
                 lambda: Policy("x", deadline=0)):
        with pytest.raises(ValueError):
            call()
    for call in (lambda: S.fixed_day(True), lambda: Policy("x", "0.5"), lambda: Policy("x", use_reservation=1)):
        with pytest.raises(TypeError):
            call()


# ------------------------------------------------------------------------------------ leads
def lead(spark, dates, values):
    return spark.createDataFrame(list(zip(dates, map(float, values))), schemas.LEAD_PRICE)


def fx(spark, dates, values):
    return spark.createDataFrame(list(zip(dates, map(float, values))), schemas.FX)


def aligned(spark, source, targets):
    frame = spark.createDataFrame([("s", day(d), v) for d, v in source], "series string, date date, value double")
    asked = spark.createDataFrame([(day(d),) for d in targets], "date date")
    return column(L.align_prior_session(frame, asked, ("s",)), "value", "date")


def test_asof_takes_the_last_session_before_today(spark):
    assert aligned(spark, [("2024-03-08", -0.02), ("2024-03-11", 0.01)], ["2024-03-11", "2024-03-12"]) == [-0.02, 0.01]
    assert aligned(spark, [("2024-03-11", 0.05), ("2024-03-12", -0.09)], ["2024-03-12"]) == [0.05]
    assert aligned(spark, [("2024-03-11", 0.05), ("2024-03-12", None)], ["2024-03-11", "2024-03-14"]) == [None, 0.05]


def test_asof_agrees_with_merge_asof(spark):
    rng = np.random.default_rng(5)
    calendar = pd.date_range("2024-01-01", periods=120)
    source = pd.DataFrame({"date": calendar[rng.random(120) < 0.4]})
    source["value"] = np.where(rng.random(len(source)) < 0.2, np.nan, rng.normal(size=len(source)))
    targets = pd.DataFrame({"date": calendar[rng.random(120) < 0.5]})
    left = targets.assign(asof=targets["date"] - pd.Timedelta(days=1))
    want = pd.merge_asof(left, source.dropna().rename(columns={"date": "on"}), left_on="asof", right_on="on")["value"]
    got = aligned(spark, [(str(d.date()), None if np.isnan(v) else float(v)) for d, v in source.itertuples(index=False)],
                  [str(d.date()) for d in targets["date"]])
    np.testing.assert_allclose(np.array(got, dtype=float), want.to_numpy())


def with_leads(spark, dates, tsm, rates=None):
    source = [dates[0] - (dates[1] - dates[0]), *dates]
    flat = lead(spark, source, [100.0] * len(source))
    frame = daily(spark, dates, range(10, 10 + len(dates)))
    rates = rates or [31.0] * len(source)
    return L.attach_leads(frame, lead(spark, source[:len(tsm)], tsm), flat, fx(spark, source[:len(rates)], rates))


def test_currency_streak(spark):
    dates = days("2024-03-01", 6)
    signals = L.currency_signals(fx(spark, dates, [31.0, 31.2, 31.4, 31.6, 31.5, 31.4]))
    assert column(signals, "up_streak3", "date") == [0, 0, 0, 1, 0, 0]
    assert column(signals, "usd_twd_up", "date") == [0, 1, 1, 1, 0, 0]
    out = with_leads(spark, dates[1:], [100.0], [31.0, 31.2, 31.4, 31.6, 31.5, 31.4])
    assert column(out, "fx_not_depreciating", "date") == [True, True, True, False, True]


def test_one_percent_dump_and_missing_leads(spark):
    dates = days("2024-03-02", 5)
    out = with_leads(spark, dates, [100, 99.5, 99, 97, 97, 97])
    got = rows(out, "date")
    # The first session has no return, so the first day sees none at all.
    assert [r["tsm_dump_1pct"] for r in got] == [False, False, False, True, False]
    assert got[0]["tsm_lead_ret"] is None and not got[0]["tsm_dump"] and not got[0]["tsm_not_dump"]
    assert [r["tsm_not_dump"] for r in got] == [False, False, False, False, True]


# -------------------------------------------------------------------------------- selection
def month_frame(spark, months: dict[str, int], **columns):
    """Rows of whole months; ``columns`` hold one list over all rows."""
    data, n = [], 0
    for month, count in months.items():
        for number in range(count):
            data.append(("X", month, day(f"{month}-01").replace(day=number + 1), number + 1, count, 0.01 * (number + 1),
                         100.0 + number, *[values[n] for values in columns.values()]))
            n += 1
    kinds = {bool: "boolean", float: "double", int: "double", type(None): "double"}
    extra = "".join(f", {name} {kinds[type(next((v for v in values if v is not None), None))]}" for name, values in columns.items())
    return spark.createDataFrame(
        data, "symbol string, month string, date date, trading_day int, days_in_month int, regret double, "
              "adjusted_open double" + extra)


def picked(df):
    return [(r["month"], r["trading_day"], r["forced"]) for r in rows(df, "month")]


def test_fixed_and_last_day(spark):
    frame = month_frame(spark, {"2024-01": 4, "2024-02": 2})
    assert column(S.select_fixed_day(frame, 3), "trading_day", "month") == [3, 2]
    assert column(S.select_last_day(frame), "trading_day", "month") == [4, 2]
    ruled = S.select_by_rules(frame, [S.fixed_day(3), S.last_day()])
    assert column(ruled.where("strategy = 'fixed_day_3'"), "trading_day", "month") == [3, 2]
    assert column(ruled.where("strategy = 'last_day'"), "trading_day", "month") == [4, 2]
    assert set(column(ruled, "forced")) == {None}


def test_rsi_rule_ignores_unknown_values(spark):
    frame = month_frame(spark, {"2024-01": 3, "2024-02": 2}, rsi_14=[None, 29.0, 10.0, 40.0, 30.0])
    assert column(S.select_rsi_rule(frame), "trading_day", "month") == [2, 2]


def test_signal_after_the_deadline_is_forced(spark):
    frame = month_frame(spark, {"2024-01": 7}, go=[False] * 5 + [True, True])
    assert picked(S.select_first_true_or_deadline(frame, "go", 5)) == [("2024-01", 5, True)]
    early = month_frame(spark, {"2024-01": 3}, go=[False, False, False])
    assert picked(S.select_first_true_or_deadline(early, "go", 5)) == [("2024-01", 3, True)]
    late = month_frame(spark, {"2024-01": 7}, go=[False] * 5 + [True, True]).where("trading_day >= 6")
    assert picked(S.select_first_true_or_deadline(late, "go", 5)) == [("2024-01", 6, False)]
    quiet = late.withColumn("go", F.lit(False))
    assert picked(S.select_first_true_or_deadline(quiet, "go", 5)) == [("2024-01", 6, True)]


def predictions(spark):
    return month_frame(
        spark, {"2024-01": 3, "2024-02": 2}, near_probability=[0.2, 0.8, 0.9, 0.1, 0.2],
        reservation_adjusted=[90.0, 101.0, 90.0, 200.0, 200.0])


def test_policies(spark):
    frame = predictions(spark)
    assert picked(S.select_monthly_purchases(frame)) == [("2024-01", 2, False), ("2024-02", 2, True)]
    assert picked(S.select_monthly_purchases(frame, Policy("r", None, True, None))) == [("2024-01", 2, False), ("2024-02", 1, False)]
    assert picked(S.select_monthly_purchases(frame, Policy("d", 0.85, False, 2))) == [("2024-01", 2, True), ("2024-02", 2, True)]
    assert picked(S.select_monthly_purchases(frame, Policy("n", None, False, None))) == [("2024-01", 1, False), ("2024-02", 1, False)]


def test_incomplete_prediction_months_are_found(spark):
    frame = predictions(spark)
    assert Q.bad_prediction_months(frame).count() == 0
    assert column(Q.bad_prediction_months(frame.where("NOT (month = '2024-01' AND trading_day = 2)")), "month") == ["2024-01"]
    assert Q.bad_prediction_months(frame.withColumn("near_probability", F.lit(1.2))).count() == 2
    assert Q.repeated_purchases(frame.withColumn("strategy", F.lit("s"))).count() == 2


# ---------------------------------------------------------------------------------- metrics
def test_metrics_match_pandas(spark):
    rng = np.random.default_rng(1)
    regret = rng.exponential(0.03, 37)
    frame = spark.createDataFrame(
        [("X", "s", float(r), int(n % 20) + 1, bool(n % 3 == 0), 50.0 + n) for n, r in enumerate(regret)],
        "symbol string, strategy string, regret double, trading_day int, forced boolean, adjusted_open double")
    got = rows(M.strategy_metrics(frame))[0]
    series = pd.Series(regret)
    for name, level in (("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95)):
        assert got[f"{name}_regret"] == pytest.approx(series.quantile(level))
    assert got["within_1pct_rate"] == pytest.approx((series <= 0.01).mean())
    assert got["forced_rate"] == pytest.approx(13 / 37)
    terminal = spark.createDataFrame([("X", 80.0)], "symbol string, terminal_adjusted_close double")
    wealth = rows(M.terminal_wealth(frame, terminal))[0]["terminal_wealth_proxy"]
    assert wealth == pytest.approx(sum(10_000 / 1.001425 / (50.0 + n) for n in range(37)) * 80)


def test_profile_uses_average_ranks(spark):
    rng = np.random.default_rng(2)
    data = [("X", f"2024-{m:02d}", n == 3, None if rng.random() < 0.2 else float(rng.integers(0, 5)))
            for m in range(1, 13) for n in range(8)]
    frame = spark.createDataFrame(data, "symbol string, month string, is_oracle boolean, ret_1 double")
    pdf = pd.DataFrame(data, columns=["symbol", "month", "is_oracle", "ret_1"])
    ranks = pdf.groupby("month")["ret_1"].rank(pct=True)[pdf["is_oracle"]].dropna()
    got = rows(M.oracle_feature_profile(frame))[0]
    assert got["oracle_mean_percentile"] == pytest.approx(ranks.mean()) and got["months"] == len(ranks)


def test_average_precision_merges_equal_scores(spark):
    data = [("X", 0.9, True), ("X", 0.8, False), ("X", 0.8, True), ("X", 0.5, False), ("X", 0.1, True)]
    frame = spark.createDataFrame(data, "symbol string, near_probability double, near_optimal boolean")
    want = (1 / 3) * 1.0 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5)
    assert column(M.average_precision(frame), "average_precision") == pytest.approx([want])
    none = frame.withColumn("near_optimal", F.lit(False))
    assert column(M.average_precision(none), "average_precision") == [0.0]


def test_verdicts_and_roles(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (-2.0, -1.0), (-1.0, 1.0)], "low double, high double")
    assert [r["v"] for r in frame.select(C.verdict(F.col("low"), F.col("high")).alias("v")).collect()] == [
        "better", "worse", "inconclusive"]
    roles = spark.createDataFrame([(0.0, 2.2), (0.22, 3.4), (0.0, 1.1)], "f double, d double")
    assert [r["v"] for r in roles.select(C.rule_role(F.col("f"), F.col("d")).alias("v")).collect()] == [
        "delayed_day1", "filter", "almost_day1"]


# ------------------------------------------------------------------------------ comparison
def test_bootstrap_of_a_constant_series():
    assert C.block_interval([0.01] * 24) == pytest.approx([0.01, 0.01])
    with pytest.raises(ValueError):
        C.block_interval([0.01])


def test_bootstrap_follows_its_definition():
    values = np.random.default_rng(9).normal(size=31)
    starts = np.random.default_rng(42).integers(0, 31, size=(50, 6))
    means = []
    for row in starts:
        sample = [values[(start + k) % 31] for start in row for k in range(6)][:31]
        means.append(np.mean(sample))
    want = np.quantile(means, [0.025, 0.975])
    assert C.block_interval(values, 6, 50) == pytest.approx(list(want))


def purchases(spark, regrets, strategy="s"):
    months = [str(p) for p in pd.period_range("2020-01", periods=len(regrets), freq="M")]
    return spark.createDataFrame([("X", strategy, m, float(r)) for m, r in zip(months, regrets)],
                                 "symbol string, strategy string, month string, regret double")


def test_paired_improvement_and_interval(spark):
    rng = np.random.default_rng(4)
    base, other = rng.random(30), rng.random(30)
    got = rows(C.paired_improvement(purchases(spark, other), purchases(spark, base, "b"), simulations=300))[0]
    assert got["improvement_bps"] == pytest.approx((base - other).mean() * 1e4)
    assert got["ci95_bps"] == pytest.approx([v * 1e4 for v in C.block_interval(base - other, simulations=300)])
    native = rows(C.hashed_interval(C.pair_months(purchases(spark, other), purchases(spark, base, "b"))))[0]
    # Another source of randomness, the same distribution.
    assert native["ci95_low_bps"] == pytest.approx(got["ci95_bps"][0], abs=250)
    assert native["ci95_high_bps"] == pytest.approx(got["ci95_bps"][1], abs=250)


def test_random_strategy_follows_its_definition(spark):
    frame = month_frame(spark, {"2024-01": 5, "2024-02": 3, "2024-03": 4})
    generator, total = np.random.default_rng(42), np.zeros(400)
    for count in (5, 3, 4):
        values = 0.01 * np.arange(1, count + 1)
        total += values[generator.integers(0, count, size=400)]
    got = rows(C.random_strategy(frame, 400))[0]
    assert got["mean_regret"] == pytest.approx((total / 3).mean())
    assert [got["ci95_low"], got["ci95_high"]] == pytest.approx(list(np.quantile(total / 3, [0.025, 0.975])))


def test_best_fixed_day_prefers_the_earlier_of_equals(spark):
    frame = month_frame(spark, {"2024-01": 16}).withColumn("regret", F.lit(0.02))
    assert column(C.best_fixed_day(frame), "selected_day") == [1]
    cheaper = frame.withColumn("regret", F.when(F.col("trading_day") == 10, 0.01).otherwise(F.col("regret")))
    assert column(C.best_fixed_day(cheaper), "selected_day") == [10]


def test_oracle_distribution_on_a_known_table(spark):
    data = [("X", n, d) for n, d in enumerate([1, 1, 6, 6, 12, 20])]
    frame = spark.createDataFrame(data, "symbol string, month int, oracle_trading_day int")
    got = rows(M.oracle_distribution(frame))[0]
    assert (got["months"], got["median_day"], got["mode_day"]) == (6, 6.0, 1)
    assert got["mean_day"] == pytest.approx(46 / 6) and got["first_day_rate"] == pytest.approx(2 / 6)
    assert got["first_5_rate"] == pytest.approx(2 / 6) and got["first_10_rate"] == pytest.approx(4 / 6)


@pytest.mark.parametrize("simulations", [1, 499, 500, 501, 2_300])
def test_simulations_of_one_symbol_go_to_several_tasks(spark, simulations):
    dealt = C.dealt_simulations(spark.createDataFrame([("A", [1.0])], "symbol string, s array<double>"), ("symbol",), simulations)
    found = dealt.withColumn("task", F.spark_partition_id()).toPandas()
    assert sorted(found["sim"]) == list(range(simulations)) and set(found["symbol"]) == {"A"}
    assert simulations < 2_300 or found["task"].nunique() > 1
