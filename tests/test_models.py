"""Walk-forward folds, estimators, stored folds, and the whole job on a small market."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.session import written
from tests.conftest import column, rows
from tidemark.config import POLICIES, US_VT, ModelConfig
from tidemark.operators import models, walkforward as W
from tidemark.plans import research

FEATURES = {"small": ("a", "b", "c")}
CONFIG = ModelConfig(initial_months=4, trees=10)


def market(months: int = 8, per_month: int = 12, seed: int = 0) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    parts = []
    for n, month in enumerate(pd.period_range("2020-01", periods=months, freq="M")):
        frame = pd.DataFrame({"symbol": "X", "date": [d.date() for d in pd.bdate_range(str(month), periods=per_month)]})
        frame["month"] = str(month)
        frame["trading_day"], frame["days_in_month"] = np.arange(1, per_month + 1), per_month
        parts.append(frame)
    out = pd.concat(parts, ignore_index=True)
    out["a"], out["b"], out["c"] = rng.normal(size=len(out)), rng.integers(0, 3, len(out)).astype(float), 1.0
    out.loc[rng.random(len(out)) < 0.1, "a"] = np.nan
    out["adjusted_open"], out["regret"] = 100.0, rng.random(len(out)) * 0.05
    out["near_optimal"] = out["a"].fillna(0) + rng.normal(0, 0.5, len(out)) > 0.7
    out["previous_adjusted_close"] = 101.0
    out["remaining_min_log_ratio"] = out["a"].fillna(0) * -0.01 + rng.normal(0, 0.002, len(out))
    out.loc[0, "remaining_min_log_ratio"] = np.nan
    out["adjustment_factor"] = 0.5
    return out


SCHEMA = ("symbol string, date date, month string, trading_day int, days_in_month int, a double, b double, c double, "
          "adjusted_open double, regret double, near_optimal boolean, previous_adjusted_close double, "
          "remaining_min_log_ratio double, adjustment_factor double")


def table(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), SCHEMA)


def test_folds_train_on_earlier_months_only(spark):
    folds = rows(W.expanding_folds(table(spark, market()), 4), "test_month")
    assert [f["test_month"] for f in folds] == ["2020-05", "2020-06", "2020-07", "2020-08"]
    assert [f["training_through"] for f in folds] == ["2020-04", "2020-05", "2020-06", "2020-07"]
    assert [f["train_rows"] for f in folds] == [48, 60, 72, 84]


def test_predictions_do_not_change_when_later_data_does(spark):
    frame = market()
    whole = W.walk_forward(table(spark, frame), CONFIG, FEATURES)
    got = rows(whole, "date")
    assert len(got) == 48 and {r["feature_set"] for r in got} == {"small"}
    assert all(r["training_through"] < r["month"] for r in got)
    assert all(0 <= r["near_probability"] <= 1 and r["reservation_adjusted"] > 0 for r in got)
    assert got[0]["reservation_adjusted"] == pytest.approx(101.0 * np.exp(got[0]["predicted_remaining_log_ratio"]) * 1.005)
    assert got[0]["reservation_raw"] == pytest.approx(got[0]["reservation_adjusted"] / 0.5)
    cut = W.walk_forward(table(spark, frame[frame["month"] <= "2020-06"]), CONFIG, FEATURES, buckets=2)
    early = rows(cut, "date")
    assert [r["near_probability"] for r in early] == pytest.approx([r["near_probability"] for r in got[:24]])
    assert [r["predicted_remaining_log_ratio"] for r in early] == pytest.approx(
        [r["predicted_remaining_log_ratio"] for r in got[:24]])


def test_spark_folds_equal_a_plain_loop(spark):
    frame = market(seed=3)
    got = W.walk_forward(table(spark, frame), CONFIG, FEATURES).orderBy("date").toPandas()
    for month in ("2020-05", "2020-08"):
        train, test = frame[frame["month"] < month], frame[frame["month"] == month]
        want = models.fit_and_score(train, test, list(FEATURES["small"]), CONFIG)
        here = got[got["month"] == month]
        np.testing.assert_allclose(here["near_probability"], want["near_probability"], rtol=1e-9)
        np.testing.assert_allclose(here["predicted_remaining_log_ratio"], want["predicted_remaining_log_ratio"], rtol=1e-9)


def test_states_merge_to_the_whole():
    from tidemark.operators.expanding import Expanding

    rng = np.random.default_rng(8)
    for _ in range(40):
        parts = [np.where(rng.random(n) < 0.3, np.nan, rng.normal(50, 1e-3, n).round(5)) for n in rng.integers(0, 9, 6)]
        state = Expanding()
        for n, part in enumerate(parts):
            state.merge(Expanding(part))
            whole = np.concatenate(parts[:n + 1])
            fill = np.nanmedian(whole) if (~np.isnan(whole)).any() else 0.0
            full = np.where(np.isnan(whole), fill, whole)
            assert state.fill() == pytest.approx(fill) and state.missing == np.isnan(whole).sum()
            if len(full):
                assert state.moments() == pytest.approx((full.mean(), full.std()), rel=1e-9, abs=1e-9)
    apart = Expanding(parts[0]).merge(Expanding(np.concatenate(parts[1:])))
    assert apart.moments() == pytest.approx(state.moments(), abs=1e-9)


def test_stored_folds_are_not_run_again(spark):
    frame = market()
    first = W.fingerprints(table(spark, frame), CONFIG, FEATURES)
    assert W.folds_to_score(first, first).count() == 0
    moved = frame.copy()
    moved.loc[moved["month"] == "2020-07", "a"] = 9.0
    later = W.folds_to_score(W.fingerprints(table(spark, moved), CONFIG, FEATURES), first)
    assert sorted(column(later, "test_month")) == ["2020-07", "2020-08"]
    other = W.folds_to_score(W.fingerprints(table(spark, frame), replace(CONFIG, trees=11), FEATURES), first)
    assert other.count() == 4
    # A missing value is not the same as its absence in another column.
    holed = frame.assign(a=frame["b"].where(frame.index < 0), b=frame["a"])
    assert W.folds_to_score(W.fingerprints(table(spark, holed), CONFIG, FEATURES), first).count() == 4
    half = W.walk_forward(table(spark, frame), CONFIG, FEATURES, stored=first.where("test_month <> '2020-06'"))
    assert set(column(half, "month")) == {"2020-06"}


def test_stored_predictions_are_reused(spark):
    frame = market()
    first = W.predictions(table(spark, frame), CONFIG, FEATURES)
    stored = written(first, "stored")
    plain = rows(stored, "date")
    again = W.predictions(table(spark, frame), CONFIG, FEATURES, stored)
    assert W.folds_to_score(W.fingerprints(table(spark, frame), CONFIG, FEATURES), stored).count() == 0
    assert rows(again, "date") == plain
    moved = frame.copy()
    moved.loc[moved["month"] == "2020-07", "a"] = 9.0
    later = W.predictions(table(spark, moved), CONFIG, FEATURES, stored)
    assert later.count() == len(plain) and later.select("date").distinct().count() == len(plain)
    priced = frame.assign(adjusted_open=frame["adjusted_open"] * 0.9, previous_adjusted_close=frame["previous_adjusted_close"] * 0.9)
    restated = rows(W.predictions(table(spark, priced), CONFIG, FEATURES, stored), "date")
    assert [r["near_probability"] for r in restated] == [r["near_probability"] for r in plain]
    assert [r["adjusted_open"] for r in restated] == pytest.approx([0.9 * r["adjusted_open"] for r in plain])
    assert [r["reservation_adjusted"] for r in restated] == pytest.approx([0.9 * r["reservation_adjusted"] for r in plain])


def test_one_class_history_gives_that_class():
    frame = market()
    frame["near_optimal"] = False
    assert set(models.near_probability(frame, frame.head(3), ["a"], CONFIG)) == {0.0}
    with pytest.raises(ValueError):
        models.remaining_log_ratio(frame.assign(remaining_min_log_ratio=np.nan), frame.head(3), ["a"], CONFIG)


def test_logistic_is_a_stationary_point():
    rng = np.random.default_rng(1)
    x, weight = rng.normal(size=(200, 4)), rng.random(200)
    y = rng.random(200) < 0.3
    beta = models.logistic(x, y, weight, 0.1, 100)
    p = models.sigmoid(x @ beta[:-1] + beta[-1])
    assert np.abs(x.T @ (weight * (p - y)) + beta[:-1] / 0.1).max() < 1e-6
    assert abs(weight @ (p - y)) < 1e-6


def slow_split(columns, rows_, slope, weight, leaf):
    """Every cut of every feature, tried one by one."""
    best, found = -1.0, None
    for feature, values in enumerate(columns):
        for cut in sorted(set(values[rows_]))[:-1]:
            left = rows_[values[rows_] <= cut]
            right = rows_[values[rows_] > cut]
            if min(len(left), len(right)) < leaf:
                continue
            wl, wr = weight[left].sum(), weight[right].sum()
            gap = (weight[left] @ slope[left]) / wl - (weight[right] @ slope[right]) / wr
            gain = wl * wr / (wl + wr) * gap**2
            if gain > best + 1e-12:
                best, found = gain, (feature, set(left))
    return best, found


@pytest.mark.parametrize("seed", range(6))
def test_best_split_is_the_exhaustive_best(seed):
    rng = np.random.default_rng(seed)
    columns = np.vstack([rng.normal(size=80), rng.integers(0, 4, 80), np.ones(80)]).astype(float)
    slope, weight = rng.choice([-0.5, 0.5], 80), rng.random(80)
    order = np.argsort(columns, axis=1, kind="stable")
    feature, threshold = models.best_split(columns, order, slope * weight, weight, 10)
    gain, (want, left) = slow_split(columns, np.arange(80), slope, weight, 10)
    got = np.flatnonzero(columns[feature] <= threshold)
    rest = np.setdiff1d(np.arange(80), got)
    wl, wr = weight[got].sum(), weight[rest].sum()
    gap = (weight[got] @ slope[got]) / wl - (weight[rest] @ slope[rest]) / wr
    assert wl * wr / (wl + wr) * gap**2 == pytest.approx(gain)
    assert min(len(got), len(rest)) >= 10


def test_no_split_without_room_or_difference():
    columns = np.vstack([np.ones(50), np.zeros(50)])
    order = np.argsort(columns, axis=1, kind="stable")
    assert models.best_split(columns, order, np.linspace(-1, 1, 50), np.ones(50), 10) is None
    assert models.best_split(columns[:, :15], order[:, :15] % 15, np.ones(15), np.ones(15), 10) is None


def test_weighted_quantile_is_a_step():
    values, weight = np.array([3.0, 1.0, 2.0]), np.array([1.0, 1.0, 2.0])
    assert models.weighted_quantile(values, weight, 0.5) == 2.0
    assert models.weighted_quantile(values, weight, 0.2) == 1.0


def test_config_is_checked():
    for bad in ({"initial_months": 0}, {"trees": 0}, {"reservation_buffer": 0.2}, {"max_depth": 3}):
        with pytest.raises(ValueError):
            ModelConfig(**bad)
    with pytest.raises(TypeError):
        ModelConfig(initial_months=True)
    assert [p.name for p in POLICIES][3:] == ["prob_and_res_deadline5", "prob_only_deadline5", "res_only_deadline5"]


def test_whole_study_from_files(spark, tmp_path):
    from tidemark import schemas
    from tidemark.operators.assemble import assemble_us_daily
    from tidemark.sources import landed, runs

    rng = np.random.default_rng(0)
    dates = [d.date() for d in pd.bdate_range("2019-12-10", "2020-11-20")]
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, len(dates))))
    prices = spark.createDataFrame(
        [(s, d, float(c), float(c * 1.01), float(c * 0.99), float(c), float(c), 1000.0)
         for s in ("VT", "VX") for d, c in zip(dates, close)], schemas.US_OHLC)
    daily = assemble_us_daily(prices)
    for name in set(schemas.DAILY.fieldNames()) - set(daily.columns):
        daily = daily.withColumn(name, F.lit(None).cast("double"))
    daily.select(*schemas.DAILY.fieldNames()).write.parquet(str(tmp_path / "daily"))
    for name, filename in landed.LEAD_FILES.items():
        value = "usd_twd" if name == "fx" else "adj_close"
        pd.DataFrame({"date": dates, value: close[::-1]}).to_csv(tmp_path / filename, index=False, encoding="utf-8-sig")
    preset = replace(US_VT, first_complete_month="2020-01", holdout=("2020-09", "2020-10"),
                     model=ModelConfig(initial_months=5, trees=5))
    presets = [preset, replace(preset, code="VX", first_complete_month="2020-03")]
    found = research.research_from_files(spark, str(tmp_path / "daily"), str(tmp_path), str(tmp_path / "out"), presets)
    assert list(found) == ["technical_calendar-0"]
    tables = found["technical_calendar-0"]
    assert {r["symbol"]: r["oos_months"] for r in rows(tables["meta"])} == {"VT": 5, "VX": 3}
    assert column(tables["monthly_oracle"], "month", "month")[-1] == "2020-10"
    stored = runs.latest(spark, str(tmp_path / "out"))
    back = stored["technical_calendar-0/policy_ablation"]
    assert stored["technical_calendar-0/results_json"].count() == tables["strategy_metrics"].count()
    assert rows(stored["refused"]) == []
    policies = rows(back.where("symbol = 'VT'"))
    assert len(policies) == 6 and all(len(r["ci95_bps"]) == 2 and r["verdict"] for r in policies)
    metrics = {r["strategy"]: r for r in rows(tables["strategy_metrics"].where("symbol = 'VT'"))}
    assert set(metrics) == {"fixed_day_1", "fixed_day_5", "fixed_day_10", "fixed_day_15", "last_day", "rsi30_or_last",
                            "technical_calendar"}
    assert metrics["technical_calendar"]["brier"] is not None and metrics["last_day"]["forced_rate"] is None
    assert len(rows(tables["lead_rules"])) == 12
    assert column(tables["lead_coverage"], "tsm_available_rate") == [1.0, 1.0]
    assert column(tables["data_quality"], "rows") == [len(dates)] * 2
    assert rows(tables["holdout"].where("symbol = 'VT'"))[0]["months"] == 2
    primary = rows(tables["primary"].where("symbol = 'VT'"))[0]
    chosen = next(r for r in policies if r["strategy"] == "prob_and_res")
    assert primary["improvement_bps"] == pytest.approx(chosen["improvement_bps"])
    names = set(column(tables["oracle_feature_profile"], "feature"))
    assert "ret_5" in names and "fund_flow_5" not in names


def test_every_symbol_follows_a_preset_the_default_or_is_refused(spark, tmp_path, monkeypatch):
    from tidemark import schemas
    from tidemark.sources import landed, runs

    path = str(tmp_path / "daily")
    blank = [F.lit(None).cast(field.dataType).alias(field.name) for field in schemas.DAILY.fields if field.name != "symbol"]
    spark.createDataFrame([("VT",), ("VX",), ("Q",)], "symbol string").select("symbol", *blank).write.parquet(path)
    taken = []

    def study(daily, *_, **__):
        taken.append({r["symbol"]: r["first_complete_month"] for r in rows(daily)})
        return {"strategy_metrics": spark.range(1)}

    monkeypatch.setattr(research, "run_research", study)
    monkeypatch.setattr(landed, "load_leads", lambda *_: dict.fromkeys(landed.LEAD_FILES))
    presets = [replace(US_VT, first_complete_month="2020-01"),
               replace(US_VT, code="VX", first_complete_month="2020-03", primary_model="all")]
    research.research_from_files(spark, path, "", str(tmp_path / "a"), presets)
    assert taken == [{"VT": "2020-01"}, {"VX": "2020-03"}]
    assert rows(runs.latest(spark, str(tmp_path / "a"))["refused"]) == [{"symbol": "Q", "reason": "no preset"}]
    taken.clear()
    research.research_from_files(spark, path, "", str(tmp_path / "b"), presets, replace(US_VT, first_complete_month="2021-01"))
    assert taken == [{"VT": "2020-01", "Q": "2021-01"}, {"VX": "2020-03"}]
