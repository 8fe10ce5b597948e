"""Queries over comparison, models, ordering, functions and whole jobs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.catalog.ingest import fresh, year_files
from tidemark.catalog.monthly import PROFILE, WEALTH, _ranks
from tidemark.catalog.registry import case, columns, tidy
from tidemark.catalog.sqltext import FEATURE_LIST, IN_DATE_ORDER, METRICS, rounded
from tidemark.config import BOOTSTRAP_SIMULATIONS, FEATURE_SETS, TW_0050, ModelConfig
from tidemark.functions import scalars as X
from tidemark.operators import compare as C, metrics as M, selection as S, walkforward as W
from tidemark.operators.quality import KEY
from tidemark.plans import research
from tidemark.plans.daily import daily_from_files
from tidemark.session import written
from tidemark.sources.standin import DEVELOPMENT_START, FIRST_MONTH, HOLDOUT, INITIAL_MONTHS

MODEL = ModelConfig(initial_months=INITIAL_MONTHS)
STAND_IN = replace(TW_0050, code="stand-in", first_complete_month=FIRST_MONTH, holdout=HOLDOUT, model=MODEL)
SIMULATIONS = BOOTSTRAP_SIMULATIONS
GAIN = "round(avg(b.regret - c.regret) * 10000e0, 4) AS improvement_bps"


# ---------------------------------------------------------------------------- comparison
@case("sta_01_paired_improvement", f"""
SELECT symbol, c.strategy, count(*) AS months, {GAIN}
FROM policy_bought c JOIN day1 b USING (symbol, month) GROUP BY symbol, c.strategy""")
def _(s):
    return tidy(C.paired_improvement(s.policy_bought, s.day1, with_interval=False), digits=4)


def _bootstrap_sql(simulations: int) -> dict[str, str]:
    return {
        "series": """SELECT symbol, c.strategy AS strategy, b.regret - c.regret AS gain,
            row_number() OVER (PARTITION BY symbol, c.strategy ORDER BY month) - 1 AS pos,
            count(*) OVER (PARTITION BY symbol, c.strategy) AS n
          FROM policy_bought c JOIN day1 b USING (symbol, month)""",
        "draws": f"""SELECT k.*, sim, blk, off,
            (('0x' || substr(md5(sim || '-' || blk || '-42'), 1, 8))::BIGINT % n + off) % n AS pos
          FROM (SELECT DISTINCT symbol, strategy, n FROM series) k, range({simulations}) a(sim), range(20) b(blk), range(12) c(off)
          WHERE off < least(12, n) AND blk * least(12, n) + off < n""",
        "means": """SELECT d.symbol, d.strategy, d.sim, avg(gain) AS mean
          FROM draws d JOIN series s ON s.symbol = d.symbol AND s.strategy = d.strategy AND s.pos = d.pos GROUP BY ALL""",
    }


@case("sta_02_block_bootstrap", """
SELECT symbol, strategy, round(quantile_cont(mean, 0.025) * 10000e0, 4) AS ci95_low_bps,
       round(quantile_cont(mean, 0.975) * 10000e0, 4) AS ci95_high_bps FROM means GROUP BY symbol, strategy""",
      **_bootstrap_sql(SIMULATIONS))
def _(s):
    return tidy(C.hashed_interval(C.pair_months(s.policy_bought, s.day1), simulations=SIMULATIONS), digits=4)


@case("sta_02_block_bootstrap_library_generator")
def _(s):
    result = C.paired_improvement(s.policy_bought, s.day1)
    return tidy(result.select("symbol", "strategy", "improvement_bps", F.col("ci95_bps")[0].alias("ci95_low_bps"),
                              F.col("ci95_bps")[1].alias("ci95_high_bps")), digits=4)


@case("sta_03_random_strategy", f"""
SELECT symbol, round(avg(mean), 6) AS mean_regret, round(quantile_cont(mean, 0.025), 6) AS ci95_low,
       round(quantile_cont(mean, 0.975), 6) AS ci95_high
FROM (SELECT d.symbol AS symbol, sim, avg(regret) AS mean
      FROM (SELECT m.symbol, m.month, sim, ('0x' || substr(md5(sim || '-' || no || '-42'), 1, 8))::BIGINT % n + 1 AS day
            FROM (SELECT symbol, month, count(*) AS n,
                         row_number() OVER (PARTITION BY symbol ORDER BY month) - 1 AS no FROM oos GROUP BY symbol, month) m,
                 range({SIMULATIONS}) r(sim)) d
      JOIN oos o ON o.symbol = d.symbol AND o.month = d.month AND o.trading_day = d.day GROUP BY d.symbol, sim)
GROUP BY symbol""")
def _(s):
    return tidy(C.hashed_random_strategy(s.oos, SIMULATIONS))


@case("sta_03_random_strategy_library_generator")
def _(s):
    return tidy(C.random_strategy(s.oos))


COMPARED = f"""
SELECT symbol, c.strategy, {METRICS.replace('regret', 'c.regret').replace('mean_c.regret', 'mean_regret')
    .replace('median_c.regret', 'median_regret').replace('p75_c.regret', 'p75_regret')
    .replace('p90_c.regret', 'p90_regret').replace('p95_c.regret', 'p95_regret')
    .replace('trading_day', 'c.trading_day').replace('mean_c.trading_day', 'mean_trading_day')
    .replace('(forced', '(c.forced')},
  round(sum(10000e0 / (1e0 + 0.001425e0) / c.adjusted_open) * max(terminal_close), 4) AS terminal_wealth_proxy,
  {GAIN},
  round(avg(c.regret) FILTER (held), 6) AS holdout_mean_regret,
  round(coalesce(avg(CAST(c.forced AS DOUBLE)) FILTER (held), 0e0), 6) AS holdout_forced_rate,
  round(avg(c.trading_day) FILTER (held), 6) AS holdout_mean_trading_day,
  round(avg(b.regret - c.regret) FILTER (held) * 10000e0, 4) AS holdout_improvement_bps
FROM (SELECT *, month BETWEEN '2000-07' AND '2001-10' AS held FROM %s) c
JOIN day1 b USING (symbol, month) JOIN terminal USING (symbol) GROUP BY symbol, c.strategy"""
COARSE = ("terminal_wealth_proxy", "improvement_bps", "holdout_improvement_bps")


def compared(df):
    fine = tidy(df, COARSE)
    return tidy(fine, set(fine.columns) - set(COARSE), 4)


@case("sta_04_compare_to_day1", COMPARED % "lead_bought")
def _(s):
    return compared(C.compare_to_day1(s.lead_bought, s.day1, s.terminal, HOLDOUT, with_interval=False))


@case("sta_05_holdout", """
SELECT f.symbol, count(*) AS months, any_value(f.selected_day) AS selected_day,
       round(avg(f.regret), 6) AS day1_mean_regret,
       round(avg(CAST(f.regret <= 0.005e0 AS DOUBLE)), 6) AS day1_within_rate,
       round(avg(m.regret), 6) AS model_mean_regret,
       round(avg(f.regret - m.regret) * 10000e0, 6) AS model_improvement_bps
FROM (SELECT l.*, selected_day FROM labelled l JOIN (
        SELECT symbol, arg_min(CAST(day AS INTEGER), (mean, day)) AS selected_day FROM (
          SELECT symbol, d.day, avg(regret) AS mean FROM labelled, (VALUES (1), (5), (10), (15)) d(day)
          WHERE month >= '2000-02' AND month < '2000-07' AND trading_day = least(days_in_month, d.day) GROUP BY ALL)
        GROUP BY symbol) USING (symbol)
      WHERE month BETWEEN '2000-07' AND '2001-10' AND trading_day = least(days_in_month, selected_day)) f
JOIN (SELECT * FROM policy_bought WHERE strategy = 'prob_and_res') m USING (symbol, month) GROUP BY f.symbol""")
def _(s):
    model = s.policy_bought.where("strategy = 'prob_and_res'")
    return tidy(C.holdout_result(s.labelled, model, DEVELOPMENT_START, HOLDOUT, with_interval=False))


@case("sta_06_day1_against_day5", f"""
SELECT symbol, c.strategy, count(*) AS months, {GAIN} FROM day1 c
JOIN (SELECT * FROM baseline WHERE strategy = 'fixed_day_5') b USING (symbol, month) GROUP BY symbol, c.strategy""")
def _(s):
    fixed = S.select_by_rules(s.oos, [S.fixed_day(1), S.fixed_day(5)])
    return tidy(C.paired_improvement(fixed.where("strategy = 'fixed_day_1'"), fixed.where("strategy = 'fixed_day_5'"),
                                     with_interval=False), digits=4)


@case("sta_07_verdicts", """
SELECT symbol, strategy, CASE WHEN low > 0 AND high > 0 THEN 'better' WHEN low < 0 AND high < 0 THEN 'worse'
       ELSE 'inconclusive' END AS verdict
FROM (SELECT symbol, strategy, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high
      FROM means GROUP BY symbol, strategy)""", **_bootstrap_sql(SIMULATIONS))
def _(s):
    ci = C.hashed_interval(C.pair_months(s.policy_bought, s.day1), simulations=SIMULATIONS)
    return ci.select("symbol", "strategy", C.verdict(F.col("ci95_low_bps"), F.col("ci95_high_bps")).alias("verdict"))


@case("sta_08_rule_roles", """
SELECT symbol, strategy, CASE WHEN f < 0.05 AND d < 1.35 THEN 'almost_day1' WHEN f < 0.05 THEN 'delayed_day1'
       ELSE 'filter' END AS role
FROM (SELECT symbol, strategy, avg(CAST(forced AS DOUBLE)) AS f, avg(trading_day) AS d FROM lead_bought GROUP BY ALL)""")
def _(s):
    metrics = M.strategy_metrics(s.lead_bought)
    return metrics.select("symbol", "strategy", C.rule_role(F.col("forced_rate"), F.col("mean_trading_day")).alias("role"))


@case("sta_09_all_holdout_negative", """
SELECT symbol, bool_and(gain < 0) AS all_holdout_negative FROM (
  SELECT symbol, c.strategy, avg(b.regret - c.regret) AS gain FROM lead_bought c JOIN day1 b USING (symbol, month)
  WHERE month BETWEEN '2000-07' AND '2001-10' GROUP BY ALL) GROUP BY symbol""")
def _(s):
    return C.all_holdout_negative(C.compare_to_day1(s.lead_bought, s.day1, s.terminal, HOLDOUT, with_interval=False))


@case("sta_10_all_strategies", COMPARED % "(SELECT * FROM policy_bought UNION ALL BY NAME SELECT * FROM lead_bought)")
def _(s):
    both = s.policy_bought.unionByName(s.lead_bought, allowMissingColumns=True)
    return compared(C.compare_to_day1(both, s.day1, s.terminal, HOLDOUT, with_interval=False))


# -------------------------------------------------------------------------------- models
@case("ml_01_expanding_folds", """
SELECT symbol, month AS test_month, test_rows, train_months, train_rows FROM (
  SELECT symbol, month, count(*) AS test_rows,
         row_number() OVER (PARTITION BY symbol ORDER BY month) - 1 AS train_months,
         CAST(sum(count(*)) OVER (PARTITION BY symbol ORDER BY month) - count(*) AS BIGINT) AS train_rows
  FROM labelled GROUP BY symbol, month) WHERE train_months >= 60""")
def _(s):
    folds = W.expanding_folds(s.labelled, INITIAL_MONTHS)
    return folds.select("symbol", "test_month", "test_rows", "train_months", "train_rows")


_PREPARED = """
SELECT f.symbol, f.month AS test_month, t.feature, round(coalesce(median(value), 0e0), 6) AS fill,
       count(value) < count(*) AS has_gaps
FROM (SELECT DISTINCT symbol, month FROM oos) f JOIN values_long t ON t.symbol = f.symbol AND t.month < f.month
GROUP BY ALL"""
_LONG = " UNION ALL ".join(
    f"SELECT symbol, month, '{n}' AS feature, CAST({n} AS DOUBLE) AS value FROM labelled" for n in FEATURE_SETS["all"])


@case("ml_02_median_fill", _PREPARED, values_long=_LONG)
def _(s):
    prepared = W.fold_preparation(written(s.labelled_features, "labelled"), MODEL)
    return tidy(prepared.select("symbol", "test_month", "feature", "fill", "has_gaps"))


@case("ml_03_standardise", """
SELECT p.symbol, p.month AS test_month, p.feature, round(avg(coalesce(value, mid)), 6) AS mean,
       round(stddev_pop(coalesce(value, mid)), 6) AS spread
FROM (SELECT f.symbol, f.month, t.feature, t.value, median(t.value) OVER (PARTITION BY f.symbol, f.month, t.feature) AS mid
      FROM (SELECT DISTINCT symbol, month FROM oos) f JOIN values_long t ON t.symbol = f.symbol AND t.month < f.month) p
GROUP BY ALL""", values_long=_LONG)
def _(s):
    prepared = W.fold_preparation(written(s.labelled_features, "labelled"), MODEL)
    return tidy(prepared.select("symbol", "test_month", "feature", "mean", "spread"))


def _walk(s, *names: str):
    labelled = written(s.labelled_features, "labelled")
    return W.walk_forward(labelled, MODEL, {name: FEATURE_SETS[name] for name in names})


@case("ml_04_near_probability")
def _(s):
    return columns(_walk(s, "technical_calendar"), "symbol, date, near_probability", "training_through")


@case("ml_05_remaining_log_ratio")
def _(s):
    return columns(_walk(s, "technical_calendar"), "symbol, date, predicted_remaining_log_ratio", "training_through")


@case("ml_06_reservation_price", f"""
SELECT symbol, date, round(previous_adjusted_close * exp(r) * 1.005e0, 6) AS reservation_adjusted,
       round(previous_adjusted_close * exp(r) * 1.005e0 / adjustment_factor, 6) AS reservation_raw
FROM (SELECT *, (date - DATE '1970-01-01') * 37 % 100 / 100e0 / 20 - 0.04e0 AS r FROM oos)""")
def _(s):
    day = F.unix_date("date")
    scored = s.oos.withColumn("predicted_remaining_log_ratio", day * 37 % 100 / F.lit(100.0) / 20 - 0.04)
    return columns(W.reservation_prices(scored, MODEL), "symbol, date, reservation_adjusted, reservation_raw")


@case("ml_07_walk_forward")
def _(s):
    return columns(_walk(s, "all"), "symbol, date, near_probability, predicted_remaining_log_ratio, "
                   "reservation_adjusted, reservation_raw", "month, feature_set, training_through")


@case("ml_08_model_scores")
def _(s):
    predictions = written(_walk(s, *FEATURE_SETS), "predictions")
    models = research.model_purchases(research.policy_purchases(predictions))
    return tidy(research.model_metrics(models, predictions, s.terminal))


@case("ml_09_fingerprints")
def _(s):
    return W.fingerprints(s.labelled_features, MODEL)


# ------------------------------------------------------------------- ordering and set work
@case("srt_01_by_date", "SELECT symbol, date, close FROM prices ORDER BY symbol, date")
def _(s):
    return s.prices.select(*KEY, "close").orderBy("symbol", "date")


@case("srt_02_first_row_per_month", """
SELECT symbol, strftime(date, '%Y-%m') AS month, min(date) AS date, arg_min(open, date) AS open FROM prices GROUP BY ALL""")
def _(s):
    return s.prices.groupBy("symbol", X.month_of("date").alias("month")).agg(
        F.min("date").alias("date"), F.min_by("open", "date").alias("open"))


@case("srt_03_by_distance", PROFILE, ranked=_ranks(FEATURE_SETS["all"]))
def _(s):
    return tidy(M.by_distance(M.oracle_feature_profile(s.labelled_features)))


@case("srt_04_top_features", f"""
SELECT symbol, feature, place FROM (
  SELECT symbol, feature, CAST(row_number() OVER (PARTITION BY symbol ORDER BY abs(distance_from_median) DESC, feature)
    AS INTEGER) AS place FROM ({PROFILE})) WHERE place <= 12""", ranked=_ranks(FEATURE_SETS["all"]))
def _(s):
    profile = tidy(M.oracle_feature_profile(s.labelled_features))
    return M.top_features(profile).select("symbol", "feature", "place")


@case("srt_05_best_fixed_day", """
SELECT symbol, arg_min(CAST(day AS INTEGER), (mean, day)) AS selected_day FROM (
  SELECT symbol, d.day, avg(regret) AS mean FROM labelled, (VALUES (1), (5), (10), (15)) d(day)
  WHERE trading_day = least(days_in_month, d.day) GROUP BY ALL) GROUP BY symbol""")
def _(s):
    return C.best_fixed_day(s.labelled)


@case("set_01_union_purchases", """
SELECT symbol, strategy, count(*) AS rows FROM (
  SELECT symbol, strategy FROM policy_bought UNION ALL SELECT symbol, strategy FROM lead_bought
  UNION ALL SELECT symbol, strategy FROM baseline) GROUP BY ALL""")
def _(s):
    parts = [df.select("symbol", "strategy") for df in (s.policy_bought, s.lead_bought, s.baseline)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("symbol", "strategy").agg(
        F.count(F.lit(1)).alias("rows"))


@case("set_02_distinct_first", """
SELECT l_orderkey, min(l_linenumber) AS first_line, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_orderkey""")
def _(s):
    return s.table("lineitem").groupBy("l_orderkey").agg(
        F.min("l_linenumber").alias("first_line"), F.count_distinct("l_suppkey").alias("suppliers"))


@case("set_03_feature_columns", f"SELECT symbol, date, {rounded(FEATURE_LIST.replace('trading_day, ', ''))}, trading_day FROM features")
def _(s):
    names = [name for name in dict.fromkeys(n for key in FEATURE_SETS for n in FEATURE_SETS[key]) if name != "trading_day"]
    return columns(s.features, "symbol, date, " + ", ".join(names), "trading_day")


# ----------------------------------------------------------------------- scalar functions
@case("str_01_roc_date", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders")
def _(s):
    date = F.col("o_orderdate").cast("date")
    text = F.concat(F.lit(" "), (F.year(date) - 1911).cast("string"), F.date_format(date, "/MM/dd"))
    return s.table("orders").select(X.roc_date(text).alias("date")).distinct()


@case("str_02_contains", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '%URG%'")
def _(s):
    return s.table("orders").where(F.col("o_orderpriority").contains("URG")).select("o_orderkey")


@case("str_03_plain_number", "SELECT o_orderkey, round(o_totalprice, 2) AS total FROM orders")
def _(s):
    text = F.format_number("o_totalprice", 2)
    return tidy(s.table("orders").select("o_orderkey", X.plain_number(text).alias("total")), digits=2)


@case("num_01_lenient_cast", """
SELECT o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level,
       try_cast(o_orderpriority AS DOUBLE) AS none FROM orders""")
def _(s):
    return s.table("orders").select(
        "o_orderkey", X.number(F.split("o_orderpriority", "-")[0]).alias("level"),
        X.number("o_orderpriority").alias("none"))


@case("num_02_math", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(f"round({e}, 6) AS {n}" for n, e in {
    "size": "abs(l_discount - 0.05e0)", "clipped": "greatest(-0.01e0, least(0.01e0, l_discount - 0.05e0))",
    "logged": "ln(l_extendedprice)", "powered": "exp(l_tax)", "root": "sqrt(l_quantity)",
    "sine": "sin(l_quantity)", "cosine": "cos(l_quantity)"}.items())},
  round_even(l_extendedprice / 100, 0) AS whole, ceil(l_extendedprice / 7) AS up FROM lineitem""")
def _(s):
    line = s.table("lineitem")
    shift = F.col("l_discount") - 0.05
    return columns(line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.abs(shift).alias("size"),
        X.clip(shift, -0.01, 0.01).alias("clipped"), F.ln("l_extendedprice").alias("logged"),
        F.exp("l_tax").alias("powered"), F.sqrt("l_quantity").alias("root"), F.sin("l_quantity").alias("sine"),
        F.cos("l_quantity").alias("cosine"), F.rint(F.col("l_extendedprice") / 100).alias("whole"),
        F.ceil(F.col("l_extendedprice") / 7).cast("double").alias("up")),
        "l_orderkey, l_linenumber, l_partkey, l_suppkey, size, clipped, logged, powered, root, sine, cosine",
        "whole, up")


@case("num_03_null_rules", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / nullif(l_discount, 0), 6) AS ratio,
       coalesce(nullif(l_tax, 0), -1e0) AS filled, CASE WHEN l_tax > 0.04e0 THEN l_tax END AS masked FROM lineitem""")
def _(s):
    tax = F.col("l_tax")
    return columns(s.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        X.ratio(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio"),
        F.coalesce(F.nullif(tax, F.lit(0.0)), F.lit(-1.0)).alias("filled"), F.when(tax > 0.04, tax).alias("masked")),
        "l_orderkey, l_linenumber, l_partkey, l_suppkey, ratio", "filled, masked")


@case("num_04_row_extremes", "SELECT symbol, date, greatest(open, close, low) AS top, least(open, close, high) AS bottom FROM prices")
def _(s):
    return s.prices.select(*KEY, F.greatest("open", "close", "low").alias("top"), F.least("open", "close", "high").alias("bottom"))


@case("dat_01_calendar_parts", """
SELECT DISTINCT date, strftime(date, '%Y-%m') AS month, strftime(date - INTERVAL 1 MONTH, '%Y-%m') AS before,
       CAST(day(last_day(date)) AS INTEGER) AS days, CAST(isodow(date) - 1 AS INTEGER) AS weekday FROM prices""")
def _(s):
    date = F.col("date")
    return s.prices.select("date", X.month_of("date").alias("month"), X.previous_month(date).alias("before"),
                           F.dayofmonth(F.last_day(date)).alias("days"), F.weekday(date).alias("weekday")).distinct()


@case("dat_02_shifted_dates", "SELECT DISTINCT date, date - 1 AS day_before, date - 365 AS year_before FROM prices")
def _(s):
    return s.prices.select("date", F.date_sub("date", 1).alias("day_before"), F.date_sub("date", 365).alias("year_before")).distinct()


@case("dat_03_between", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-31' AND DATE '1998-02-28'")
def _(s):
    low, high = F.lit("1996-01-31").cast("date"), F.lit("1998-02-28").cast("date")
    return s.table("orders").where(F.col("o_orderdate").cast("date").between(low, high)).select("o_orderkey")


@case("dat_04_month_text", "SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM prices")
def _(s):
    return s.prices.select(X.month_text(X.month_of("date")).alias("month")).distinct()


@case("boo_01_unknown_is_false", "SELECT symbol, date, coalesce(rsi_14 < 30, false) AS low FROM features")
def _(s):
    return s.features.select(*KEY, X.holds(F.col("rsi_14") < 30).alias("low"))


@case("jsn_01_nested_rows", "SELECT symbol, date, margin_balance, short_balance FROM margin")
def _(s):
    from tidemark.catalog.ingest import envelope, renamed
    from tidemark.sources.parsers import MARGIN_FIELDS, open_envelope, parse_margin

    return parse_margin(open_envelope(envelope(s.margin, *renamed(MARGIN_FIELDS)), ("date", *MARGIN_FIELDS)))


@case("jsn_02_metrics_json", """
SELECT symbol, '{"strategy":"' || strategy || '","months":' || count(*) || '}' AS body FROM policy_bought GROUP BY symbol, strategy""")
def _(s):
    metrics = M.strategy_metrics(s.policy_bought)
    return metrics.select("symbol", F.to_json(F.struct("strategy", "months")).alias("body"))


@case("udf_01_own_estimator")
def _(s):
    def share(train, test, features, config):
        import pandas as pd

        return pd.DataFrame({"near_probability": [float(train["near_optimal"].mean())] * len(test),
                             "predicted_remaining_log_ratio": [0.0] * len(test)})

    labelled = written(s.labelled_features, "labelled")
    scored = W.walk_forward(labelled, MODEL, {"all": FEATURE_SETS["all"]}, estimator=share)
    return columns(scored, "symbol, date, near_probability, reservation_adjusted")


@case("udf_02_reverse_running_minimum", f"SELECT symbol, date, {rounded('remaining_min_adjusted_open')} FROM labelled")
def _(s):
    return columns(s.labelled, "symbol, date, remaining_min_adjusted_open")


@case("udf_03_first_hit_without_loop", "SELECT symbol, month, strategy, trading_day, forced FROM lead_bought")
def _(s):
    return s.lead_bought.select("symbol", "month", "strategy", "trading_day", "forced")


@case("udf_04_actions_without_loop", f"SELECT symbol, date, {rounded('distribution_yield_ttm', 7)}, split_ratio FROM us_daily")
def _(s):
    return columns(s.us_daily, "symbol, date, distribution_yield_ttm", "split_ratio", 7)


# -------------------------------------------------------------------------------- whole jobs
@case("e2e_01_prepare", f"""
SELECT symbol, date, {rounded("ret_20, rsi_14, volume_z_20, fund_flow_5, regret, remaining_min_log_ratio")},
       trading_day, days_in_month, oracle_date, near_optimal FROM labelled""")
def _(s):
    parts = research.prepare(s.daily, FIRST_MONTH)
    return columns(parts.labelled, "symbol, date, ret_20, rsi_14, volume_z_20, fund_flow_5, regret, remaining_min_log_ratio",
                   "trading_day, days_in_month, oracle_date, near_optimal")


@case("e2e_01_prepare_wide", f"""
SELECT symbol, date, {rounded("ret_20, rsi_14, volume_z_20, fund_flow_5, regret, remaining_min_log_ratio")},
       trading_day, days_in_month, oracle_date, near_optimal FROM labelled""", symbols="supplier", **IN_DATE_ORDER)
def _(s):
    parts = research.prepare(s.daily, FIRST_MONTH)
    return columns(parts.labelled, "symbol, date, ret_20, rsi_14, volume_z_20, fund_flow_5, regret, remaining_min_log_ratio",
                   "trading_day, days_in_month, oracle_date, near_optimal")


@case("e2e_02_daily_table", f"""
SELECT symbol, date, {rounded("nav, adjusted_close, adjusted_open, total_return_index, distribution_yield_ttm", 7)},
       close, volume, margin_balance, institutional_net, official_close, feature_available_date,
       official_close_source FROM daily""")
def _(s):
    return columns(s.daily, "symbol, date, nav, adjusted_close, adjusted_open, total_return_index, distribution_yield_ttm",
                   "close, volume, margin_balance, institutional_net, official_close, feature_available_date, "
                   "official_close_source", 7)


@case("e2e_02_landed_files", f"""
SELECT symbol, date, {rounded("nav, cash_dividend, adjusted_close, adjusted_open, total_return_index, distribution_yield_ttm", 7)},
       close, volume, split_ratio, margin_balance, institutional_net, official_close, feature_available_date,
       official_close_source FROM daily""")
def _(s):
    root = fresh(s, "landed")
    for name, payloads in year_files(s.landed, s.institutions_raw).items():
        # one response per file, as the vendors' answers land
        payloads.write.partitionBy("symbol").option("maxRecordsPerFile", 1).text(f"{root}/{name}")
    return columns(daily_from_files(s.spark, root, fresh(s, "daily")),
                   "symbol, date, nav, cash_dividend, adjusted_close, adjusted_open, total_return_index, distribution_yield_ttm",
                   "close, volume, split_ratio, margin_balance, institutional_net, official_close, feature_available_date, "
                   "official_close_source", 7)


DAY1 = f"SELECT symbol, {METRICS} FROM (SELECT *, CAST(NULL AS BOOLEAN) AS forced FROM labelled WHERE trading_day = 1) GROUP BY symbol"


@case("e2e_day1_regret", f"SELECT * EXCLUDE (forced_rate) FROM ({DAY1})")
def _(s):
    return tidy(research.day1_regret(s.adjusted, FIRST_MONTH))


@case("e2e_day1_regret_wide", f"SELECT * EXCLUDE (forced_rate) FROM ({DAY1})", symbols="supplier")
def _(s):
    return tidy(research.day1_regret(s.adjusted, FIRST_MONTH))


@case("e2e_03_strategy_metrics", f"""
SELECT symbol, strategy, {METRICS}, {WEALTH} FROM (
  SELECT symbol, strategy, month, regret, trading_day, adjusted_open, forced FROM baseline UNION ALL
  SELECT symbol, strategy, month, regret, trading_day, adjusted_open, forced FROM policy_bought UNION ALL
  SELECT symbol, strategy, month, regret, trading_day, adjusted_open, forced FROM lead_bought)
JOIN terminal USING (symbol) GROUP BY symbol, strategy""")
def _(s):
    names = ("symbol", "strategy", "month", "regret", "trading_day", "adjusted_open", "forced")
    rows = s.oos_features
    both = S.baseline_rules()
    bought = S.select_by_rules(rows, both).select(*names)
    for part in (s.policy_bought, s.lead_bought):
        bought = bought.unionByName(part.select(*names))
    wealth = tidy(M.metrics_with_wealth(bought, s.terminal), ("terminal_wealth_proxy",))
    return tidy(wealth, set(wealth.columns) - {"terminal_wealth_proxy"}, 4)


@case("e2e_03_full_study")
def _(s):
    daily = written(s.daily, "daily")
    tables = research.run_research(daily, s.tsm, s.sox, s.fx, STAND_IN)
    plain = ["symbol", "strategy", "months", "mean_regret", "forced_rate", "mean_trading_day", "terminal_wealth_proxy"]
    extra = ["improvement_bps", "holdout_improvement_bps", "verdict"]
    models = tables["strategy_metrics"].select(*plain)
    ruled = tables["policy_ablation"].select(*plain, *extra).unionByName(tables["lead_rules"].select(*plain, *extra))
    return tidy(ruled.unionByName(models, allowMissingColumns=True), digits=4)


@case("e2e_04_presets_by_symbol", """
SELECT symbol, min(month) AS first_month, count(*) AS rows FROM labelled
WHERE month >= CASE WHEN symbol LIKE 'A%' THEN '1996-01' ELSE '1998-07' END GROUP BY symbol""")
def _(s):
    presets = [replace(STAND_IN, code=code, first_complete_month="1996-01") for code in ("AF", "AO")]
    daily = written(s.daily, "daily")
    firsts = research.first_months(daily, presets, replace(STAND_IN, first_complete_month="1998-07"))
    parts = research.prepare(daily.join(firsts, "symbol"), F.col("first_complete_month"))
    return parts.labelled.groupBy("symbol").agg(F.min("month").alias("first_month"), F.count(F.lit(1)).alias("rows"))
