"""Queries over labels, once-a-month selection and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import case, columns, tidy
from tidemark.catalog.sqltext import IN_DATE_ORDER, METRICS, first_hit, rounded
from tidemark.config import ALL_FEATURES, POLICIES, RANGE_FEATURES, RANGE_FEATURES_LOCAL
from tidemark.operators import metrics as M, selection as S
from tidemark.operators.walkforward import expanding_folds
from tidemark.sources.standin import INITIAL_MONTHS

KEY = ("symbol", "date")


# -------------------------------------------------------------------------------- labels
@case("lab_01_days_in_month", "SELECT symbol, date, days_in_month FROM labelled")
def _(s):
    return s.labelled.select(*KEY, "days_in_month")


@case("lab_02_oracle_price", f"SELECT symbol, date, {rounded('oracle_adjusted_open')} FROM labelled")
def _(s):
    return columns(s.labelled, "symbol, date, oracle_adjusted_open")


@case("lab_03_oracle_date", "SELECT DISTINCT symbol, month, oracle_date FROM labelled")
def _(s):
    return s.labelled.select("symbol", "month", "oracle_date").distinct()


@case("lab_04_regret", f"SELECT symbol, date, {rounded('regret')} FROM labelled")
def _(s):
    return columns(s.labelled, "symbol, date, regret")


@case("lab_05_flags", "SELECT symbol, date, is_oracle, near_optimal FROM labelled")
def _(s):
    return s.labelled.select(*KEY, "is_oracle", "near_optimal")


@case("lab_06_remaining_minimum", f"SELECT symbol, date, {rounded('remaining_min_adjusted_open')} FROM labelled")
def _(s):
    return columns(s.labelled, "symbol, date, remaining_min_adjusted_open")


@case("lab_07_previous_close", f"SELECT symbol, date, {rounded('previous_adjusted_close')} FROM labelled")
def _(s):
    return columns(s.labelled, "symbol, date, previous_adjusted_close")


@case("lab_08_remaining_log_ratio", f"SELECT symbol, date, {rounded('remaining_min_log_ratio')} FROM labelled")
def _(s):
    return columns(s.labelled, "symbol, date, remaining_min_log_ratio")


LABELS = "regret, oracle_adjusted_open, remaining_min_adjusted_open, previous_adjusted_close, remaining_min_log_ratio"
FLAGS = "month, trading_day, days_in_month, oracle_date, is_oracle, near_optimal"


@case("lab_09_labelled_table", f"SELECT symbol, date, {rounded(LABELS)}, {FLAGS} FROM labelled")
def _(s):
    return columns(s.labelled, f"symbol, date, {LABELS}", FLAGS)


ORACLE = "symbol, month, oracle_date, oracle_open, oracle_trading_day, days_in_month"


@case("lab_10_monthly_oracle", f"SELECT {ORACLE}, {rounded('oracle_adjusted_open')} FROM oracle")
def _(s):
    return columns(s.oracle, "oracle_adjusted_open", ORACLE)


@case("lab_10_monthly_oracle_wide", f"SELECT {ORACLE}, {rounded('oracle_adjusted_open')} FROM oracle", symbols="supplier",
      **IN_DATE_ORDER)
def _(s):
    return columns(s.oracle, "oracle_adjusted_open", ORACLE)


# ----------------------------------------------------------------------------- selection
def bought(df, extra: str = ""):
    return df.select("symbol", "month", "date", "trading_day", *[x for x in extra.split(", ") if x])


@case("sel_01_fixed_day", "SELECT symbol, month, date, trading_day FROM oos WHERE trading_day = least(days_in_month, 10)")
def _(s):
    return bought(S.select_fixed_day(s.oos, 10))


@case("sel_02_last_day", "SELECT symbol, month, date, trading_day FROM oos WHERE trading_day = days_in_month")
def _(s):
    return bought(S.select_last_day(s.oos))


@case("sel_03_rsi_rule", f"SELECT symbol, month, date, trading_day FROM ({first_hit('oos', 'rsi', 'rsi_14 < 30', None)})")
def _(s):
    return bought(S.select_rsi_rule(s.oos_features))


@case("sel_04_signal_or_deadline", f"SELECT symbol, month, date, trading_day, forced FROM ({first_hit('oos', 'x', 'tsm_dump_1pct', 5)})")
def _(s):
    return bought(S.select_first_true_or_deadline(s.oos_led, "tsm_dump_1pct"), "forced")


# Months whose first row is later than the deadline: that row stands for the window.
@case("sel_04_first_row_stands_in", """
SELECT symbol, month, date, trading_day, NOT (adjusted_open > 1.02e0 * oracle_adjusted_open) AS forced
FROM oos WHERE trading_day = 6""")
def _(s):
    late = s.oos.where("trading_day >= 6").withColumn("dear", F.col("adjusted_open") > 1.02 * F.col("oracle_adjusted_open"))
    return bought(S.select_first_true_or_deadline(late, "dear", 5), "forced")


@case("sel_05_policy_purchases", f"""
SELECT symbol, month, date, trading_day, forced FROM policy_bought WHERE strategy = 'prob_and_res'""")
def _(s):
    return bought(S.select_monthly_purchases(s.predictions, POLICIES[0]), "forced")


@case("sel_06_all_policies", "SELECT symbol, month, date, trading_day, strategy, forced FROM policy_bought")
def _(s):
    return bought(s.policy_bought, "strategy, forced")


@case("sel_07_lead_rules", "SELECT symbol, month, date, trading_day, strategy, forced FROM lead_bought")
def _(s):
    return bought(s.lead_bought, "strategy, forced")


@case("sel_08_baselines", "SELECT symbol, month, date, trading_day, strategy, forced FROM baseline")
def _(s):
    return bought(s.baseline, "strategy, forced")


# ---------------------------------------------------------------------------- aggregates
@case("agg_01_strategy_metrics", f"SELECT symbol, strategy, {METRICS} FROM policy_bought GROUP BY symbol, strategy")
def _(s):
    return tidy(M.strategy_metrics(s.policy_bought))


WEALTH = "round(sum(10000e0 / (1e0 + 0.001425e0) / adjusted_open) * max(terminal_close), 4) AS terminal_wealth_proxy"


@case("agg_02_terminal_wealth", f"""
SELECT symbol, strategy, {WEALTH} FROM policy_bought JOIN terminal USING (symbol) GROUP BY symbol, strategy""")
def _(s):
    return tidy(M.terminal_wealth(s.policy_bought, s.terminal), digits=4)


@case("agg_03_metrics_with_wealth", f"""
SELECT symbol, strategy, {METRICS}, {WEALTH} FROM baseline JOIN terminal USING (symbol) GROUP BY symbol, strategy""")
def _(s):
    wealth = M.metrics_with_wealth(s.baseline, s.terminal)
    both = tidy(wealth, ("terminal_wealth_proxy",))
    return tidy(both, set(both.columns) - {"terminal_wealth_proxy"}, 4)


@case("agg_04_oracle_distribution", """
SELECT symbol, months, round(mean_day, 6) AS mean_day, round(median_day, 6) AS median_day, mode_day,
       round(first_day_rate, 6) AS first_day_rate, round(first_5_rate, 6) AS first_5_rate,
       round(first_10_rate, 6) AS first_10_rate
FROM (SELECT symbol, count(*) AS months, avg(oracle_trading_day) AS mean_day, median(oracle_trading_day) AS median_day,
             avg(CAST(oracle_trading_day = 1 AS DOUBLE)) AS first_day_rate,
             avg(CAST(oracle_trading_day <= 5 AS DOUBLE)) AS first_5_rate,
             avg(CAST(oracle_trading_day <= 10 AS DOUBLE)) AS first_10_rate FROM oracle GROUP BY symbol)
JOIN (SELECT symbol, oracle_trading_day AS mode_day FROM (
        SELECT symbol, oracle_trading_day, row_number() OVER (PARTITION BY symbol
                 ORDER BY count(*) DESC, oracle_trading_day) AS rn FROM oracle GROUP BY symbol, oracle_trading_day)
      WHERE rn = 1) USING (symbol)""")
def _(s):
    return tidy(M.oracle_distribution(s.oracle))


_RANGED = RANGE_FEATURES + RANGE_FEATURES_LOCAL
_GAP = "g.open / (g.prev_close / g.split_ratio - g.cash_dividend) - 1 AS open_gap_vs_action_ref"


@case("agg_05_oracle_ranges", f"""
SELECT symbol, feature, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS median,
       round(quantile_cont(value, 0.75), 6) AS q75, round(avg(value), 6) AS mean, count(*) AS n
FROM (UNPIVOT (SELECT l.symbol, {', '.join('l.' + n for n in _RANGED[1:])}, {_GAP}
               FROM labelled l JOIN (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close
                                     FROM with_events) g USING (symbol, date) WHERE l.is_oracle)
      ON {', '.join(_RANGED)} INTO NAME feature VALUE value)
GROUP BY symbol, feature HAVING count(DISTINCT value) > 1""")
def _(s):
    return tidy(M.oracle_ranges(s.labelled_features, s.adjusted))


def _ranks(names) -> str:
    return " UNION ALL ".join(
        f"SELECT symbol, month, is_oracle, '{n}' AS feature, {n} IS NOT NULL AS known, "
        f"(rank() OVER (PARTITION BY symbol, month ORDER BY {n} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY symbol, month, {n}) - 1) / 2e0) "
        f"/ count({n}) OVER (PARTITION BY symbol, month) AS pct FROM labelled" for n in names)


PROFILE = """
SELECT symbol, feature, round(avg(pct), 6) AS oracle_mean_percentile,
       round(avg(pct) - 0.5e0, 6) AS distance_from_median, count(*) AS months
FROM ranked WHERE is_oracle AND known GROUP BY symbol, feature"""


@case("agg_06_oracle_profile", PROFILE, ranked=_ranks(ALL_FEATURES))
def _(s):
    return tidy(M.oracle_feature_profile(s.labelled_features))


@case("agg_07_lead_coverage", f"""
SELECT symbol, {', '.join(f"round(avg(CAST({sql} AS DOUBLE)), 6) AS {name}" for name, sql in {
    "tsm_available_rate": "tsm_lead_ret IS NOT NULL", "sox_available_rate": "sox_lead_ret IS NOT NULL",
    "fx_available_rate": "usd_twd_up IS NOT NULL", "tsm_dump_rate": "tsm_dump", "sox_dump_rate": "sox_dump",
    "fx_pause_rate": "NOT fx_not_depreciating", "tsm_dump_1pct_rate": "tsm_dump_1pct",
    "tsm_adverse_rate": "NOT tsm_not_dump", "fx_single_pause_rate": "NOT fx_not_up"}.items())}
FROM oos GROUP BY symbol""")
def _(s):
    return tidy(M.lead_coverage(s.oos_led))


@case("agg_08_signal_rates", f"""
UNPIVOT (SELECT symbol, {', '.join(f"round(avg(CAST({column} AS DOUBLE)), 6) AS {name}" for name, column in {
    "tsm_neg_or_day5": "tsm_dump", "sox_neg_or_day5": "sox_dump", "fx_pause_or_day5": "fx_not_depreciating",
    "tsm_dump1pct_or_day5": "tsm_dump_1pct", "tsm_buy_unless_adverse": "tsm_not_dump",
    "fx_single_pause_or_day5": "fx_not_up"}.items())} FROM oos GROUP BY symbol)
ON COLUMNS(* EXCLUDE symbol) INTO NAME strategy VALUE signal_rate""")
def _(s):
    return tidy(M.signal_rates(s.oos_led))


@case("agg_09_brier", """
SELECT symbol, round(avg(pow(near_probability - CAST(near_optimal AS DOUBLE), 2)), 6) AS brier
FROM predictions GROUP BY symbol""")
def _(s):
    return tidy(M.brier_score(s.predictions))


@case("agg_10_average_precision", """
SELECT symbol, round(sum(step * hits / rows), 6) AS average_precision FROM (
  SELECT symbol, p, n / sum(n) OVER (PARTITION BY symbol) AS step,
         sum(n) OVER (PARTITION BY symbol ORDER BY p DESC) AS hits,
         sum(c) OVER (PARTITION BY symbol ORDER BY p DESC) AS rows
  FROM (SELECT symbol, near_probability AS p, CAST(count(*) FILTER (near_optimal) AS DOUBLE) AS n,
               CAST(count(*) AS DOUBLE) AS c FROM predictions GROUP BY ALL)) GROUP BY symbol""")
def _(s):
    return tidy(M.average_precision(s.predictions))


@case("agg_11_oracle_histogram", "SELECT symbol, oracle_trading_day, count(*) AS months FROM oracle GROUP BY ALL")
def _(s):
    return M.oracle_day_histogram(s.oracle)


@case("agg_12_month_weights", """
SELECT symbol, date, round(1e0 / count(*) OVER (PARTITION BY symbol, month), 6) AS weight FROM labelled""")
def _(s):
    return columns(M.month_weights(s.labelled), "symbol, date, weight")


@case("agg_13_training_through", """
SELECT f.symbol, f.month AS test_month, max(t.month) AS training_through
FROM (SELECT DISTINCT symbol, month FROM oos) f JOIN (SELECT DISTINCT symbol, month FROM labelled) t
  ON t.symbol = f.symbol AND t.month < f.month GROUP BY ALL""")
def _(s):
    return expanding_folds(s.labelled, INITIAL_MONTHS).select("symbol", "test_month", "training_through")
