"""Queries over joins, corporate actions and daily features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.registry import case, columns, tidy
from tidemark.catalog.sqltext import FEATURE_LIST, rounded
from tidemark.config import TECHNICAL
from tidemark.operators import adjust as A, assemble, filters, leads as L
from tidemark.operators.features import build_features
from tidemark.operators.walkforward import (
    expanding_folds, fingerprints, folds_to_score,
)
from tidemark.session import written
from tidemark.sources.standin import DEVELOPMENT_START, FIRST_MONTH, HOLDOUT, INITIAL_MONTHS

KEY = ("symbol", "date")
OHLC = "open, high, low, close"


# ------------------------------------------------------------------------------- filters
@case("fil_01_last_complete_month", """
SELECT symbol, strftime(max(date) - INTERVAL 1 MONTH, '%Y-%m') AS complete_through FROM prices GROUP BY symbol""")
def _(s):
    return filters.last_complete_month(s.prices)


@case("fil_02_complete_months", """
SELECT symbol, date, strftime(date, '%Y-%m') AS month, close FROM prices
JOIN (SELECT symbol, max(date) AS last FROM prices GROUP BY symbol) USING (symbol)
WHERE strftime(date, '%Y-%m') < strftime(last, '%Y-%m')""")
def _(s):
    return filters.through_last_complete_month(s.prices).select(*KEY, "month", "close")


@case("fil_03_first_complete_month", """
SELECT symbol, date, close FROM prices WHERE date >= DATE '1995-02-01'""")
def _(s):
    dated = filters.through_last_complete_month(s.prices, "2001-12")
    return filters.from_month(dated, FIRST_MONTH).select(*KEY, "close")


@case("fil_04_out_of_sample", "SELECT symbol, min(month) AS first, count(*) AS rows FROM oos GROUP BY symbol")
def _(s):
    return s.oos.groupBy("symbol").agg(F.min("month").alias("first"), F.count(F.lit(1)).alias("rows"))


@case("fil_05_holdout", "SELECT symbol, date FROM labelled WHERE month BETWEEN '2000-07' AND '2001-10'")
def _(s):
    return filters.holdout(s.labelled, HOLDOUT).select(*KEY)


@case("fil_06_development", "SELECT symbol, date FROM labelled WHERE month >= '2000-02' AND month < '2000-07'")
def _(s):
    return filters.development(s.labelled, DEVELOPMENT_START, HOLDOUT[0]).select(*KEY)


@case("fil_07_feature_set", f"SELECT symbol, date, {rounded(', '.join(TECHNICAL))}, trading_day, {rounded('month_progress, weekday_sin, weekday_cos')} FROM features")
def _(s):
    return tidy(filters.feature_set(s.features, "technical_calendar"))


@case("fil_08_event_rows", f"""
SELECT symbol, date, 'dividend' AS kind, {rounded("cash_dividend", 10).replace("AS cash_dividend", "AS amount")} FROM with_events WHERE cash_dividend > 0
UNION ALL SELECT symbol, date, 'split', split_ratio FROM with_events WHERE split_ratio <> 1""")
def _(s):
    dividends, splits = A.events_of(A.attach_events(s.prices, s.dividends, s.splits))
    parts = [
        df.select(*KEY, F.lit(kind).alias("kind"), F.col(value).alias("amount"))
        for df, kind, value in ((dividends, "dividend", "cash_dividend"), (splits, "split", "split_ratio"))
    ]
    return tidy(parts[0].unionByName(parts[1]), digits=10)


# --------------------------------------------------------------------------------- joins
@case("join_01_attach_events", f"SELECT symbol, date, {rounded('cash_dividend', 10)}, {OHLC}, split_ratio FROM with_events")
def _(s):
    events = A.attach_events(s.prices, s.dividends, s.splits)
    return columns(events, "symbol, date, cash_dividend", f"{OHLC}, split_ratio", 10)


FLOWS = "institutional_net, foreign_net, trust_net, dealer_net"


@case("join_02_assemble", f"""
SELECT symbol, date, {rounded("nav", 9)}, close, margin_balance, short_balance, {FLOWS}, official_close,
       close_difference, institutional_available FROM daily""")
def _(s):
    m = s.landed
    joined = assemble.join_sources(
        m.prices, m.dividends, m.splits, m.nav, m.margin, s.institutions, m.official)
    return columns(joined, "symbol, date, nav", f"close, margin_balance, short_balance, {FLOWS}, "
                   "official_close, close_difference, institutional_available", 9)


@case("join_03_optional_side", "SELECT symbol, date, CAST(NULL AS DOUBLE) AS margin_balance, close FROM prices")
def _(s):
    return s.prices.join(s.margin.where("1 = 0"), list(KEY), "left").select(*KEY, "margin_balance", "close")


@case("join_04_availability", """
SELECT symbol, date, i.institutional_net IS NOT NULL AS institutional_available,
       coalesce(i.institutional_net, 0e0) AS institutional_net
FROM prices LEFT JOIN (SELECT * FROM institutions WHERE institutional_net > 0) i USING (symbol, date)""")
def _(s):
    m = s.landed
    joined = assemble.join_sources(
        m.prices, m.dividends, m.splits, m.nav, m.margin,
        s.institutions.where("institutional_net > 0"), m.official)
    return joined.select(*KEY, "institutional_available", "institutional_net")


@case("join_05_asof_prior_session", f"""
SELECT d.date, 'tsm_lead_ret' AS series, round(t.ret, 6) AS value
FROM (SELECT DISTINCT date, date - 1 AS asof FROM prices) d ASOF LEFT JOIN tsm_ret t ON d.asof >= t.date
UNION ALL
SELECT d.date, 'usd_twd_up', x.usd_twd_up
FROM (SELECT DISTINCT date, date - 1 AS asof FROM prices) d ASOF LEFT JOIN fx_up x ON d.asof >= x.date""")
def _(s):
    source = L.session_returns(s.tsm, "tsm_lead_ret").unionByName(
        L.currency_signals(s.fx).select("date", F.lit("usd_twd_up").alias("series"), F.col("usd_twd_up").alias("value")))
    aligned = L.align_prior_session(source, s.prices.select("date").distinct(), ("tsm_lead_ret", "usd_twd_up"))
    return tidy(aligned.select("date", "series", "value"))


@case("join_06_pair_months", f"""
SELECT symbol, c.strategy, month, round(b.regret - c.regret, 6) AS improvement
FROM policy_bought c JOIN day1 b USING (symbol, month)""")
def _(s):
    from tidemark.operators.compare import pair_months

    return tidy(pair_months(s.policy_bought, s.day1).select("symbol", "strategy", "month", "improvement"))


@case("join_07_oracle_gaps", f"""
SELECT o.symbol, o.month, round(p.open / (p.prev_close / p.split_ratio - p.cash_dividend) - 1, 6)
         AS open_gap_vs_action_ref
FROM oracle o JOIN (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM with_events) p
  ON p.symbol = o.symbol AND p.date = o.oracle_date""")
def _(s):
    gaps = A.open_gap(s.adjusted).select("symbol", F.col("date").alias("oracle_date"), "open_gap_vs_action_ref")
    return tidy(s.oracle.join(gaps, ["symbol", "oracle_date"]).select("symbol", "month", "open_gap_vs_action_ref"))


@case("join_08_month_to_oracle_date", "SELECT symbol, date, oracle_date FROM labelled")
def _(s):
    return s.labelled.select(*KEY, "oracle_date")


@case("join_09_dividends_and_later_splits", f"SELECT symbol, date, {rounded('distribution_yield_ttm', 8)} FROM yields")
def _(s):
    closes = s.prices.select(*KEY, "close")
    return tidy(A.distribution_yield(closes, s.dividends, s.splits).drop("close"), digits=8)


@case("join_10_expanding_train_sets", """
SELECT f.symbol, f.month AS test_month, count(DISTINCT t.month) AS train_months, count(*) AS train_rows,
       count(*) FILTER (t.near_optimal) AS train_near, max(t.month) AS training_through
FROM (SELECT symbol, month, row_number() OVER (PARTITION BY symbol ORDER BY month) AS n
      FROM (SELECT DISTINCT symbol, month FROM labelled)) f
JOIN labelled t ON t.symbol = f.symbol AND t.month < f.month WHERE f.n > 60 GROUP BY f.symbol, f.month""")
def _(s):
    folds = expanding_folds(s.labelled, INITIAL_MONTHS)
    return folds.select("symbol", "test_month", "train_months", "train_rows", "train_near", "training_through")


@case("join_11_folds_not_stored", """
SELECT symbol, set AS feature_set, count(*) AS folds FROM (
  SELECT DISTINCT symbol, month FROM oos WHERE month > '2001-06')
CROSS JOIN (VALUES ('all'), ('technical_calendar'), ('technical_valuation_calendar')) t(set) GROUP BY ALL""")
def _(s):
    from tidemark.config import ModelConfig

    wanted = written(
        fingerprints(s.labelled_features, ModelConfig(initial_months=INITIAL_MONTHS)), "fingerprints")
    stored = wanted.where("test_month <= '2001-06'")
    return folds_to_score(wanted, stored).groupBy("symbol", "feature_set").agg(F.count(F.lit(1)).alias("folds"))


@case("join_11_stored_predictions", """
SELECT symbol, count(*) AS folds, min(month) AS first, max(month) AS last FROM (
  SELECT DISTINCT symbol, month FROM oos WHERE month LIKE '%-02' OR month LIKE '%-05') GROUP BY symbol""")
def _(s):
    """Folds to score beside stored predictions of which February's are stale and May's were never made."""
    month = F.substring("month", 6, 2)
    print_ = F.when(month == "02", F.lit(-1)).otherwise(F.lit(1)).cast("long")
    stored = s.predictions.withColumns({"feature_set": F.lit("all"), "fingerprint": print_}).where(month != "05")
    wanted = s.predictions.select(
        "symbol", F.lit("all").alias("feature_set"), F.col("month").alias("test_month"), F.lit(1).cast("long").alias("fingerprint")).distinct()
    return folds_to_score(wanted, written(stored.select("symbol", "feature_set", "month", "date", "near_probability", "fingerprint"), "stored")
                          ).groupBy("symbol").agg(F.count(F.lit(1)).alias("folds"), F.min("test_month").alias("first"), F.max("test_month").alias("last"))


# ---------------------------------------------------------------------- corporate actions
@case("adj_01_merge_events", f"""
SELECT symbol, date, {rounded("cash", 9).replace("AS cash", "AS cash_dividend")}, ratio AS split_ratio FROM (
  SELECT symbol, date, sum(cash_dividend) AS cash FROM (SELECT * FROM dividends UNION ALL SELECT * FROM dividends) GROUP BY ALL)
FULL JOIN (SELECT symbol, date, product(split_ratio) AS ratio FROM (SELECT * FROM splits UNION ALL SELECT * FROM splits) GROUP BY ALL)
USING (symbol, date)""")
def _(s):
    cash = A.merge_dividends(s.dividends.unionByName(s.dividends))
    splits = A.merge_splits(s.splits.unionByName(s.splits))
    return columns(cash.join(splits, list(KEY), "full"), "symbol, date, cash_dividend", "split_ratio", 9)


@case("adj_02_gross_return", f"SELECT symbol, date, {rounded('gross_return', 8)} FROM indexed")
def _(s):
    return columns(s.adjusted, "symbol, date, gross_return", digits=8)


@case("adj_03_total_return_index", f"SELECT symbol, date, {rounded('total_return_index')} FROM indexed")
def _(s):
    return columns(s.adjusted, "symbol, date, total_return_index")


ADJUSTED = "adjusted_close, adjustment_factor, adjusted_open, adjusted_high, adjusted_low"


@case("adj_04_adjusted_prices", f"SELECT symbol, date, {rounded(ADJUSTED, 7)} FROM adjusted")
def _(s):
    return columns(s.adjusted, f"symbol, date, {ADJUSTED}", digits=7)


SPLIT_ADJUSTED = "split_adjusted_open, split_adjusted_high, split_adjusted_low, split_adjusted_close"


@case("adj_05_split_adjusted_prices", f"SELECT symbol, date, {SPLIT_ADJUSTED} FROM adjusted")
def _(s):
    return s.adjusted.select(*KEY, *SPLIT_ADJUSTED.split(", "))


@case("adj_06_build_adjusted_prices", f"""
SELECT symbol, date, {rounded("gross_return, total_return_index, adjusted_close, adjusted_open", 7)},
       split_adjusted_close, split_ratio FROM adjusted""")
def _(s):
    return columns(s.adjusted, "symbol, date, gross_return, total_return_index, adjusted_close, adjusted_open",
                   "split_adjusted_close, split_ratio", 7)


@case("adj_07_infer_actions", f"SELECT symbol, date, {rounded('cash_dividend')}, split_ratio FROM us_actions")
def _(s):
    return columns(A.infer_us_actions(s.us_ohlc), "symbol, date, cash_dividend", "split_ratio")


@case("adj_07_unexplained_moves", """
SELECT symbol, date FROM (
  SELECT *, (a / lag(a) OVER w) / (close / lag(close) OVER w) AS implied FROM (
    SELECT symbol, date, close, close * (CASE WHEN day(date) = 20 THEN 0.9e0 ELSE 1e0 END) AS a FROM prices)
  WINDOW w AS (PARTITION BY symbol ORDER BY date))
WHERE implied < 0.95e0""")
def _(s):
    factor = F.when(F.dayofmonth("date") == 20, 0.9).otherwise(1.0)
    flawed = s.prices.withColumn("adj_close", F.col("close") * factor)
    return A.unexplained_moves(flawed).select(*KEY)


US = "adjustment_factor, adjusted_open, total_return_index, gross_return, distribution_yield_ttm, trading_value"


@case("adj_08_vendor_daily", f"""
SELECT symbol, date, {rounded(US, 7)}, adjusted_close, feature_available_date, split_ratio FROM us_daily""")
def _(s):
    return columns(s.us_daily, f"symbol, date, {US}", "adjusted_close, feature_available_date, split_ratio", 7)


@case("adj_09_distribution_yield", f"SELECT symbol, date, {rounded('distribution_yield_ttm', 8)} FROM daily")
def _(s):
    return columns(s.daily, "symbol, date, distribution_yield_ttm", digits=8)


@case("adj_10_open_gap", """
SELECT symbol, date, round(open / (lag(close) OVER (PARTITION BY symbol ORDER BY date) / split_ratio - cash_dividend)
                           - 1, 8) AS open_gap_vs_action_ref FROM with_events""")
def _(s):
    return columns(A.open_gap(s.adjusted), "symbol, date, open_gap_vs_action_ref", digits=8)


@case("adj_11_feature_available_date", "SELECT symbol, date, feature_available_date FROM daily")
def _(s):
    return s.daily.select(*KEY, "feature_available_date")


@case("adj_12_close_difference", """
SELECT symbol, date, close - (close + (CASE WHEN day(date) = 9 THEN 0.02e0 ELSE 0e0 END)) AS close_difference FROM prices""")
def _(s):
    m = s.landed
    moved = m.official.withColumn(
        "official_close", F.col("official_close") + F.when(F.dayofmonth("date") == 9, 0.02).otherwise(0.0))
    joined = assemble.join_sources(m.prices, m.dividends, m.splits, m.nav, m.margin, s.institutions, moved)
    return joined.select(*KEY, "close_difference")


# ------------------------------------------------------------------------------ features
def feature_case(number: str, short: str, names: str) -> None:
    @case(f"fea_{number}_{short}", f"SELECT symbol, date, {rounded(names)} FROM features")
    def _(s):
        return columns(s.features, f"symbol, date, {names}")


feature_case("01", "returns", "ret_1, ret_5, ret_20, ret_60")
feature_case("02", "mean_gaps", "ma_gap_20, ma_gap_60")
feature_case("03", "rsi", "rsi_14")
feature_case("04", "bollinger", "bollinger_z_20")
feature_case("05", "drawdown", "drawdown_60")
feature_case("06", "volatility", "volatility_20")
feature_case("08", "volume_z", "volume_z_20")
feature_case("09", "premium", "premium_discount")
feature_case("11", "balance_changes", "margin_change_5, short_change_5, fund_flow_5")
feature_case("12", "institutional_ratio", "institutional_net_ratio")
feature_case("13", "institutional_flag", "institutional_data_available")
feature_case("15", "month_progress", "month_progress")
feature_case("16", "weekday", "weekday_sin, weekday_cos")


@case("fea_07_cumulative_split", "SELECT symbol, date, units AS cumulative_split FROM eod_base")
def _(s):
    from tidemark.functions.windows import running_product

    events = A.attach_events(s.prices, s.dividends, s.splits)
    return events.select(*KEY, running_product(F.col("split_ratio")).alias("cumulative_split"))


@case("fea_10_dividend_yield", f"SELECT symbol, date, {rounded('dividend_yield_ttm')} FROM features")
def _(s):
    return columns(s.features, "symbol, date, dividend_yield_ttm")


@case("fea_10_cash_yield_fallback", """
SELECT symbol, date, round(lag(y) OVER (PARTITION BY symbol ORDER BY date), 6) AS dividend_yield_ttm FROM (
  SELECT symbol, date, sum(cash_dividend) OVER (PARTITION BY symbol ORDER BY date
    RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW) / close AS y FROM daily)""")
def _(s):
    plain = build_features(s.daily.drop("distribution_yield_ttm"))
    return columns(plain, "symbol, date, dividend_yield_ttm")


@case("fea_14_trading_day", "SELECT symbol, date, trading_day FROM features")
def _(s):
    return s.features.select(*KEY, "trading_day")


@case("fea_17_build_features", f"SELECT symbol, date, {rounded(FEATURE_LIST.replace('trading_day, ', ''))}, trading_day FROM features")
def _(s):
    return columns(s.features, "symbol, date, " + FEATURE_LIST.replace("trading_day, ", ""), "trading_day")


@case("fea_18_session_returns", f"""
SELECT date, 'tsm' AS series, round(ret, 6) AS value FROM (
  SELECT date, adj_close / lag(adj_close) OVER (ORDER BY date) - 1 AS ret FROM tsm)
UNION ALL SELECT date, 'sox', round(ret, 6) FROM (
  SELECT date, adj_close / lag(adj_close) OVER (ORDER BY date) - 1 AS ret FROM sox)""")
def _(s):
    both = L.session_returns(s.tsm, "tsm").unionByName(L.session_returns(s.sox, "sox"))
    return tidy(both.select("date", "series", "value"))


@case("fea_19_currency_signals", "SELECT date, usd_twd_up, up_streak3 FROM fx_up")
def _(s):
    return L.currency_signals(s.fx)


LED = "tsm_lead_ret, sox_lead_ret, usd_twd_up, usd_twd_up_streak3"
FLAGS = "tsm_dump, sox_dump, tsm_dump_1pct, tsm_not_dump, fx_not_depreciating, fx_not_up"


@case("fea_20_attach_leads", f"SELECT symbol, date, {rounded(LED)}, {FLAGS} FROM led")
def _(s):
    return columns(s.led, f"symbol, date, {LED}", FLAGS)
