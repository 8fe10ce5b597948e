"""Queries over sources, sinks and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import schemas
from tidemark.catalog.registry import case, columns, tidy
from tidemark.catalog.sqltext import rounded
from tidemark.functions.scalars import month_of
from tidemark.operators import assemble, observed as O, quality as Q
from tidemark.session import shared_folder
from tidemark.sources import landed, parsers, runs

KEY = ("symbol", "date")
BAR = "open, high, low, close, volume"


def envelope(rows: DataFrame, *fields: Column) -> DataFrame:
    """API-like payloads of one symbol and month (about twenty rows each)."""
    data = F.collect_list(F.struct(*fields))
    body = F.struct(F.lit(200).alias("status"), F.lit("success").alias("msg"), data.alias("data"))
    return rows.groupBy("symbol", month_of("date").alias("_m")).agg(F.to_json(body).alias("payload")).drop("_m")


def text_date() -> Column:
    return F.date_format("date", "yyyy-MM-dd").alias("date")


def renamed(fields: dict[str, str]) -> list[Column]:
    return [text_date(), *[F.col(name).alias(raw) for raw, name in fields.items()]]


def fresh(s, name: str) -> str:
    import uuid

    return f"{shared_folder(s.spark)}/tidemark/{name}-{uuid.uuid4().hex}"


@case("src_01_read_daily", f"SELECT symbol, date, {BAR}, official_close_source, feature_available_date FROM daily")
def _(s):
    path = fresh(s, "daily") + "_csv"
    landed.write_csv(s.daily.select(*schemas.DAILY.fieldNames()), path)
    return landed.read_daily(s.spark, path).select(
        *KEY, *BAR.split(", "), "official_close_source", "feature_available_date")


@case("src_02_lead_files", f"""
SELECT 'tsm' AS series, date, {rounded("adj_close", 7)} FROM tsm UNION ALL
SELECT 'sox', date, {rounded("adj_close", 7)} FROM sox UNION ALL
SELECT 'fx', date, round(usd_twd, 7) FROM fx""")
def _(s):
    folder = fresh(s, "leads")
    for name, table in (("tsm", s.tsm), ("sox", s.sox), ("fx", s.fx)):
        landed.write_csv(table, f"{folder}/{landed.LEAD_FILES[name]}")
    leads = landed.load_leads(s.spark, folder)
    parts = [
        leads[name].select(F.lit(name).alias("series"), "date", F.col(value).alias("adj_close"))
        for name, value in (("tsm", "adj_close"), ("sox", "adj_close"), ("fx", "usd_twd"))
    ]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]), digits=7)


@case("src_03_open_envelope", "SELECT symbol, count(*) AS rows, min(date) AS first, max(date) AS last FROM prices GROUP BY symbol")
def _(s):
    rows = parsers.open_envelope(envelope(s.prices, text_date(), F.col("close")), ("date", "close"))
    day = F.col("date").cast("date")
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min(day).alias("first"), F.max(day).alias("last"))


@case("src_04_prices", f"""
SELECT symbol, date, {rounded("trading_value", 9)}, {BAR}, price_change, transactions FROM prices""")
def _(s):
    raw = envelope(s.prices, *renamed(parsers.PRICE_FIELDS))
    rows = parsers.parse_prices(parsers.open_envelope(raw, ("date", *parsers.PRICE_FIELDS)))
    return columns(rows, "symbol, date, trading_value", f"{BAR}, price_change, transactions", 9)


@case("src_05_dividends", f"""
SELECT symbol, date, {rounded("cash_dividend", 10)} FROM dividends WHERE month(date) <> 6""")
def _(s):
    kind = F.when(F.month("date") == 6, "除權").when(F.month("date") == 12, "權息").otherwise("除息")
    rows = s.dividends.unionByName(s.dividends.withColumn("cash_dividend", F.lit(0.0)))
    raw = envelope(rows, text_date(), F.col("cash_dividend").cast("string").alias("stock_and_cache_dividend"),
                   kind.alias("stock_or_cache_dividend"))
    fields = ("date", "stock_and_cache_dividend", "stock_or_cache_dividend")
    return tidy(parsers.parse_dividends(parsers.open_envelope(raw, fields)), digits=10)


@case("src_06_splits", f"""
SELECT symbol, date, {rounded("CASE WHEN symbol LIKE 'A%' THEN split_ratio * 1.1e0 ELSE split_ratio END").split(" AS ")[0]}
  AS split_ratio FROM splits""")
def _(s):
    off = F.when(F.col("symbol").startswith("A"), 1.1).otherwise(1.001)
    raw = envelope(s.splits, text_date(), F.lit("分割").alias("type"),
                   (F.col("split_ratio") * off * 50.0).alias("before_price"), F.lit(50.0).alias("after_price"))
    rows = parsers.parse_splits(parsers.open_envelope(raw, ("date", "type", "before_price", "after_price")))
    return tidy(rows)


@case("src_07_margin", "SELECT symbol, date, margin_balance, short_balance FROM margin")
def _(s):
    raw = envelope(s.margin, *renamed(parsers.MARGIN_FIELDS))
    return parsers.parse_margin(parsers.open_envelope(raw, ("date", *parsers.MARGIN_FIELDS)))


@case("src_08_institutions", "SELECT symbol, date, institutional_net, foreign_net, trust_net, dealer_net FROM institutions")
def _(s):
    raw = envelope(s.institutions_raw, text_date(), *map(F.col, ("name", "buy", "sell")))
    return parsers.parse_institutions(parsers.open_envelope(raw, ("date", "name", "buy", "sell")))


def month_files(s) -> DataFrame:
    """Exchange month files with thousands commas, ROC dates and a trailing average row."""
    roc = F.concat((F.year("date") - 1911).cast("string"), F.date_format("date", "/MM/dd"))
    value = F.format_number(F.floor(F.col("close") * 1000), 0)
    rows = F.concat(F.collect_list(F.array(F.concat(F.lit(" "), roc), value)),
                    F.array(F.array(F.lit("月平均收盤價"), F.lit("1,000"))))
    body = F.to_json(F.struct(F.lit("OK").alias("stat"), rows.alias("data")))
    return s.prices.groupBy("symbol", month_of("date").alias("_m")).agg(body.alias("payload")).drop("_m")


@case("src_09_monthly_closes", "SELECT symbol, date, floor(close * 1000) AS official_close FROM prices")
def _(s):
    return parsers.parse_monthly_closes(month_files(s))


@case("src_10_nav", f"""
SELECT symbol, date, {rounded("nav, fund_size", 9)}, issuer_market_price, outstanding_units FROM nav WHERE day(date) <> 9""")
def _(s):
    nav = F.when(F.dayofmonth("date") == 9, 0.0).otherwise(F.col("nav"))
    row = F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("UPDATE_T"), nav.alias("NOW_NAV"),
        F.col("issuer_market_price").alias("NOW_PRICE"), F.col("fund_size").alias("FUND_SIZE"),
        F.col("outstanding_units").alias("OS_UNIT"))
    body = F.struct(F.lit(0).alias("ResultCode"), F.lit("ok").alias("ResultMsg"), F.collect_list(row).alias("Data"))
    raw = s.nav.groupBy("symbol", month_of("date").alias("_m")).agg(F.to_json(body).alias("payload"))
    return columns(parsers.parse_nav(raw), "symbol, date, nav, fund_size", "issuer_market_price, outstanding_units", 9)


@case("src_11_us_prices", "SELECT symbol, date, adj_close FROM us_ohlc")
def _(s):
    raw = envelope(s.us_ohlc, text_date(), F.col("adj_close").alias("Adj_Close"))
    return parsers.parse_us_prices(parsers.open_envelope(raw, ("date", "Adj_Close")))


@case("src_12_us_ohlc", f"SELECT symbol, date, {BAR}, adj_close FROM us_ohlc")
def _(s):
    raw = envelope(s.us_ohlc, *renamed(parsers.US_FIELDS))
    return parsers.parse_us_ohlc(parsers.open_envelope(raw, ("date", *parsers.US_FIELDS)))


@case("src_13_usd_twd", f"SELECT date, {rounded('usd_twd', 7)} FROM fx WHERE day(date) NOT IN (5, 6, 7)")
def _(s):
    day = F.dayofmonth("date")
    buy = F.when(day == 5, "-99").when(day == 6, "n/a").otherwise((F.col("usd_twd") - 0.5).cast("string"))
    sell = F.when(day == 7, "0").otherwise((F.col("usd_twd") + 0.5).cast("string"))
    raw = envelope(s.fx.withColumn("symbol", F.lit("USD")), text_date(), buy.alias("spot_buy"), sell.alias("spot_sell"))
    return tidy(parsers.parse_usd_twd(parsers.open_envelope(raw, ("date", "spot_buy", "spot_sell"))), digits=7)


@case("src_14_official_range", """
SELECT symbol, date, floor(close * 1000) AS official_close FROM prices
WHERE date BETWEEN DATE '1996-01-10' AND DATE '2000-06-20'""")
def _(s):
    return parsers.require_rows(
        parsers.official_closes(month_files(s), "1996-01-10", "2000-06-20"), source="official closes")


@case("src_15_official_from_issuer", "SELECT symbol, date, close AS official_close FROM prices")
def _(s):
    return assemble.official_from_issuer(s.nav)


def year_files(market, institutions: DataFrame) -> dict[str, DataFrame]:
    """(symbol, payload) per source: one response of each symbol and year."""
    cash = F.col("cash_dividend").alias("stock_and_cache_dividend")
    before = (F.col("split_ratio") * 50.0).alias("before_price")
    rows = {
        "prices": (market.prices, renamed(parsers.PRICE_FIELDS)),
        "dividends": (market.dividends, [text_date(), cash, F.lit("除息").alias("stock_or_cache_dividend")]),
        "splits": (market.splits, [text_date(), F.lit("分割").alias("type"), before, F.lit(50.0).alias("after_price")]),
        "margin": (market.margin, renamed(parsers.MARGIN_FIELDS)),
        "institutions": (institutions, [text_date(), *map(F.col, ("name", "buy", "sell"))]),
        "nav": (market.nav, [F.date_format("date", "yyyy-MM-dd").alias("UPDATE_T"),
                             *[F.col(name).alias(raw) for raw, name in parsers.NAV_FIELDS.items()]]),
    }
    files = {}
    for name, (table, fields) in rows.items():
        data = F.collect_list(F.struct(*fields))
        body = (F.struct(F.lit(0).alias("ResultCode"), F.lit("ok").alias("ResultMsg"), data.alias("Data")) if name == "nav"
                else F.struct(F.lit(200).alias("status"), F.lit("success").alias("msg"), data.alias("data")))
        files[name] = table.groupBy("symbol", F.year("date").alias("_y")).agg(F.to_json(body).alias("payload")).drop("_y")
    return files


# -------------------------------------------------------------------------------- sinks
@case("snk_01_raw_frames", f"""
SELECT 'prices' AS source, symbol, date, close AS value FROM prices UNION ALL
SELECT 'splits', symbol, date, split_ratio FROM splits UNION ALL SELECT 'margin', symbol, date, margin_balance FROM margin
UNION ALL SELECT 'dividends', symbol, date, {rounded("cash_dividend", 10)} FROM dividends""")
def _(s):
    folder = fresh(s, "raw")
    frames = {"prices": (s.prices, "close"), "splits": (s.splits, "split_ratio"), "margin": (s.margin, "margin_balance"),
              "dividends": (s.dividends, "cash_dividend")}
    landed.write_raw({name: frame for name, (frame, _) in frames.items()}, folder)
    parts = [
        s.spark.read.schema(frame.schema).parquet(f"{folder}/{name}")
        .select(F.lit(name).alias("source"), *KEY, F.col(value).cast("double").alias("value"))
        for name, (frame, value) in frames.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(tidy(parts[3], digits=10))


@case("snk_02_daily_by_symbol", f"SELECT symbol, date, {BAR} FROM prices")
def _(s):
    path = fresh(s, "by-symbol")
    landed.write_by_symbol(s.prices, path)
    back = landed.read_by_symbol(s.spark, path, s.prices.schema)
    return back.select(*KEY, *BAR.split(", "))


@case("snk_02_bucketed_month_highs", "SELECT symbol, strftime(date, '%Y-%m') AS month, max(high) AS high, count(*) AS days FROM prices GROUP BY ALL")
def _(s):
    """Months per symbol over the bucketed table: the aggregate exchanges nothing."""
    table = landed.write_bucketed(s.prices, fresh(s, "bucketed"), 16)
    return table.groupBy("symbol", month_of("date").alias("month")).agg(F.max("high").alias("high"), F.count(F.lit(1)).alias("days"))


@case("snk_03_result_tables", f"""
SELECT 'labelled' AS name, symbol, date, {rounded("regret").split(" AS ")[0]} AS value FROM labelled UNION ALL
SELECT 'oracle', symbol, oracle_date, {rounded("oracle_adjusted_open").split(" AS ")[0]} FROM oracle""")
def _(s):
    folder = fresh(s, "results")
    tables = {"labelled": (s.labelled, "date", "regret"), "oracle": (s.oracle, "oracle_date", "oracle_adjusted_open")}
    landed.write_results({name: table for name, (table, _, _) in tables.items()}, folder)
    stored = runs.latest(s.spark, folder)
    first, second = [
        stored[name].select(F.lit(name).alias("name"), "symbol", F.col(date).alias("date"), F.col(value).alias("value"))
        for name, (_, date, value) in tables.items()
    ]
    return tidy(first.unionByName(second))


@case("snk_04_predictions", "SELECT symbol, count(*) AS rows, round(sum(near_probability), 6) AS total FROM predictions GROUP BY symbol")
def _(s):
    folder = fresh(s, "predictions")
    back = landed.write_results({"predictions": s.predictions}, folder)["predictions"]
    return tidy(back.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("near_probability").alias("total")))


@case("snk_05_purchases", """
SELECT symbol, strategy, month, round(regret, 6) AS regret
FROM (SELECT symbol, strategy, month, regret FROM policy_bought UNION ALL SELECT symbol, strategy, month, regret FROM lead_bought)""")
def _(s):
    folder = fresh(s, "purchases")
    both = s.policy_bought.unionByName(s.lead_bought, allowMissingColumns=True)
    back = landed.write_results({"purchases": both}, folder)["purchases"]
    return columns(back, "symbol, strategy, month, regret")


@case("snk_06_metrics_json", """
SELECT symbol, strategy, count(*) AS months, round(avg(regret), 6) AS mean_regret FROM policy_bought GROUP BY ALL""")
def _(s):
    from tidemark.operators.metrics import strategy_metrics

    path = fresh(s, "metrics-json")
    landed.write_json(strategy_metrics(s.policy_bought), path)
    back = s.spark.read.schema("symbol string, strategy string, months long, mean_regret double").json(path)
    return tidy(back)


@case("snk_03_last_complete_run", f"""
SELECT symbol, date, {BAR} FROM prices WHERE year(date) < 1998""")
def _(s):
    """A run that is lost midway leaves the one before as it was."""
    folder = fresh(s, "runs")
    complete = s.prices.where(F.year("date") < 1998)
    landed.write_results({"prices": complete, "months": complete.select("symbol", month_of("date").alias("month")).distinct()}, folder)
    lost = s.prices.withColumn("close", F.when(F.col("close") > 0, F.raise_error(F.lit("lost on the way")).cast("double")))
    try:
        landed.write_results({"prices": s.prices, "months": lost}, folder)
    except Exception as error:  # the executor's error, as the driver hands it on
        if "lost on the way" not in str(error):
            raise
    return runs.latest(s.spark, folder)["prices"].select(*KEY, *BAR.split(", "))


@case("snk_07_fetch_summary", 'SELECT symbol, count(*) AS rows, min(date) AS start, max(date) AS "end" FROM prices GROUP BY symbol')
def _(s):
    return Q.summary(s.prices)


# ------------------------------------------------------------------------------- quality
@case("dq_01_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(s):
    return Q.duplicate_keys(s.table("lineitem"), ("l_orderkey", "l_linenumber"))


@case("dq_02_required_columns", 'SELECT symbol, count(*) AS rows, min(date) AS start, max(date) AS "end" FROM prices GROUP BY symbol')
def _(s):
    Q.require_columns(s.prices, schemas.PRICES.fieldNames(), "prices")
    return Q.summary(s.prices)


@case("dq_02_refusals", """
SELECT symbol, "case", "case" <> 'whole' AS refused FROM (SELECT DISTINCT symbol FROM prices),
  (SELECT unnest(['whole', 'empty', 'without close', 'without date', 'without high', 'without low', 'without open', 'without price_change',
                  'without symbol', 'without trading_value', 'without transactions', 'without volume']) AS "case")""")
def _(s):
    """Each missing column and an empty table is refused, for every symbol's table by itself."""
    names = schemas.PRICES.fieldNames()
    prices = s.prices.select(*names)
    tried = {"whole": prices, "empty": prices.where("false"), **{f"without {name}": prices.drop(name) for name in names}}
    found = []
    for case_, table in tried.items():
        try:
            Q.require_columns(table, names, "prices")
            found.append((case_, False))
        except Q.DataQualityError:
            found.append((case_, True))
    each = [F.struct(F.lit(case_).alias("case"), F.lit(refused).alias("refused")) for case_, refused in found]
    return s.prices.select("symbol").distinct().select("symbol", F.inline(F.array(*each)))


@case("dq_01_checked_write", """
SELECT 'whole' AS "case", count(*) AS rows, CAST(0 AS BIGINT) AS bad, CAST(NULL AS VARCHAR) AS least FROM prices
UNION ALL
SELECT 'repeated', 2 * count(*) FILTER (WHERE day(date) = 11) + count(*) FILTER (WHERE day(date) <> 11),
  2 * count(*) FILTER (WHERE day(date) = 11),
  min('{"symbol":"' || symbol || '","date":"' || date || '"}') FILTER (WHERE day(date) = 11) FROM prices""")
def _(s):
    """Whole and repeated keys, seen by the writes themselves."""
    found = []
    twice = s.prices.unionByName(s.prices.where(F.dayofmonth("date") == 11))
    for name, table in (("whole", s.prices), ("repeated", twice)):
        try:
            kept = O.written_checked(table, "checked", O.unique("repeated key"))
            found.append(kept.agg(F.lit(name).alias("case"), F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("bad"),
                                  F.lit(None).cast("string").alias("least")))
        except Q.DataQualityError as error:
            bad, least = str(error).removeprefix("repeated key: ").split(" rows, such as ")
            found.append(table.agg(F.lit(name).alias("case"), F.count(F.lit(1)).alias("rows"), F.lit(int(bad)).cast("long").alias("bad"),
                                   F.lit(least).alias("least")))
    return found[0].unionByName(found[1])


@case("dq_03_bad_numbers", "SELECT symbol, date FROM prices WHERE day(date) IN (13, 14, 21)")
def _(s):
    day = F.dayofmonth("date")
    flawed = s.prices.withColumns({
        "close": F.when(day == 13, "n/a").when(day == 14, "0").otherwise(F.col("close").cast("string")),
        "volume": F.when(day == 21, -F.col("volume")).otherwise(F.col("volume")),
    })
    return Q.bad_numbers(flawed, positive=("close",), non_negative=("volume",), finite=("open",)).select(*KEY)


@case("dq_04_bad_ohlc", """
SELECT symbol, date FROM (SELECT *, CASE WHEN day(date) = 7 THEN (open + close) / 2 ELSE high END AS h FROM prices)
WHERE h < greatest(open, close, low) OR low > least(open, close, h)""")
def _(s):
    flawed = s.prices.withColumn(
        "high", F.when(F.dayofmonth("date") == 7, (F.col("open") + F.col("close")) / 2).otherwise(F.col("high")))
    return Q.bad_ohlc(flawed).select(*KEY)


@case("dq_05_one_to_one", """
SELECT symbol, date, count(*) AS rows, 'right' AS side FROM institutions_raw GROUP BY symbol, date HAVING count(*) > 1""")
def _(s):
    return Q.not_one_to_one(s.prices, s.institutions_raw)


@case("dq_06_cross_sources", f"""
SELECT symbol, {rounded("official_missing_rate, nav_missing_rate, official_max_difference, issuer_max_difference")},
       worst_date, official_missing_rate <= 0.001e0 AND nav_missing_rate <= 0.001e0
         AND official_max_difference <= 0.011e0 AND issuer_max_difference <= 0.011e0 AS passed
FROM (SELECT symbol, avg(CAST(o IS NULL AS DOUBLE)) AS official_missing_rate, 0e0 AS nav_missing_rate,
             max(abs(close - o)) AS official_max_difference, 0e0 AS issuer_max_difference,
             arg_max(date, abs(close - o)) AS worst_date
      FROM (SELECT symbol, date, close, CASE WHEN symbol LIKE 'A%' AND day(date) = 31 THEN NULL
                   ELSE close + (date - DATE '1995-01-01') * 0.00001e0 END AS o FROM prices)
      GROUP BY symbol)""")
def _(s):
    drift = F.datediff("date", F.lit("1995-01-01").cast("date")) * 0.00001
    gone = F.col("symbol").startswith("A") & (F.dayofmonth("date") == 31)
    daily = s.prices.join(s.nav, list(KEY), "left").withColumn(
        "official_close", F.when(~gone, F.col("close") + drift))
    return tidy(Q.cross_source_report(daily))


@case("dq_07_wrong_month", "SELECT symbol, date FROM prices WHERE day(date) > 28")
def _(s):
    month = F.when(F.dayofmonth("date") > 28, "1994-13").otherwise(month_of("date"))
    return Q.wrong_month(s.prices.withColumn("month", month)).select(*KEY)


@case("dq_08_prediction_months", """
SELECT symbol, month, count(*) AS rows FROM predictions
WHERE NOT (month LIKE '%-05' AND trading_day = 3) GROUP BY symbol, month
HAVING month LIKE '%-05' OR month LIKE '%-08'""")
def _(s):
    flawed = s.predictions.where(~(F.col("month").endswith("-05") & (F.col("trading_day") == 3))).withColumn(
        "near_probability", F.when(F.col("month").endswith("-08"), 1.5).otherwise(F.col("near_probability")))
    return Q.bad_prediction_months(flawed).select("symbol", "month", "rows")


@case("dq_09_unknown_categories", """
SELECT name, count(*) AS rows FROM (SELECT CASE WHEN name LIKE 'Foreign%' THEN name || '_X' ELSE name END AS name
FROM institutions_raw) WHERE name LIKE '%_X' GROUP BY name""")
def _(s):
    flawed = s.institutions_raw.withColumn(
        "name", F.when(F.col("name").startswith("Foreign"), F.concat("name", F.lit("_X"))).otherwise(F.col("name")))
    return Q.unknown_categories(flawed)


@case("dq_10_data_quality", f"""
SELECT symbol, count(*) AS rows, min(date) AS start, max(date) AS "end", CAST(39 AS BIGINT) AS columns,
       max(abs(close_difference)) AS official_max_difference,
       count(*) FILTER (official_close IS NULL) AS official_missing,
       max(official_close_source) AS official_source, max(abs(issuer_market_price - close)) AS issuer_max_difference,
       count(*) FILTER (issuer_market_price IS NULL) AS issuer_market_price_missing,
       count(*) FILTER (nav IS NULL) AS nav_missing,
       count(*) FILTER (split_ratio <> 1) AS split_events,
       count(*) FILTER (cash_dividend > 0) AS dividend_events
FROM daily GROUP BY symbol""")
def _(s):
    return Q.data_quality(s.daily)


@case("dq_11_parameter_guards", """
SELECT symbol, count(*) AS rows, count(*) FILTER (regret <= 0.01e0) AS near FROM labelled GROUP BY symbol""")
def _(s):
    from tidemark.operators.labels import add_monthly_labels

    labelled = add_monthly_labels(s.adjusted, near_threshold=0.01, first_month="1995-02")
    return labelled.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("near_optimal").alias("near"))


@case("dq_11_refusals", """
SELECT symbol, "case", refused FROM (SELECT DISTINCT symbol FROM prices), (VALUES
  ('near 0.05', FALSE), ('near 0', FALSE), ('near -0.1', TRUE), ('near 1.5', TRUE), ('near as flag', TRUE), ('deadline 5', FALSE),
  ('deadline 0', TRUE), ('deadline as flag', TRUE), ('month 1995-02', FALSE), ('month 1995-13', TRUE), ('month 95-02', TRUE)) t("case", refused)""")
def _(s):
    """Good and bad settings of a policy, a label threshold and a first month, tried before any job starts."""
    from tidemark.config import Policy, check_month, check_near_threshold

    tried = {
        "near 0.05": lambda: check_near_threshold(0.05), "near 0": lambda: check_near_threshold(0.0),
        "near -0.1": lambda: check_near_threshold(-0.1), "near 1.5": lambda: check_near_threshold(1.5),
        "near as flag": lambda: check_near_threshold(True), "deadline 5": lambda: Policy("p", deadline=5),
        "deadline 0": lambda: Policy("p", deadline=0), "deadline as flag": lambda: Policy("p", deadline=True),
        "month 1995-02": lambda: check_month("1995-02"), "month 1995-13": lambda: check_month("1995-13"),
        "month 95-02": lambda: check_month("95-02"),
    }

    def refused(attempt) -> bool:
        try:
            attempt()
        except (TypeError, ValueError):
            return True
        return False

    each = [F.struct(F.lit(name).alias("case"), F.lit(refused(attempt)).alias("refused")) for name, attempt in tried.items()]
    return s.prices.select("symbol").distinct().select("symbol", F.inline(F.array(*each)))


@case("dq_12_one_purchase_per_month", """
SELECT symbol, 'fixed_day_1' AS strategy, month, CAST(2 AS BIGINT) AS rows FROM day1 WHERE month LIKE '%-03'""")
def _(s):
    doubled = s.day1.unionByName(s.day1.where(F.col("month").endswith("-03")))
    return Q.repeated_purchases(doubled)
