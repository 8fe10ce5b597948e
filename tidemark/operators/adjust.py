"""Corporate actions: event merge, total-return adjustment, inference, trailing yield."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.functions.scalars import guard, positive, ratio
from tidemark.functions.windows import by_date, by_symbol, running_product, spread_by_symbol
from tidemark.operators.quality import KEY, ohlc_ordered

OHLC = ("open", "high", "low", "close")


def up_to_date() -> WindowSpec:
    """Rows dated up to the current row; peers on one date count together."""
    return by_date().rangeBetween(Window.unboundedPreceding, Window.currentRow)


def last_365_days(value: str) -> Column:
    """Sum of a column over the current date and the 364 days before it."""
    return F.expr(
        f"sum({value}) OVER (PARTITION BY symbol ORDER BY date "
        "RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW)")


def merge_dividends(dividends: DataFrame) -> DataFrame:
    """Cash of one symbol and date added up."""
    return dividends.groupBy(*KEY).agg(F.sum("cash_dividend").alias("cash_dividend"))


def merge_splits(splits: DataFrame) -> DataFrame:
    """Ratios of one symbol and date multiplied; a ratio of zero or less fails."""
    checked = guard(F.col("split_ratio") > 0, F.col("split_ratio"), "split ratio must be positive")
    return splits.groupBy(*KEY).agg(F.product(checked).alias("split_ratio"))


def attach_events(prices: DataFrame, dividends: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices with the day's cash dividend (0 without) and split ratio (1 without)."""
    return (
        prices.join(merge_dividends(dividends), list(KEY), "left")
        .join(merge_splits(splits), list(KEY), "left")
        .withColumns({
            "cash_dividend": F.coalesce("cash_dividend", F.lit(0.0)),
            "split_ratio": F.coalesce("split_ratio", F.lit(1.0)),
        })
    )


def split_adjusted(df: DataFrame) -> DataFrame:
    """Prices in today's units: divided by the product of all later splits."""
    return _in_units(df.withColumns({
        "_all": F.product("split_ratio").over(by_symbol()), "_until": running_product("split_ratio")}))


def _in_units(df: DataFrame) -> DataFrame:
    later = F.col("_all") / F.col("_until")
    return df.withColumns({f"split_adjusted_{name}": F.col(name) / later for name in OHLC}).drop("_all", "_until")


def adjust(df: DataFrame) -> DataFrame:
    """Total-return index and adjusted prices from prices with their events attached.

    Three passes over one sorted partition: previous row, running products, last row.
    Duplicate dates, disordered or non-positive prices and unusable returns fail the job
    where they occur.
    """
    before = df.withColumns({
        "_close": F.lag("close").over(by_date()), "_date": F.lag("date").over(by_date())})
    gross = F.coalesce(
        ratio((F.col("close") + F.col("cash_dividend")) * F.col("split_ratio"), F.col("_close")), F.lit(1.0)
    )
    sane = (F.col("_date").isNull() | (F.col("_date") < F.col("date"))) & positive(*OHLC) & ohlc_ordered()
    usable = (gross > 0) & (gross < float("inf"))
    running = before.withColumn(
        "gross_return", guard(sane & usable, gross, "duplicate date, invalid prices or invalid total return")
    ).drop("_close", "_date").withColumns({
        "total_return_index": F.lit(100.0) * running_product("gross_return"),
        "_until": running_product("split_ratio"),
    })
    last = running.withColumns({
        "_last_close": F.max_by("close", "date").over(by_symbol()),
        "_last_index": F.max_by("total_return_index", "date").over(by_symbol()),
        "_all": F.product("split_ratio").over(by_symbol()),
    })
    adjusted = last.withColumn(
        "adjusted_close", F.col("_last_close") * F.col("total_return_index") / F.col("_last_index")
    ).withColumn("adjustment_factor", F.col("adjusted_close") / F.col("close"))
    adjusted = adjusted.withColumns({
        f"adjusted_{name}": F.col(name) * F.col("adjustment_factor") for name in ("open", "high", "low")
    })
    return _in_units(adjusted).drop("_last_close", "_last_index")


def build_adjusted_prices(prices: DataFrame, dividends: DataFrame, splits: DataFrame) -> DataFrame:
    return adjust(spread_by_symbol(attach_events(prices, dividends, splits)))


def trailing_yield(df: DataFrame, cash: str, split: str) -> DataFrame:
    """``distribution_yield_ttm`` from cash and split columns of the rows themselves.

    With C(t) the running product of splits, a dividend paid at d is worth
    cash * C(d) / C(t) in the units of t, so one range window replaces the pairing of
    dividends with the splits that follow them.
    """
    return (
        df.withColumn("_units", F.product(split).over(up_to_date()))
        .withColumn("_paid", F.col(cash) * F.col("_units"))
        .withColumn("_cash", last_365_days("_paid"))
        .withColumn("distribution_yield_ttm", F.col("_cash") / F.col("_units") / F.col("close"))
        .drop("_units", "_paid", "_cash")
    )


def distribution_yield(daily: DataFrame, dividends: DataFrame, splits: DataFrame) -> DataFrame:
    """Trailing 365-day cash over close, cash restated for later splits.

    Events join as extra rows, so events on dates without trading count as well; the
    extra rows go again before anything else sees them.
    """
    rows = (
        daily.withColumns({"_cash_in": F.lit(0.0), "_split_in": F.lit(1.0), "_trading": F.lit(True)})
        .unionByName(
            dividends.select(*KEY, F.col("cash_dividend").alias("_cash_in"),
                             F.lit(1.0).alias("_split_in"), F.lit(False).alias("_trading")),
            allowMissingColumns=True)
        .unionByName(
            splits.select(*KEY, F.lit(0.0).alias("_cash_in"),
                          F.col("split_ratio").alias("_split_in"), F.lit(False).alias("_trading")),
            allowMissingColumns=True)
    )
    return trailing_yield(spread_by_symbol(rows), "_cash_in", "_split_in").where("_trading").drop(
        "_cash_in", "_split_in", "_trading"
    )


def implied_action(close: str = "close", adj_close: str = "adj_close") -> Column:
    """Vendor return over plain return: what dividends and splits explain of a move."""
    return ratio(
        ratio(F.col(adj_close), F.lag(adj_close).over(by_date())),
        ratio(F.col(close), F.lag(close).over(by_date())),
    )


def unexplained_moves(df: DataFrame) -> DataFrame:
    """Rows whose implied action is neither a split nor a dividend nor none."""
    value = F.col("implied")
    bad = (value < 0.95) | ((value >= 1.4) & (F.rint(value) < 2.0)) | value.isNull()
    return (
        df.withColumn("implied", implied_action())
        .withColumn("_first", F.lag("date").over(by_date()).isNull())
        .where(~F.col("_first") & bad).drop("_first")
    )


def infer_us_actions(df: DataFrame) -> DataFrame:
    """Cash dividend and split ratio read from close and vendor-adjusted close."""
    value = F.col("_implied")
    first = F.lag("date").over(by_date()).isNull()
    explained = first | (value.between(0.95, 1.4) & (value < 1.4)) | (F.rint(value) >= 2.0)
    split = F.when(~first & (value >= 1.4), F.rint(value)).otherwise(1.0)
    cash = F.when(
        ~first & (value > 1.002) & (value < 1.4),
        F.lag("close").over(by_date()) * (F.lit(1.0) - ratio(F.lit(1.0), value)),
    ).otherwise(0.0)
    return (
        df.withColumn("_implied", implied_action())
        .withColumns({
            "cash_dividend": cash,
            "split_ratio": guard(explained, split, "price move not explained by adjusted close"),
        })
        .drop("_implied")
    )


def vendor_adjusted(prices: DataFrame) -> DataFrame:
    """Adjusted prices and index straight from the vendor's adjusted close."""
    factor = F.col("adj_close") / F.col("close")
    sane = positive(*OHLC, "adj_close") & (F.col("volume") >= 0) & ohlc_ordered()
    return prices.withColumn(
        "adjustment_factor", guard(sane, factor, "invalid prices or volume")
    ).withColumns({
        **{f"adjusted_{name}": F.col(name) * F.col("adjustment_factor") for name in ("open", "high", "low")},
        "adjusted_close": F.col("adj_close"),
        "total_return_index": F.lit(100.0) * F.col("adj_close") / F.first("adj_close").over(by_date()),
        "gross_return": F.coalesce(ratio(F.col("adj_close"), F.lag("adj_close").over(by_date())), F.lit(1.0)),
    })


def next_trading_date() -> Column:
    return F.lead("date").over(by_date())


def open_gap(df: DataFrame) -> DataFrame:
    """Opening gap without the mechanical effect of the day's dividend and split."""
    reference = F.lag("close").over(by_date()) / F.col("split_ratio") - F.col("cash_dividend")
    return df.withColumn("open_gap_vs_action_ref", ratio(F.col("open"), reference) - 1.0)


def events_of(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dividend rows and the split rows of a daily table."""
    return (
        daily.where("cash_dividend > 0").select(*KEY, "cash_dividend"),
        daily.where("split_ratio <> 1").select(*KEY, "split_ratio"),
    )
