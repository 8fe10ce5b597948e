"""Fail-closed checks. Each check returns the offending rows; ``require`` stops on any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.config import CROSS_SOURCE_MISSING, CROSS_SOURCE_TOLERANCE, INSTITUTION_NAMES
from tidemark.functions.scalars import MONTH_PATTERN, month_of, number

KEY = ("symbol", "date")


class DataQualityError(ValueError):
    """Input that must not be used."""


def require(offending: DataFrame, message: str) -> None:
    """Raise when there is any offending row (reads one row at most)."""
    row = offending.head(1)
    if row:
        raise DataQualityError(f"{message}: {row[0].asDict()}")


def require_columns(df: DataFrame, columns: Sequence[str], source: str, non_empty: bool = True) -> None:
    missing = sorted(set(columns).difference(df.columns))
    if missing:
        raise DataQualityError(f"{source} lacks columns {missing}")
    if non_empty and df.isEmpty():
        raise DataQualityError(f"{source} is empty")


def duplicate_keys(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keys that are NULL or occur more than once, with their row count."""
    missing = F.lit(False)
    for name in key:
        missing = missing | F.col(name).isNull()
    return (
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
        .where((F.col("rows") > 1) | missing)
    )


def bad_numbers(
    df: DataFrame, positive: Sequence[str] = (), non_negative: Sequence[str] = (),
    finite: Sequence[str] = (),
) -> DataFrame:
    """Rows where a column is no finite number or breaks its sign rule."""
    bad = F.lit(False)
    for name in positive:
        bad = bad | F.coalesce(number(name) <= 0, F.lit(True))
    for name in non_negative:
        bad = bad | F.coalesce(number(name) < 0, F.lit(True))
    for name in finite:
        bad = bad | number(name).isNull()
    return df.where(bad)


def ohlc_ordered() -> Column:
    """High at or above, low at or below, the other three prices."""
    return (F.col("high") >= F.greatest("open", "close", "low")) & (
        F.col("low") <= F.least("open", "close", "high")
    )


def bad_ohlc(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(ohlc_ordered(), F.lit(False)))


def not_one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keys repeated on either side of a join that must be one to one."""
    sides = [
        duplicate_keys(side.select(*key), key).withColumn("side", F.lit(name))
        for name, side in (("left", left), ("right", right))
    ]
    return sides[0].unionByName(sides[1])


def cross_source_report(daily: DataFrame) -> DataFrame:
    """Per symbol: missing shares, largest differences to close, the worst date, verdict."""
    official_gap = F.abs(F.col("close") - F.col("official_close"))
    issuer_gap = F.abs(F.col("issuer_market_price") - F.col("close"))
    report = daily.groupBy("symbol").agg(
        F.avg(F.col("official_close").isNull().cast("double")).alias("official_missing_rate"),
        F.avg(F.col("nav").isNull().cast("double")).alias("nav_missing_rate"),
        F.max(official_gap).alias("official_max_difference"),
        F.max(issuer_gap).alias("issuer_max_difference"),
        F.max_by("date", F.when(official_gap.isNotNull(), F.struct(official_gap, -F.unix_date("date")))
                 ).alias("worst_date"),
    )
    passed = (
        (F.col("official_missing_rate") <= CROSS_SOURCE_MISSING)
        & (F.col("nav_missing_rate") <= CROSS_SOURCE_MISSING)
        & (F.coalesce("official_max_difference", F.lit(0.0)) <= CROSS_SOURCE_TOLERANCE)
        & (F.coalesce("issuer_max_difference", F.lit(0.0)) <= CROSS_SOURCE_TOLERANCE)
    )
    return report.withColumn("passed", passed)


def wrong_month(df: DataFrame) -> DataFrame:
    """Rows whose month text is invalid or is not the month of their date."""
    same = F.col("month").rlike(MONTH_PATTERN) & (month_of("date") == F.col("month"))
    return df.where(~F.coalesce(same, F.lit(False)))


def bad_prediction_months(
    predictions: DataFrame, key: Sequence[str] = ("symbol", "month")
) -> DataFrame:
    """Symbol-months that are not the full run of trading days 1..N with sane values."""
    bad_value = ~F.coalesce(
        F.col("near_probability").between(0.0, 1.0)
        & (F.col("adjusted_open") > 0) & (F.col("reservation_adjusted") > 0),
        F.lit(False),
    )
    per_month = predictions.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("trading_day").alias("distinct_days"),
        F.min("trading_day").alias("first_day"),
        F.max("trading_day").alias("last_day"),
        F.min("days_in_month").alias("least_days"),
        F.max("days_in_month").alias("most_days"),
        F.sum(bad_value.cast("long")).alias("bad_values"),
    )
    complete = (
        (F.col("first_day") == 1) & (F.col("last_day") == F.col("rows"))
        & (F.col("distinct_days") == F.col("rows")) & (F.col("least_days") == F.col("rows"))
        & (F.col("most_days") == F.col("rows")) & (F.col("bad_values") == 0)
    )
    return per_month.where(~F.coalesce(complete, F.lit(False)))


def unknown_categories(
    df: DataFrame, column: str = "name", allowed: Sequence[str] = INSTITUTION_NAMES
) -> DataFrame:
    """Category values outside the allow-list, with their row count."""
    return (
        df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
        .groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    )


def data_quality(daily: DataFrame) -> DataFrame:
    """One summary row per symbol; distinct source names are few and joined by comma."""
    difference = F.abs(F.col("issuer_market_price") - F.col("close"))

    def missing(name: str) -> Column:
        return F.count_if(F.col(name).isNull())

    return daily.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.lit(len(daily.columns)).cast("long").alias("columns"),
        F.max(F.abs("close_difference")).alias("official_max_difference"),
        missing("official_close").alias("official_missing"),
        F.array_join(F.sort_array(F.collect_set("official_close_source")), ",").alias("official_source"),
        F.max(difference).alias("issuer_max_difference"),
        missing("issuer_market_price").alias("issuer_market_price_missing"),
        missing("nav").alias("nav_missing"),
        F.count_if(F.col("split_ratio") != 1.0).alias("split_events"),
        F.count_if(F.col("cash_dividend") > 0.0).alias("dividend_events"),
    )


def repeated_purchases(purchases: DataFrame) -> DataFrame:
    return duplicate_keys(purchases, ("symbol", "strategy", "month"))


def summary(daily: DataFrame) -> DataFrame:
    """Rows and first and last date per symbol, as reported after a fetch."""
    return daily.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("start"), F.max("date").alias("end")
    )
