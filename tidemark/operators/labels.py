"""Hindsight labels of each month: where the lowest open was and what each day missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.config import NEAR_THRESHOLD, check_near_threshold
from tidemark.functions.scalars import guard, positive, ratio
from tidemark.functions.windows import by_month, by_date, in_month, rest_of_month
from tidemark.operators.filters import from_month, through_last_complete_month
from tidemark.operators.quality import require_columns


def add_monthly_labels(
    daily: DataFrame, complete_through: str | None = None, near_threshold: float = NEAR_THRESHOLD,
    first_month: str | Column | None = None,
) -> DataFrame:
    """Label the rows of complete months.

    The symbol windows run first; the month windows then reuse their distribution. The
    ``first_month`` cut comes last because the prior close crosses month borders.
    """
    check_near_threshold(near_threshold)
    require_columns(daily, ("symbol", "date", "open", "adjusted_open", "adjusted_close"), "daily table", non_empty=False)
    sane = positive("open", "adjusted_open", "adjusted_close") & (
        F.col("_before").isNull() | (F.col("_before") < F.col("date")))
    df = through_last_complete_month(daily, complete_through).withColumns({
        "previous_adjusted_close": F.lag("adjusted_close").over(by_date()),
        "_before": F.lag("date").over(by_date()),
    }).withColumn(
        "_open", guard(sane, F.col("adjusted_open"), "duplicate date or price not positive")
    ).drop("_before")
    df = df.withColumns({
        "trading_day": F.row_number().over(in_month()),
        "remaining_min_adjusted_open": F.min("_open").over(rest_of_month()),
    }).withColumns({
        "days_in_month": F.count(F.lit(1)).over(by_month()).cast("int"),
        "oracle_adjusted_open": F.min("_open").over(by_month()),
        "oracle_date": F.min_by("date", F.struct("_open", "date")).over(by_month()),
    }).drop("_open")
    df = df.withColumns({
        "regret": F.col("adjusted_open") / F.col("oracle_adjusted_open") - 1.0,
        "is_oracle": F.col("date") == F.col("oracle_date"),
        "remaining_min_log_ratio": F.ln(
            ratio(F.col("remaining_min_adjusted_open"), F.col("previous_adjusted_close"))
        ),
    }).withColumn("near_optimal", F.col("regret") <= F.lit(near_threshold))
    return df if first_month is None else from_month(df, first_month)


def monthly_oracle(labelled: DataFrame) -> DataFrame:
    """One row per symbol and month: the earliest of the lowest adjusted opens."""
    best = F.min_by(
        F.struct("date", "open", "adjusted_open", "trading_day", "days_in_month"),
        F.struct("adjusted_open", "date"),
    )
    return labelled.groupBy("symbol", "month").agg(best.alias("b")).select(
        "symbol", "month",
        F.col("b.date").alias("oracle_date"),
        F.col("b.open").alias("oracle_open"),
        F.col("b.adjusted_open").alias("oracle_adjusted_open"),
        F.col("b.trading_day").alias("oracle_trading_day"),
        F.col("b.days_in_month").alias("days_in_month"),
    )
