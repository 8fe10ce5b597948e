"""Month cut-offs. Place them by hand: features and the prior close need earlier rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import FEATURE_SETS, check_month
from tidemark.functions.scalars import month_of, previous_month
from tidemark.functions.windows import by_symbol


def last_complete_month(daily: DataFrame) -> DataFrame:
    """Per symbol the month before the month its data ends in."""
    return daily.groupBy("symbol").agg(previous_month(F.max("date")).alias("complete_through"))


def through_last_complete_month(daily: DataFrame, complete_through: str | None = None) -> DataFrame:
    """Add ``month`` and drop months after the cut-off (per symbol when not given)."""
    dated = daily.withColumn("month", month_of("date"))
    if complete_through is not None:
        return dated.where(F.col("month") <= F.lit(check_month(complete_through)))
    cutoff = previous_month(F.max("date").over(by_symbol()))
    return dated.withColumn("_cutoff", cutoff).where(F.col("month") <= F.col("_cutoff")).drop("_cutoff")


def from_month(df: DataFrame, first: str | Column) -> DataFrame:
    """Rows from a month on; a column gives each symbol its own first month."""
    start = F.lit(check_month(first)) if isinstance(first, str) else first
    return df.where(F.col("month") >= start)


def out_of_sample(labelled: DataFrame, initial_months: int) -> DataFrame:
    """Rows from the first predicted month on, the month at position ``initial_months``."""
    ordinal = F.dense_rank().over(Window.partitionBy("symbol").orderBy("month"))
    return labelled.withColumn("_n", ordinal).where(F.col("_n") > initial_months).drop("_n")


def from_first_predicted(labelled: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows from each symbol's first predicted month on (the minimum over all models)."""
    first = predictions.groupBy("symbol").agg(F.min("month").alias("_first"))
    return labelled.join(first, "symbol").where(F.col("month") >= F.col("_first")).drop("_first")


def holdout(df: DataFrame, bounds: tuple[str, str]) -> DataFrame:
    return df.where(F.col("month").between(*map(check_month, bounds)))


def development(df: DataFrame, start: str, holdout_start: str) -> DataFrame:
    return df.where((F.col("month") >= check_month(start)) & (F.col("month") < check_month(holdout_start)))


def feature_set(df: DataFrame, name: str) -> DataFrame:
    """Key columns plus the columns of one feature set."""
    return df.select("symbol", "date", *FEATURE_SETS[name])
