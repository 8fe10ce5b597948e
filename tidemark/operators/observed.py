"""Checks that ride on a write: what is observed while a table is written decides whether it may be used.

A check is a condition on single rows, with window columns where a row must be seen among others. The
metrics are collected by the job that writes the table anyway, so no check starts a job of its own. A
table that fails is deleted again and the job stops, before anything is published.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from tidemark.config import CROSS_SOURCE_MISSING, CROSS_SOURCE_TOLERANCE
from tidemark.operators.quality import KEY, DataQualityError
from tidemark.session import delete, fresh_path


@dataclass(frozen=True)
class Check:
    """``bad`` holds on a row that must not be, as where it is NULL; ``show`` names the columns of the error.

    ``needs`` are columns that ``bad`` reads and that are not written.
    """

    message: str
    bad: Column
    show: Sequence[str] = KEY
    needs: Mapping[str, Column] = field(default_factory=dict)


def unique(message: str, key: Sequence[str] = KEY) -> Check:
    """No NULL in the key and no key twice."""
    name = "_rows_of_" + "_".join(key)
    missing = F.lit(False)
    for column in key:
        missing = missing | F.col(column).isNull()
    return Check(message, missing | (F.col(name) > 1), key, {name: F.count(F.lit(1)).over(Window.partitionBy(*key))})


def full_months(message: str, key: Sequence[str] = ("symbol", "month")) -> Check:
    """Every month is the run of trading days 1 to N, once each, with sane values."""
    month = Window.partitionBy(*key)
    right = (
        (F.col("trading_day") == F.col("_place")) & (F.col("days_in_month") == F.col("_days"))
        & F.col("near_probability").between(0.0, 1.0)
        & (F.col("adjusted_open") > 0) & (F.col("reservation_adjusted") > 0)
    )
    return Check(message, ~right, (*key, "trading_day"), {
        "_place": F.row_number().over(month.orderBy("trading_day")), "_days": F.count(F.lit(1)).over(month)})


def sources_agree(message: str = "sources disagree") -> Check:
    """Per symbol: few gaps in the sources, and no price further from the close than tolerated."""
    symbol = Window.partitionBy("symbol")
    gap = F.greatest(F.abs(F.col("close") - F.col("official_close")), F.abs(F.col("issuer_market_price") - F.col("close")))
    missing = F.greatest(*[F.avg(F.col(name).isNull().cast("double")).over(symbol) for name in ("official_close", "nav")])
    bad = (F.col("_missing") > CROSS_SOURCE_MISSING) | (F.coalesce("_gap", F.lit(0.0)) > CROSS_SOURCE_TOLERANCE)
    return Check(message, bad, (*KEY, "close", "official_close", "issuer_market_price"), {"_missing": missing, "_gap": gap})


def written_checked(
    df: DataFrame, name: str, *checks: Check, empty: str | None = None, path: str | None = None,
) -> DataFrame:
    """``df`` written once in the shared folder (or at ``path``) and read back, if every check passes.

    ``empty`` is the message where the table must have rows. The error names the failed check, how many
    rows failed it and the least of them. A failed table is deleted.
    """
    spark = df.sparkSession
    target = path or fresh_path(spark, name)
    needs = {column: value for check in checks for column, value in check.needs.items()}
    clash = set(needs) & set(df.columns)
    if clash:
        raise DataQualityError(f"{name}: columns {sorted(clash)} are reserved for checks")
    metrics = [F.count(F.lit(1)).alias("rows")]
    for at, check in enumerate(checks):
        bad = F.coalesce(check.bad, F.lit(True))
        shown = F.to_json(F.struct(*[F.col(column) for column in check.show]))
        metrics += [F.count_if(bad).alias(f"bad_{at}"), F.min(F.when(bad, shown)).alias(f"least_{at}")]
    observation = Observation()
    held = df.withColumns(needs) if needs else df
    held.observe(observation, *metrics).select(*df.columns).write.mode("errorifexists").parquet(target)
    seen = observation.get
    failed = [f"{check.message}: {seen[f'bad_{at}']} rows, such as {seen[f'least_{at}']}"
              for at, check in enumerate(checks) if seen[f"bad_{at}"]]
    if empty is not None and not seen["rows"]:
        failed.append(empty)
    if failed:
        delete(spark, target)
        raise DataQualityError("; ".join(failed))
    return spark.read.schema(df.schema).parquet(target)
