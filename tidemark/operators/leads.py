"""Outside series as of the day before: returns, currency direction and six buy flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.config import OVERNIGHT_DUMP
from tidemark.functions.scalars import holds, number, ratio
from tidemark.functions.windows import last_known, running_count

LEAD_COLUMNS = ("tsm_lead_ret", "sox_lead_ret", "usd_twd_up", "usd_twd_up_streak3")


def session_returns(prices: DataFrame, series: str) -> DataFrame:
    """(series, date, value): the return of each session of one price series on the one before, gaps
    filled with the last known price."""
    tagged = prices.select(F.lit(series).alias("series"), "date", number("adj_close").alias("price"))
    known = last_known(tagged, "series", "date", {"price": F.col("price")})
    return known.select("series", "date", (ratio(F.col("price_upto"), F.col("price_before")) - 1.0).alias("value"))


def currency_signals(fx: DataFrame) -> DataFrame:
    """Whether the rate rose today, and on three rows running; unknown changes are no rise."""
    tagged = fx.select(F.lit("fx").alias("series"), "date", number("usd_twd").alias("rate"))
    known = last_known(tagged, "series", "date", {"rate": F.col("rate")})
    rise = known.select("series", "date", holds(ratio(F.col("rate_upto"), F.col("rate_before")) - 1.0 > 0).alias("up"))
    placed = running_count(rise, "series", "date", "place")
    fallen = last_known(placed, "series", "date", {"fall": F.when(~F.col("up"), F.col("place"))})
    streak = F.col("place") - F.coalesce("fall_upto", F.lit(0)) >= 3
    return fallen.select("date", F.col("up").cast("double").alias("usd_twd_up"), streak.cast("double").alias("up_streak3"))


def align_prior_session(
    source: DataFrame, targets: DataFrame, series: Sequence[str] = LEAD_COLUMNS
) -> DataFrame:
    """For each target date the last non-null value dated at least one day earlier.

    ``source`` is (series, date, value) and ``targets`` holds distinct dates. Each series is read in
    blocks of days; the symbols are joined on afterwards.
    """
    asked = targets.select("date", F.explode(F.array(*map(F.lit, series))).alias("series")).select(
        "series", F.date_sub("date", 1).alias("ts"), F.lit(1).alias("tag"),
        F.lit(None).cast("double").alias("value"), "date",
    )
    known = source.where(F.col("value").isNotNull()).select(
        "series", F.col("date").alias("ts"), F.lit(0).alias("tag"), "value",
        F.lit(None).cast("date").alias("date"),
    )
    carried = last_known(known.unionByName(asked), "series", "ts", {"value": F.col("value")}, ("tag",))
    return carried.where("tag = 1").select("series", "date", F.col("value_upto").alias("value"))


def lead_signals(tsm: DataFrame, sox: DataFrame, fx: DataFrame) -> DataFrame:
    """All four lead values in long form (series, date, value)."""
    currency = currency_signals(fx)
    return (
        session_returns(tsm, "tsm_lead_ret")
        .unionByName(session_returns(sox, "sox_lead_ret"))
        .unionByName(currency.select(
            "date", F.expr("stack(2, 'usd_twd_up', usd_twd_up, 'usd_twd_up_streak3', up_streak3)")
            .alias("series", "value")))
    )


def lead_flags() -> dict[str, Column]:
    """Missing leads never trigger a purchase."""
    return {
        "tsm_dump": holds(F.col("tsm_lead_ret") < 0),
        "sox_dump": holds(F.col("sox_lead_ret") < 0),
        "tsm_dump_1pct": holds(F.col("tsm_lead_ret") <= OVERNIGHT_DUMP),
        "tsm_not_dump": holds(F.col("tsm_lead_ret") >= 0),
        "fx_not_depreciating": holds(F.col("usd_twd_up_streak3") < 0.5),
        "fx_not_up": holds(F.col("usd_twd_up") < 0.5),
    }


def attach_leads(
    frame: DataFrame, tsm: DataFrame, sox: DataFrame, fx: DataFrame, calendar: DataFrame | None = None
) -> DataFrame:
    """Add the four lead values and the six flags to every row; no further lag.

    ``calendar`` may name a cheaper table that holds all dates of ``frame`` (the landed
    daily table, say), so that the frame is not computed twice.
    The table joined on has one row per date and five narrow columns: the date type
    itself bounds it (a century of trading is 26,000 rows), and the planner may broadcast it.
    """
    targets = (frame if calendar is None else calendar).select("date").distinct()
    aligned = align_prior_session(lead_signals(tsm, sox, fx), targets)
    wide = aligned.groupBy("date").agg(*[
        F.max(F.when(F.col("series") == name, F.col("value"))).alias(name) for name in LEAD_COLUMNS
    ])
    return frame.join(wide, "date", "left").withColumns(lead_flags())


