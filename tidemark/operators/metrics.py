"""Aggregates over purchases, oracle rows, signals and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import (
    ALL_FEATURES, COMMISSION_RATE, LEAD_RULES, MONTHLY_CONTRIBUTION, RANGE_FEATURES,
    RANGE_FEATURES_LOCAL,
)
from tidemark.functions.scalars import rate
from tidemark.operators.adjust import open_gap

QUANTILES = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
PURCHASE_KEY = ("symbol", "strategy")


def terminal_close(daily: DataFrame) -> DataFrame:
    """Last adjusted close per symbol, taken over all rows (also incomplete months)."""
    return daily.groupBy("symbol").agg(
        F.max_by("adjusted_close", "date").alias("terminal_adjusted_close")
    )


def metric_columns(keep: Column | None = None, prefix: str = "") -> list[Column]:
    """Strategy metrics over the purchases that ``keep`` selects (all by default)."""
    def kept(value: Column) -> Column:
        return value if keep is None else F.when(keep, value)

    regret = kept(F.col("regret"))
    levels = F.percentile(regret, F.array(*map(F.lit, QUANTILES.values())))
    return [
        F.count(regret).alias(f"{prefix}months"),
        F.avg(regret).alias(f"{prefix}mean_regret"),
        *[levels[n].alias(f"{prefix}{name}_regret") for n, name in enumerate(QUANTILES)],
        rate(regret <= 0.005).alias(f"{prefix}within_0_5pct_rate"),
        rate(regret <= 0.01).alias(f"{prefix}within_1pct_rate"),
        F.avg(kept(F.col("trading_day").cast("double"))).alias(f"{prefix}mean_trading_day"),
        rate(kept(F.col("forced"))).alias(f"{prefix}forced_rate"),
    ]


def invested_units(contribution: float = MONTHLY_CONTRIBUTION, commission: float = COMMISSION_RATE) -> Column:
    """Fractional total-return units bought by equal monthly payments after commission."""
    return F.sum(F.lit(contribution / (1.0 + commission)) / F.col("adjusted_open"))


def strategy_metrics(purchases: DataFrame, key: Sequence[str] = PURCHASE_KEY) -> DataFrame:
    """One row of metrics per key; ``forced_rate`` is NULL where forced is unknown."""
    known = purchases if "forced" in purchases.columns else purchases.withColumn(
        "forced", F.lit(None).cast("boolean"))
    return known.groupBy(*key).agg(*metric_columns())


def terminal_wealth(
    purchases: DataFrame, terminal: DataFrame, key: Sequence[str] = PURCHASE_KEY,
    contribution: float = MONTHLY_CONTRIBUTION, commission: float = COMMISSION_RATE,
) -> DataFrame:
    units = purchases.groupBy(*key).agg(invested_units(contribution, commission).alias("units"))
    return units.join(terminal, "symbol").select(
        *key, (F.col("units") * F.col("terminal_adjusted_close")).alias("terminal_wealth_proxy")
    )


def metrics_with_wealth(
    purchases: DataFrame, terminal: DataFrame, key: Sequence[str] = PURCHASE_KEY
) -> DataFrame:
    """Metrics and wealth from one aggregation of the purchases."""
    known = purchases if "forced" in purchases.columns else purchases.withColumn(
        "forced", F.lit(None).cast("boolean"))
    grouped = known.groupBy(*key).agg(*metric_columns(), invested_units().alias("_units"))
    return (
        grouped.join(terminal, "symbol")
        .withColumn("terminal_wealth_proxy", F.col("_units") * F.col("terminal_adjusted_close"))
        .drop("_units", "terminal_adjusted_close")
    )


def oracle_distribution(oracle: DataFrame) -> DataFrame:
    day = F.col("oracle_trading_day")
    return oracle.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("months"),
        F.avg(day).alias("mean_day"),
        F.median(day).alias("median_day"),
        F.mode(day, deterministic=True).alias("mode_day"),
        rate(day == 1).alias("first_day_rate"),
        rate(day <= 5).alias("first_5_rate"),
        rate(day <= 10).alias("first_10_rate"),
    )


def oracle_day_histogram(oracle: DataFrame) -> DataFrame:
    return oracle.groupBy("symbol", "oracle_trading_day").agg(F.count(F.lit(1)).alias("months"))


def long_form(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keep..., feature, value) rows for the features that the table has."""
    present = [name for name in features if name in df.columns]
    doubles = df.select(*keep, *[F.col(name).cast("double").alias(name) for name in present])
    return doubles.unpivot(list(keep), present, "feature", "value")


def oracle_ranges(labelled: DataFrame, daily: DataFrame, local_features: bool = True) -> DataFrame:
    """Quartiles of the features on oracle days; constant or empty features drop out."""
    gaps = open_gap(daily).select("symbol", "date", "open_gap_vs_action_ref")
    rows = labelled.where("is_oracle").join(gaps, ["symbol", "date"])
    names = RANGE_FEATURES + (RANGE_FEATURES_LOCAL if local_features else ())
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        long_form(rows, ("symbol",), names).where("value IS NOT NULL")
        .groupBy("symbol", "feature")
        .agg(quartiles[0].alias("q25"), quartiles[1].alias("median"), quartiles[2].alias("q75"),
             F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"),
             F.min("value").alias("_low"), F.max("value").alias("_high"))
        .where("_low < _high").drop("_low", "_high")
    )


def percentile_rank(value: Column, group: Sequence[str | Column]) -> Column:
    """Average rank of tied values over the number of values (NULLs excluded beforehand)."""
    inside = Window.partitionBy(*group)
    ties = F.count(value).over(Window.partitionBy(*group, value))
    rank = F.rank().over(inside.orderBy(value)) + (ties - 1) / F.lit(2.0)
    return rank / F.count(value).over(inside)


def oracle_feature_profile(labelled: DataFrame, features: Sequence[str] = ALL_FEATURES) -> DataFrame:
    """Mean in-month percentile rank of each feature on the oracle day.

    Only the oracle row's rank is asked for, so no sort is needed: it follows from how
    many values of the month lie below it and how many equal it. The oracle day's own
    value is spread over its month by a window that has no order.
    """
    present = [name for name in features if name in labelled.columns]
    month = Window.partitionBy("symbol", "month")
    own = labelled.withColumns({
        f"_own_{name}": F.max(F.when(F.col("is_oracle"), F.col(name).cast("double"))).over(month)
        for name in present
    })
    per_month = own.groupBy("symbol", "month").agg(*[
        F.try_divide(
            F.count_if(F.col(name) < F.col(f"_own_{name}"))
            + (F.count_if(F.col(name) == F.col(f"_own_{name}")) + 1) / F.lit(2.0),
            F.when(F.max(f"_own_{name}").isNotNull(), F.count(name)),
        ).alias(name)
        for name in present
    ])
    return (
        per_month.unpivot(["symbol", "month"], present, "feature", "rank")
        .where("rank IS NOT NULL").groupBy("symbol", "feature")
        .agg(F.avg("rank").alias("oracle_mean_percentile"), F.count(F.lit(1)).alias("months"))
        .withColumn("distance_from_median", F.col("oracle_mean_percentile") - 0.5)
        .select("symbol", "feature", "oracle_mean_percentile", "distance_from_median", "months")
    )


def by_distance(profile: DataFrame) -> DataFrame:
    """Largest distance from the middle first; the feature name settles ties."""
    return profile.orderBy("symbol", F.abs("distance_from_median").desc(), "feature")


def top_features(profile: DataFrame, count: int = 12) -> DataFrame:
    """The report's top features per symbol."""
    order = Window.partitionBy("symbol").orderBy(F.abs("distance_from_median").desc(), "feature")
    return profile.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def lead_coverage(rows: DataFrame) -> DataFrame:
    """Availability of the leads and rates of their flags (pause and adverse rates negate)."""
    return rows.groupBy("symbol").agg(
        rate(F.col("tsm_lead_ret").isNotNull()).alias("tsm_available_rate"),
        rate(F.col("sox_lead_ret").isNotNull()).alias("sox_available_rate"),
        rate(F.col("usd_twd_up").isNotNull()).alias("fx_available_rate"),
        rate(F.col("tsm_dump")).alias("tsm_dump_rate"),
        rate(F.col("sox_dump")).alias("sox_dump_rate"),
        rate(~F.col("fx_not_depreciating")).alias("fx_pause_rate"),
        rate(F.col("tsm_dump_1pct")).alias("tsm_dump_1pct_rate"),
        rate(~F.col("tsm_not_dump")).alias("tsm_adverse_rate"),
        rate(~F.col("fx_not_up")).alias("fx_single_pause_rate"),
    )


def signal_rates(rows: DataFrame) -> DataFrame:
    """Share of days on which each rule's signal is on."""
    wide = rows.groupBy("symbol").agg(*[rate(F.col(column)).alias(name) for name, column in LEAD_RULES.items()])
    return wide.unpivot(["symbol"], list(LEAD_RULES), "strategy", "signal_rate")


def brier_score(predictions: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    miss = F.col("near_probability") - F.col("near_optimal").cast("double")
    return predictions.groupBy(*key).agg(F.avg(miss * miss).alias("brier"))


def average_precision(predictions: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Sum of recall steps times precision, equal scores taken as one step.

    Equal scores are merged first; the running sums then order distinct scores only.
    """
    scores = predictions.groupBy(*key, "near_probability").agg(
        F.count_if("near_optimal").alias("_hits"), F.count(F.lit(1)).alias("_rows")
    )
    down = Window.partitionBy(*key).orderBy(F.col("near_probability").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    steps = scores.withColumn("_precision", F.sum("_hits").over(down) / F.sum("_rows").over(down))
    return steps.groupBy(*key).agg(
        F.coalesce(F.try_divide(F.sum(F.col("_hits") * F.col("_precision")), F.sum("_hits")), F.lit(0.0))
        .alias("average_precision")
    )


def month_weights(rows: DataFrame) -> DataFrame:
    """Weight of a row so that every month weighs the same."""
    return rows.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("symbol", "month")))
