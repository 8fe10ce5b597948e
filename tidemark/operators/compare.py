"""Paired comparison of strategies, bootstrap intervals, random buying and verdicts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import (
    BOOTSTRAP_SEED, BOOTSTRAP_SIMULATIONS, FIXED_DAYS, HOLDOUT_BLOCK, OOS_BLOCK,
)
from tidemark.functions.scalars import rate
from tidemark.functions.windows import spread
from tidemark.operators import metrics as M
from tidemark.operators.selection import fixed_day, select_by_rules

PAIR_KEY = ("symbol", "strategy")


def pair_months(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, month, improvement): baseline regret less candidate regret, months in both."""
    base = baseline.select("symbol", "month", F.col("regret").alias("baseline_regret"))
    return candidate.select(*PAIR_KEY, "month", "regret").join(base, ["symbol", "month"]).withColumn(
        "improvement", F.col("baseline_regret") - F.col("regret"))


def monthly_series(keep: Column | None = None) -> Column:
    """Improvements in month order: at most one value per month of one strategy."""
    pair = F.struct("month", "improvement")
    kept = pair if keep is None else F.when(keep, pair)
    return F.transform(F.array_sort(F.collect_list(kept)), lambda item: item["improvement"])


def circular_means(values: np.ndarray, block: int, simulations: int, seed: int) -> np.ndarray:
    """Means of resampled circles, in portions of a bounded number of blocks.

    Blocks wrap around, so each one's sum is a difference of running sums over the doubled series; the
    last block is cut to the length that is left. The generator's stream does not depend on the portions.
    """
    n = len(values)
    run = np.concatenate([[0.0], np.cumsum(np.tile(values, 2))])
    blocks = -(-n // block)
    taken = np.full(blocks, block)
    taken[-1] = n - block * (blocks - 1)
    source, portion = np.random.default_rng(seed), max(1, 1_000_000 // blocks)
    means = [
        (run[starts + taken] - run[starts]).sum(axis=1) / n
        for first in range(0, simulations, portion)
        for starts in [source.integers(0, n, size=(min(portion, simulations - first), blocks))]
    ]
    return np.concatenate(means)


def block_interval(
    values: Sequence[float], block: int = OOS_BLOCK, simulations: int = BOOTSTRAP_SIMULATIONS,
    seed: int = BOOTSTRAP_SEED,
) -> list[float]:
    """95 % interval of the mean by circular blocks, the library generator as source."""
    series = np.array(list(values), float)
    usable = series.ndim == 1 and series.size >= 2 and bool(np.isfinite(series).all())
    if not usable or min(block, simulations) < 1:
        raise ValueError("bootstrap needs two finite values, a block and a simulation at least")
    return np.quantile(circular_means(series, min(block, series.size), simulations, seed), (0.025, 0.975)).tolist()


def interval(
    series: Column, block: int = OOS_BLOCK, simulations: int = BOOTSTRAP_SIMULATIONS,
    seed: int = BOOTSTRAP_SEED,
) -> Column:
    """Array column [low, high] in basis points from an array column of monthly values."""
    @F.pandas_udf("array<double>")
    def bootstrap(batch: pd.Series) -> pd.Series:
        return batch.map(lambda values: None if values is None or len(values) < 2 else [
            level * 10_000.0 for level in block_interval(values, block, simulations, seed)])

    return bootstrap(series)


def hashed_start(simulation: Column, block: Column, length: Column, seed: int) -> Column:
    """Start position from a digest of (simulation, block, seed): the same in any engine."""
    text = F.concat_ws("-", simulation.cast("string"), block.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % length


#: Simulations of one key that a task draws together.
PORTION = 500


def dealt_simulations(rows: DataFrame, key: Sequence[str], simulations: int) -> DataFrame:
    """Each row once per simulation, with its number ``sim``; a key's portions of simulations go to tasks of
    their own, with one copy of the row each. What follows merges partial results by key."""
    last = F.lit((simulations - 1) // PORTION)
    dealt = spread(rows.withColumn("_portion", F.explode(F.sequence(F.lit(0), last))), *key, "_portion")
    first = F.col("_portion") * PORTION
    return dealt.withColumn("sim", F.explode(F.sequence(first, F.least(first + PORTION, F.lit(simulations)) - 1))).drop("_portion")


def hashed_interval(
    paired: DataFrame, key: Sequence[str] = PAIR_KEY, block: int = OOS_BLOCK,
    simulations: int = BOOTSTRAP_SIMULATIONS, seed: int = BOOTSTRAP_SEED,
) -> DataFrame:
    """The same bootstrap without Python, with starts that SQL can repeat.

    A block's sum is a difference of running sums on the doubled circle, so a simulation
    adds ceil(n / block) numbers instead of n. Keys and portions of their simulations are
    spread over the cluster.
    """
    series = spread(paired, *key).groupBy(*key).agg(monthly_series().alias("s")).where(F.size("s") >= 2)
    shaped = series.select(
        *key, F.size("s").alias("n"),
        F.least(F.lit(block), F.size("s")).alias("block"),
        F.expr("aggregate(concat(s, s), array(0D), (a, x) -> concat(a, array(a[size(a) - 1] + x)))")
        .alias("running"),
    ).withColumn("blocks", F.ceil(F.col("n") / F.col("block")).cast("int"))
    simulated = dealt_simulations(shaped, key, simulations)

    def block_sum(number: Column) -> Column:
        start = hashed_start(F.col("sim"), number, F.col("n"), seed).cast("int")
        taken = F.least(F.col("block"), F.col("n") - number * F.col("block"))
        return F.get(F.col("running"), start + taken) - F.get(F.col("running"), start)

    total = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), block_sum), F.lit(0.0), lambda a, x: a + x)
    means = simulated.select(*key, (total / F.col("n")).alias("mean"))
    levels = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*key).agg(
        (levels[0] * 10_000.0).alias("ci95_low_bps"), (levels[1] * 10_000.0).alias("ci95_high_bps"))


def paired_improvement(
    candidate: DataFrame, baseline: DataFrame, block: int = OOS_BLOCK,
    simulations: int = BOOTSTRAP_SIMULATIONS, with_interval: bool = True,
) -> DataFrame:
    """Mean improvement in basis points per strategy, with its interval."""
    months = pair_months(candidate, baseline)
    paired = (spread(months, *PAIR_KEY) if with_interval else months).groupBy(*PAIR_KEY).agg(
        F.count(F.lit(1)).alias("months"),
        (F.avg("improvement") * 10_000.0).alias("improvement_bps"),
        *([monthly_series().alias("_series")] if with_interval else []),
    )
    if not with_interval:
        return paired
    return paired.withColumn("ci95_bps", interval(F.col("_series"), block, simulations)).drop("_series")


def compare_to_day1(
    purchases: DataFrame, day1: DataFrame, terminal: DataFrame, holdout: tuple[str, str],
    with_interval: bool = True, simulations: int = BOOTSTRAP_SIMULATIONS,
) -> DataFrame:
    """Metrics, wealth and improvement over day 1, out of sample and on the holdout.

    One join with day 1 and one aggregation per strategy; the holdout is a condition
    inside the aggregates, not a second pass.
    """
    base = day1.select("symbol", "month", F.col("regret").alias("_base"))
    rows = purchases.join(base, ["symbol", "month"], "left").withColumns({
        "improvement": F.col("_base") - F.col("regret"),
        "_held": F.col("month").between(*holdout),
    })
    paired = F.col("_base").isNotNull()
    held = F.col("_held")
    series = [
        monthly_series(paired).alias("_oos"), monthly_series(paired & held).alias("_holdout"),
    ] if with_interval else []
    grouped = (spread(rows, *PAIR_KEY) if with_interval else rows).groupBy(*PAIR_KEY).agg(
        *M.metric_columns(), M.invested_units().alias("_units"),
        (F.avg("improvement") * 10_000.0).alias("improvement_bps"),
        F.avg(F.when(held, F.col("regret"))).alias("holdout_mean_regret"),
        F.coalesce(rate(F.when(held, F.col("forced"))), F.lit(0.0)).alias("holdout_forced_rate"),
        F.avg(F.when(held, F.col("trading_day").cast("double"))).alias("holdout_mean_trading_day"),
        (F.avg(F.when(held, F.col("improvement"))) * 10_000.0).alias("holdout_improvement_bps"),
        *series,
    )
    if with_interval:
        grouped = grouped.withColumns({
            "ci95_bps": interval(F.col("_oos"), OOS_BLOCK, simulations),
            "holdout_ci95_bps": interval(F.col("_holdout"), HOLDOUT_BLOCK, simulations),
        }).drop("_oos", "_holdout")
    return (
        grouped.join(terminal, "symbol")
        .withColumn("terminal_wealth_proxy", F.col("_units") * F.col("terminal_adjusted_close"))
        .drop("_units", "terminal_adjusted_close")
    )


def best_fixed_day(rows: DataFrame, days: Sequence[int] = FIXED_DAYS) -> DataFrame:
    """Per symbol the fixed day with the least mean regret; the earlier in the list wins ties."""
    bought = select_by_rules(rows, [fixed_day(day) for day in days])
    position = F.coalesce(*[F.when(F.col("strategy") == f"fixed_day_{day}", n) for n, day in enumerate(days)])
    means = bought.groupBy("symbol", "strategy").agg(F.avg("regret").alias("mean_regret"))
    return means.withColumn("position", position).groupBy("symbol").agg(
        F.element_at(
            F.array(*map(F.lit, days)), F.min_by("position", F.struct("mean_regret", "position")) + 1
        ).alias("selected_day")
    )


def holdout_result(
    labelled: DataFrame, model_purchases: DataFrame, development_start: str | Column,
    holdout: tuple[str, str], with_interval: bool = True, simulations: int = BOOTSTRAP_SIMULATIONS,
) -> DataFrame:
    """Model against the fixed day that was best before the holdout.

    The ``day1_*`` names are kept although they hold the selected day's figures.
    """
    start = F.lit(development_start) if isinstance(development_start, str) else development_start
    before = labelled.where((F.col("month") >= start) & (F.col("month") < holdout[0]))
    inside = labelled.where(F.col("month").between(*holdout))
    chosen = best_fixed_day(before)
    fixed = inside.join(chosen, "symbol").where(
        F.col("trading_day") == F.least("days_in_month", "selected_day"))
    model = model_purchases.where(F.col("month").between(*holdout)).select(
        "symbol", "month", F.col("regret").alias("_model"))
    rows = fixed.select("symbol", "month", "selected_day", "regret").join(model, ["symbol", "month"], "full")
    paired = F.col("regret").isNotNull() & F.col("_model").isNotNull()
    rows = rows.withColumn("improvement", F.col("regret") - F.col("_model"))
    grouped = rows.groupBy("symbol").agg(
        F.count("regret").alias("months"),
        F.max("selected_day").alias("selected_day"),
        F.avg("regret").alias("day1_mean_regret"),
        rate(F.col("regret") <= 0.005).alias("day1_within_rate"),
        F.avg("_model").alias("model_mean_regret"),
        (F.avg("improvement") * 10_000.0).alias("model_improvement_bps"),
        *([monthly_series(paired).alias("_series")] if with_interval else []),
    )
    if not with_interval:
        return grouped
    return grouped.withColumn(
        "model_ci95_bps", interval(F.col("_series"), HOLDOUT_BLOCK, simulations)).drop("_series")


def _month_lists(labelled: DataFrame) -> DataFrame:
    """Per symbol the regrets of each month as a list of lists, months in order.

    A symbol has one row per trading date, so a list of lists stays a few hundred kB.
    """
    months = spread(labelled.select("symbol", "month", "trading_day", "regret"), "symbol").groupBy(
        "symbol", "month").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("trading_day", "regret"))), lambda x: x["regret"])
        .alias("regrets"))
    return months.groupBy("symbol").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("month", "regrets"))), lambda x: x["regrets"])
        .alias("months"))


def random_means(months: Sequence[Sequence[float]], simulations: int, seed: int) -> np.ndarray:
    """Mean regret of each simulation: one day of every month, all from one flat array at drawn places."""
    source = np.random.default_rng(seed)
    sizes = np.array([len(month) for month in months])
    places = np.stack([source.integers(0, size, size=simulations) for size in sizes.tolist()])
    flat = np.concatenate([np.array(month, float) for month in months])
    return flat[places + (np.cumsum(sizes) - sizes)[:, None]].mean(axis=0)


def random_strategy(
    labelled: DataFrame, simulations: int = BOOTSTRAP_SIMULATIONS, seed: int = BOOTSTRAP_SEED
) -> DataFrame:
    """Mean and 95 % band of buying on a random day, the library generator as source."""
    @F.pandas_udf("struct<mean_regret double, ci95_low double, ci95_high double>")
    def simulate(batch: pd.Series) -> pd.DataFrame:
        found = [random_means(months, simulations, seed) for months in batch]
        levels = [(m.mean(), *np.quantile(m, (0.025, 0.975))) for m in found]
        return pd.DataFrame(levels, columns=["mean_regret", "ci95_low", "ci95_high"])

    return _month_lists(labelled).select("symbol", simulate("months").alias("r")).select("symbol", "r.*")


def hashed_random_strategy(
    labelled: DataFrame, simulations: int = BOOTSTRAP_SIMULATIONS, seed: int = BOOTSTRAP_SEED
) -> DataFrame:
    """The same without Python, drawing by digest so that SQL can repeat it."""
    simulated = dealt_simulations(_month_lists(labelled), ("symbol",), simulations)

    def drawn(values: Column, number: Column) -> Column:
        return F.get(values, hashed_start(F.col("sim"), number, F.size(values), seed).cast("int"))

    total = F.aggregate(F.transform("months", drawn), F.lit(0.0), lambda a, x: a + x)
    means = simulated.select("symbol", (total / F.size("months")).alias("mean"))
    levels = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy("symbol").agg(
        F.avg("mean").alias("mean_regret"), levels[0].alias("ci95_low"), levels[1].alias("ci95_high"))


def verdict(low: Column, high: Column) -> Column:
    """NULL where there is no interval."""
    return (
        F.when(low.isNull() | high.isNull(), F.lit(None).cast("string")).when((low > 0) & (high > 0), "better")
        .when((low < 0) & (high < 0), "worse").otherwise("inconclusive")
    )


def rule_role(forced_rate: Column, mean_trading_day: Column) -> Column:
    return (
        F.when((forced_rate < 0.05) & (mean_trading_day < 1.35), "almost_day1")
        .when(forced_rate < 0.05, "delayed_day1").otherwise("filter")
    )


def all_holdout_negative(compared: DataFrame) -> DataFrame:
    return compared.groupBy("symbol").agg(
        F.bool_and(F.col("holdout_improvement_bps") < 0).alias("all_holdout_negative"))


def running_months(labelled: DataFrame) -> DataFrame:
    """Per symbol and month: rows and the same counts over all earlier months."""
    before = Window.partitionBy("symbol").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = labelled.groupBy("symbol", "month").agg(
        F.count(F.lit(1)).alias("test_rows"), F.count_if("near_optimal").alias("test_near"))
    return months.withColumns({
        "train_months": F.count(F.lit(1)).over(before),
        "train_rows": F.coalesce(F.sum("test_rows").over(before), F.lit(0)),
        "train_near": F.coalesce(F.sum("test_near").over(before), F.lit(0)),
        "training_through": F.max("month").over(before),
    })
