"""Window specifications.

Every window here is partitioned by ``symbol`` or ``(symbol, month)``. The key
``(symbol, date)`` is unique (the ``quality`` module checks it, the composite operators
guard it inline), so a partition holds at most one row per calendar date of one symbol:
about 250 rows a year, whatever the number of ticks or symbols. Tick-level skew is gone
before any window runs because ticks are combined map-side into one row per symbol
and date.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol")


def by_date() -> WindowSpec:
    return by_symbol().orderBy("date")


def so_far() -> WindowSpec:
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def by_month() -> WindowSpec:
    return Window.partitionBy("symbol", "month")


def in_month() -> WindowSpec:
    return by_month().orderBy("date")


def rest_of_month() -> WindowSpec:
    return in_month().rowsBetween(0, Window.unboundedFollowing)


def trailing(rows: int) -> WindowSpec:
    """The ``rows`` rows before the current one, so that a result is known before today."""
    return by_date().rowsBetween(-rows, -1)


def known_by(rows_ago: int) -> WindowSpec:
    """All rows up to the one ``rows_ago`` rows back; with ``last`` it pads gaps."""
    return by_date().rowsBetween(Window.unboundedPreceding, -rows_ago)


def running_product(value: Column | str) -> Column:
    return F.product(value).over(so_far())


#: Days that stand in one window of a long series.
BLOCK_DAYS = 256


def last_known(df: DataFrame, key: str, day: str, values: Mapping[str, Column], then: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``<name>_upto`` and ``<name>_before`` for each of ``values``: its last non-null value up to and
    including the row, and strictly before it, in order of ``day``, then ``then``, within ``key``.

    A series is cut into blocks of ``BLOCK_DAYS`` days, so that no window holds more of it than one block;
    what earlier blocks end with is carried over by a pass over one row per block. A column ``block`` is added too.
    """
    order = [day, *then]
    framed = df.withColumn("block", F.floor(F.unix_date(day) / BLOCK_DAYS))
    inside = Window.partitionBy(key, "block").orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    running = framed.withColumns({
        **{f"{name}_upto": F.last(value, True).over(upto) for name, value in values.items()},
        **{f"{name}_before": F.last(value, True).over(before) for name, value in values.items()}})
    ends = framed.groupBy(key, "block").agg(*[
        F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias(f"_{name}") for name, value in values.items()])
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "block", *[F.last(f"_{name}", True).over(earlier).alias(f"_{name}") for name in values])
    return running.join(carried, [key, "block"]).withColumns({
        f"{name}_{side}": F.coalesce(f"{name}_{side}", f"_{name}") for name in values for side in ("upto", "before")
    }).drop(*[f"_{name}" for name in values])


def running_count(df: DataFrame, key: str, day: str, name: str) -> DataFrame:
    """``df`` with ``name``, the row's place in its series by day, by the same blocks as ``last_known``."""
    framed = df.withColumn("block", F.floor(F.unix_date(day) / BLOCK_DAYS))
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = framed.groupBy(key, "block").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select(key, "block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"))
    place = F.row_number().over(Window.partitionBy(key, "block").orderBy(day))
    return framed.withColumn(name, place).join(before, [key, "block"]).withColumn(name, F.col(name) + F.col("_rows")).drop("_rows", "block")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by ``keys`` into as many tasks as shuffles are set to.

    The windows or groups that follow need this exchange anyway. Stated here it keeps its
    task number: they are bound by computation, and adaptive execution, which sizes tasks
    by bytes, would run them in far too few.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys)


def spread_by_symbol(df: DataFrame) -> DataFrame:
    return spread(df, "symbol")
