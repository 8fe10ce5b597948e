"""Mixing sources to target weights by entropy balancing.

Rates r of documents stay as close to one as the token constraints allow: the sum of r log r - r is
smallest, subject to r <= 2 and, for each source, the sum of r * size equal to its target. The convex
dual has one multiplier per source; its solution is an exponential tilt, r = min(2, exp(tilt * size)).
Documents of one source and size have one rate, so the sums run over (source, size) classes, which no
hot source or group of copies makes larger than its number of distinct sizes. Every Newton step is one
distributed aggregate over the classes for all sources at once; multipliers are a written table.

Rounding works on the same classes: cumulative rates by falling size give whole numbers of copies per
class, then a few passes move copies so that each source's tokens meet its target up to its smallest
fitting documents. Within a class the documents that get the odd copy are found by rank in hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import WORD, whole_text
from tidemark.session import written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2
STEPS, PASSES, SALTS = 60, 8, 64
#: A multiplier is settled when its tokens are this near the target, as a share and in tokens.
NEAR, NEAR_TOKENS = 1e-6, 1e-1


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``sources(source, source_size)``, one row per source.

    Sources by code point, null last, take the weights in turn. A target that would exceed ``limit``
    times its source's size stops there and the excess is shared anew by weight: with sources in order
    of limit over weight, the first so many are at their limit, and the rest get one level times weight.
    Both windows run over the sources alone.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    top = (F.lit(limit) * F.col("source_size")).cast("double")
    by_level = Window.orderBy("_level", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    frame = (sources.withColumn("weight", weight).withColumn("_top", top)
             .withColumn("_level", F.col("_top") / F.col("weight")))
    frame = frame.withColumns({
        "_wanted": F.least(F.lit(share) * F.sum("source_size").over(everything), F.sum("_top").over(everything)),
        "_before": F.sum("_top").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_top"),
        "_open": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
    })
    # the level if this source and all after it stay open; those before it are at their limits
    frame = frame.withColumn("_try", (F.col("_wanted") - F.col("_before")) / F.col("_open"))
    level = F.max(F.when(F.col("_level") > F.col("_try"), F.col("_try"))).over(everything)
    target = F.when(F.coalesce(F.col("_level") <= level, F.lit(True)), F.col("_top")).otherwise(F.col("weight") * level)
    return frame.withColumn("target", target).drop("_top", "_level", "_wanted", "_before", "_open", "_try")


def rate(size: Column, tilt: Column, limit: int = LIMIT) -> Column:
    """Copies of a document that the tilt asks for."""
    return F.least(F.lit(float(limit)), F.exp(F.least(tilt * size, F.lit(50.0))))


def balance(classes: DataFrame, sources: DataFrame, limit: int = LIMIT, steps: int = STEPS) -> DataFrame:
    """Adds ``tilt`` to ``sources``: the multiplier whose rates give the target's tokens.

    ``classes(source, size, n)`` has documents by source and size. Newton steps on the logarithm of the
    tokens, kept inside a bracket that every step narrows. A source at its limit has rate ``limit``
    throughout (tilt null), one without words or target has tilt 0.
    """
    spark = classes.sparkSession
    positive = classes.where("size > 0")
    smallest = positive.groupBy("source").agg(F.min("size").alias("_least"), F.max("size").alias("_most"))
    state = (sources.join(smallest, sources["source"].eqNullSafe(smallest["source"]), "left").drop(smallest["source"])
             .withColumn("_full", F.col("target") >= F.col("source_size") * limit * (1 - 1e-12))
             .withColumn("_idle", (F.col("target") <= 0) | F.col("_least").isNull())
             .withColumns({
                 "_high": F.log(F.lit(float(limit))) / F.col("_least"),
                 "_low": F.least(F.lit(0.0), F.log(F.try_divide("target", limit * F.col("source_size"))) / F.col("_least")),
                 "tilt": F.lit(0.0), "_done": F.col("_full") | F.col("_idle")}))
    for step in range(steps):
        state = written(state, f"mix-tilt-{step}")
        if state.where("not _done").isEmpty():
            break
        at = state.where("not _done").select(F.col("source").alias("_s"), "tilt")
        joined = positive.join(at, positive["source"].eqNullSafe(at["_s"]))
        mass = F.col("n") * F.col("size") * rate(F.col("size"), F.col("tilt"), limit)
        tilted = F.when(F.col("tilt") * F.col("size") < F.log(F.lit(float(limit))), F.col("size")).otherwise(0)
        sums = joined.groupBy("_s").agg(F.sum(mass).alias("_got"), F.sum(mass * tilted).alias("_slope"))
        state = state.join(sums, state["source"].eqNullSafe(sums["_s"]), "left").drop("_s")
        off = F.col("_got") - F.col("target")
        near = F.abs(off) <= F.greatest(F.col("target") * NEAR, F.lit(NEAR_TOKENS))
        low = F.when(off < 0, F.col("tilt")).otherwise(F.col("_low"))
        high = F.when(off > 0, F.col("tilt")).otherwise(F.col("_high"))
        state = state.withColumns({"_near": F.coalesce("_done", F.lit(False)) | F.coalesce(near, F.lit(True)), "_low": low, "_high": high})
        newton = F.col("tilt") - F.try_divide(F.log(F.try_divide("_got", "target")) * F.col("_got"), F.col("_slope"))
        inside = F.coalesce(F.col("_slope") > 0, F.lit(False)) & newton.isNotNull() & (newton > F.col("_low")) & (newton < F.col("_high"))
        middle = (F.col("_low") + F.col("_high")) / 2
        # a bracket as narrow as doubles allow is settled as well
        stuck = (F.col("_high") - F.col("_low")) <= F.abs(middle) * 1e-15
        state = state.withColumns({
            "tilt": F.when(F.col("_near") | stuck, F.col("tilt")).when(inside, newton).otherwise(middle),
            "_done": F.col("_near") | F.coalesce(stuck, F.lit(False))}).drop("_got", "_slope", "_near")
    tilt = F.when(F.col("_full") & ~F.col("_idle"), F.lit(None).cast("double")).otherwise(F.col("tilt"))
    return state.withColumn("tilt", tilt).select(*sources.columns, "tilt")


def class_copies(classes: DataFrame, sources: DataFrame, limit: int = LIMIT, passes: int = PASSES) -> DataFrame:
    """Whole copies of each (source, size) class: ``source, size, n, rate, copies`` and the source's columns."""
    frame = classes.join(sources.withColumnRenamed("source", "_s"), classes["source"].eqNullSafe(F.col("_s"))).drop("_s")
    wanted = F.when(F.col("size") == 0, 1.0).when(F.col("tilt").isNull(), float(limit)).otherwise(
        rate(F.col("size"), F.col("tilt"), limit))
    falling = Window.partitionBy("source").orderBy(F.col("size").desc())
    so_far = falling.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    frame = frame.withColumn("rate", wanted).withColumn("_sum", F.sum(F.col("n") * F.col("rate")).over(so_far))
    upto = F.floor(F.col("_sum") + 0.5)
    frame = frame.withColumn("copies", upto - F.coalesce(F.lag(upto).over(falling), F.lit(0)))
    frame = frame.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies"), F.col("n") * limit)).cast("long"))
    for _ in range(passes):
        frame = frame.withColumn("_rest", F.floor(F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole)))
        room = F.when(F.col("_rest") > 0, F.col("n") * limit - F.col("copies")).otherwise(F.col("copies"))
        usable = (F.col("size") > 0) & (F.col("size") <= F.abs("_rest"))
        frame = frame.withColumn("_room", F.when(usable, room).otherwise(0))
        tokens = F.col("_room") * F.col("size")
        frame = frame.withColumn("_left", F.abs("_rest") - (F.sum(tokens).over(so_far) - tokens))
        move = F.when(F.col("_room") > 0, F.greatest(F.lit(0), F.least(
            F.col("_room"), F.floor(F.col("_left") / F.greatest(F.col("size"), F.lit(1))))))
        frame = frame.withColumn("copies", (F.col("copies") + F.coalesce(move, F.lit(0)) * F.signum(
            F.col("_rest").cast("double"))).cast("long"))
    return frame.drop("_sum", "_rest", "_room", "_left")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT,
        narrow: bool = True) -> DataFrame:
    """Copies of each row of ``docs(doc_id, text, source, ...)`` that bring its source to its target.

    Returns every row's doc_id, source, size, source_size, target, rate, copies and taken = copies * size;
    with ``narrow=False`` also the other columns, but for those of these names. Null text has size 0, a null source is a source of its
    own, rows without words keep one copy and take nothing. Repeated rows are rows of their own, and
    which of them gets an odd copy cannot be told apart. An empty table gives an empty one.
    """
    words = F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size")
    keys = docs.select("doc_id", "source", words)
    base = written(keys, "mix-sizes") if narrow else docs.select("doc_id", "source", words, F.struct("*").alias("_row"))
    counted = base.groupBy("source", "size").agg(F.count("*").alias("n"))
    classes = written(counted, "mix-classes")
    per_source = classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sources = balance(classes, written(targets(per_source, weights, share, limit), "mix-targets"), limit)
    decided = written(class_copies(classes, sources, limit), "mix-copies")

    # rank within (source, size) in hash order, through salted cells, so that no class meets in one task
    rows = base.withColumn("_hash", F.xxhash64("doc_id")).withColumn("_salt", F.pmod("_hash", F.lit(SALTS)).cast("int"))
    cell = ["source", "size", "_salt"]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("_cell"))
    before = cells.withColumn("_before", F.sum("_cell").over(
        Window.partitionBy("source", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cell"))
    same = [F.col("source").eqNullSafe(F.col("_s")), F.col("size") == F.col("_z")]
    renamed = decided.withColumnsRenamed({"source": "_s", "size": "_z"})
    before = before.withColumnsRenamed({"source": "_s2", "size": "_z2", "_salt": "_salt2"}).drop("_cell")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("_hash", "doc_id")))
    full = (ranked.join(before, ranked["source"].eqNullSafe(F.col("_s2")) & (F.col("size") == F.col("_z2"))
                        & (F.col("_salt") == F.col("_salt2"))).drop("_s2", "_z2", "_salt2")
            .join(renamed, same[0] & same[1]).drop("_s", "_z"))
    place = F.col("_before") + F.col("_rank")
    copies = F.floor(F.col("copies") / F.col("n")) + (place <= F.col("copies") % F.col("n")).cast("int")
    out = full.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    added = ["size", "source_size", "target", "rate", "copies", "taken"]
    if narrow:
        return out.select("doc_id", "source", *added)
    return out.select(*[F.col("_row").getField(name).alias(name) for name in docs.columns if name not in added], *added)
