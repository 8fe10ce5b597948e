"""A store of model scores that is updated in place, partition by partition.

Scores lie in partitions of (symbol bucket, month). An update scores the folds that are new or changed, drops
those no longer asked for, and rewrites only the partitions that hold one of either; all others keep their
files. Prices are not stored: they come from the labelled table whenever predictions are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.config import FEATURE_SETS, ModelConfig
from tidemark.operators import walkforward as W
from tidemark.operators.models import fit_and_score
from tidemark.session import children, delete, scratch, written

BUCKETS = 64
STORED = ("symbol string, date date, feature_set string, near_probability double, predicted_remaining_log_ratio double, "
          "training_through string, fingerprint long, bucket int, test_month string")
NAMES = [field.split()[0] for field in STORED.split(", ")]


@dataclass(frozen=True)
class Update:
    """What an update did: folds scored and dropped, and the partitions it wrote or deleted."""

    scored: int
    dropped: int
    partitions: list[tuple[int, str]]


def bucket_of(symbol: str = "symbol", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The stored scores; an empty table where nothing is stored."""
    if not children(spark, folder):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(folder)


def update(
    labelled: DataFrame, folder: str, config: ModelConfig = ModelConfig(),
    sets: Mapping[str, Sequence[str]] = FEATURE_SETS, buckets: int = BUCKETS, estimator: W.Estimator = fit_and_score,
) -> Update:
    """Bring the store at ``folder`` up to date with ``labelled``, ``config`` and ``sets``.

    Every run must name the same ``buckets``. A partition that loses all its folds is deleted.
    """
    spark = labelled.sparkSession
    with scratch(spark):
        stored = read(spark, folder)
        wanted = written(W.fingerprints(labelled, config, sets), "store-wanted")
        held = W.stored_folds(stored)
        todo = written(wanted.join(held, W.FOLD, "left_anti").select(*W.FOLD), "store-todo")
        stale = written(held.join(wanted, W.FOLD, "left_anti").select(*W.FOLD), "store-stale")
        touched = written(
            todo.unionByName(stale).select(bucket_of(buckets=buckets).alias("bucket"), "test_month").distinct(), "store-touched")
        partitions = sorted((row["bucket"], row["test_month"]) for row in touched.collect())  # names of partitions only
        counts = todo.count(), stale.count()
        if not partitions:
            return Update(0, 0, [])
        fresh = W.walk_forward(labelled, config, sets, stored=stored, estimator=estimator).select(
            "symbol", "date", "feature_set", *W.SCORES, "fingerprint", bucket_of(buckets=buckets).alias("bucket"),
            F.col("month").alias("test_month"))
        kept = stored.join(touched, ["bucket", "test_month"], "left_semi").join(wanted.select(*W.FOLD), W.FOLD, "left_semi")
        # both sides are settled before their files are replaced
        rows = written(fresh.select(*NAMES).unionByName(kept.select(*NAMES)), "store-rows")
        full = {(row["bucket"], row["test_month"]) for row in rows.select("bucket", "test_month").distinct().collect()}
        if full:
            (rows.repartition("bucket", "test_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("bucket", "test_month").parquet(folder))
        for bucket, month in set(partitions) - full:
            delete(spark, f"{folder.rstrip('/')}/bucket={bucket}/test_month={month}")
    return Update(*counts, partitions)


def predictions(
    labelled: DataFrame, folder: str, config: ModelConfig = ModelConfig(), sets: Mapping[str, Sequence[str]] = FEATURE_SETS,
) -> DataFrame:
    """Stored scores of the feature sets with current prices and reservations; stale folds are left out."""
    scores = read(labelled.sparkSession, folder).join(
        W.fingerprints(labelled, config, sets).select(*W.FOLD), W.FOLD, "left_semi")
    scores = scores.select("symbol", "date", "feature_set", *W.SCORES, "fingerprint")
    return W.reservation_prices(labelled.join(scores, ["symbol", "date"]), config)
