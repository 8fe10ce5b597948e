"""Expanding-window monthly models as a cogrouped map over (symbol, bucket).

A symbol's test months are dealt to ``buckets`` groups. Each group gets the rows up to
its last test month once and trains all of its folds from them, so rows travel
``buckets`` times instead of once per fold. A group is bounded: one symbol's history has
one row per trading date. Symbols times buckets is the number of parallel tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.config import FEATURE_SETS, ModelConfig
from tidemark.operators.compare import running_months
from tidemark.operators.expanding import Expanding
from tidemark.operators.models import fit_and_score
from tidemark.operators.quality import require_columns

Estimator = Callable[[pd.DataFrame, pd.DataFrame, list[str], ModelConfig], pd.DataFrame]
TARGETS = ("near_optimal", "remaining_min_log_ratio")
CARRIED = ("trading_day", "days_in_month", "adjusted_open", "regret", "previous_adjusted_close")
FINGERPRINT_VERSION = "1"
BUCKETS = 8


def expanding_folds(labelled: DataFrame, initial_months: int) -> DataFrame:
    """Test months after the first ``initial_months``, with the size of their training set.

    Training sets are the earlier months, so their counts are running sums over months;
    no (fold, month) pairs are made.
    """
    folds = running_months(labelled).where(F.col("train_months") >= initial_months)
    return folds.withColumnRenamed("month", "test_month")


def fingerprints(
    labelled: DataFrame, config: ModelConfig, sets: Mapping[str, Sequence[str]] = FEATURE_SETS
) -> DataFrame:
    """(symbol, feature_set, test_month, fingerprint) over all rows a fold reads.

    Row hashes combine by XOR: per month map-side, then running over months.
    """
    def row_hash(columns: Sequence[str]):
        parts = [F.col("date")]
        for name in (*columns, *TARGETS):
            parts += [F.col(name), F.col(name).isNull()]
        return F.bit_xor(F.xxhash64(*parts))

    ordered = Window.partitionBy("symbol").orderBy("month")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    months = labelled.groupBy("symbol", "month").agg(
        *[row_hash(columns).alias(name) for name, columns in sets.items()])
    running = months.withColumn("_n", F.row_number().over(ordered))
    for name, columns in sets.items():
        settings = json.dumps([FINGERPRINT_VERSION, name, list(columns), asdict(config)], sort_keys=True)
        running = running.withColumn(name, F.xxhash64(F.bit_xor(name).over(upto), F.lit(settings)))
    return (
        running.where(F.col("_n") > config.initial_months)
        .unpivot(["symbol", "month"], list(sets), "feature_set", "fingerprint")
        .withColumnRenamed("month", "test_month")
    )


FOLD = ["symbol", "feature_set", "test_month", "fingerprint"]
SCORES = ("near_probability", "predicted_remaining_log_ratio", "training_through")


def stored_folds(stored: DataFrame) -> DataFrame:
    """Folds of a stored table: of fingerprints, or of predictions, whose month is the fold's."""
    if "test_month" not in stored.columns:
        stored = stored.withColumnRenamed("month", "test_month")
    return stored.select(*FOLD).distinct()


def folds_to_score(wanted: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Folds whose fingerprint no stored prediction has."""
    return wanted if stored is None else wanted.join(stored_folds(stored), FOLD, "left_anti")


def _cogroup(labelled: DataFrame, folds: DataFrame, columns: Sequence[str], buckets: int):
    """Rows and folds grouped by (symbol, bucket); only buckets with folds receive rows.

    Training is bound by computation, so the number of tasks is set from the cluster's
    cores; sized by bytes, adaptive execution would merge these small groups.
    """
    tasks = 3 * labelled.sparkSession.sparkContext.defaultParallelism
    ordinal = F.substring("test_month", 1, 4).cast("int") * 12 + F.substring("test_month", 6, 2).cast("int")
    dealt = folds.withColumn("bucket", F.pmod(ordinal, F.lit(buckets)))
    needed = dealt.groupBy("symbol", "bucket").agg(F.max("test_month").alias("_last"))
    rows = (
        labelled.select("symbol", "date", "month", *columns)
        .join(needed, "symbol").where(F.col("month") <= F.col("_last")).drop("_last")
    )
    # Fresh column identities: both sides descend from the labelled table.
    asked = dealt.select(*[F.col(name).alias(name) for name in dealt.columns])
    sides = [df.repartition(tasks, "symbol", "bucket").groupBy("symbol", "bucket") for df in (rows, asked)]
    return sides[0].cogroup(sides[1])


def _split(rows: pd.DataFrame, folds: pd.DataFrame) -> Iterator[tuple[pd.Series, pd.DataFrame, pd.DataFrame]]:
    ordered = rows.sort_values("date", ignore_index=True)
    for _, fold in folds.iterrows():
        train = ordered[ordered["month"] < fold["test_month"]]
        test = ordered[ordered["month"] == fold["test_month"]].reset_index(drop=True)
        if train.empty or test.empty:
            raise ValueError(f"fold {fold['test_month']} of {fold['symbol']} lacks training or test rows")
        yield fold, train, test


def walk_forward(
    labelled: DataFrame, config: ModelConfig = ModelConfig(),
    sets: Mapping[str, Sequence[str]] = FEATURE_SETS, buckets: int = BUCKETS,
    stored: DataFrame | None = None, estimator: Estimator = fit_and_score,
) -> DataFrame:
    """Out-of-sample predictions of every feature set; stored folds are not run again."""
    features = tuple(dict.fromkeys(name for columns in sets.values() for name in columns))
    if not features:
        raise ValueError("feature sets must not be empty")
    extra = [name for name in ("adjustment_factor",) if name in labelled.columns]
    carried = tuple(dict.fromkeys((*CARRIED, *extra)))
    require_columns(labelled, ("symbol", "date", "month", *TARGETS, *CARRIED, *features),
                    "walk-forward input", non_empty=False)
    shipped = tuple(dict.fromkeys((*carried, *TARGETS, *features)))
    folds = folds_to_score(fingerprints(labelled, config, sets), stored)
    chosen = {name: list(columns) for name, columns in sets.items()}
    kept = ["symbol", "date", "month", *carried, *TARGETS]

    def run(rows: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for fold, train, test in _split(rows, group):
            scores = estimator(train, test, chosen[fold["feature_set"]], config)
            parts.append(test[kept].assign(
                feature_set=fold["feature_set"],
                near_probability=scores["near_probability"].to_numpy(),
                predicted_remaining_log_ratio=scores["predicted_remaining_log_ratio"].to_numpy(),
                training_through=train["month"].max(), fingerprint=fold["fingerprint"]))
        if not parts:
            return pd.DataFrame(columns=[field.split()[0] for field in schema.split(", ")])
        return pd.concat(parts, ignore_index=True)

    types = {field.name: field.dataType.simpleString() for field in labelled.schema.fields}
    schema = ", ".join([
        *[f"{name} {types[name]}" for name in kept], "feature_set string", "near_probability double",
        "predicted_remaining_log_ratio double", "training_through string", "fingerprint bigint",
    ])
    scored = _cogroup(labelled, folds, shipped, buckets).applyInPandas(run, schema)
    return reservation_prices(scored, config)


def predictions(
    labelled: DataFrame, config: ModelConfig = ModelConfig(),
    sets: Mapping[str, Sequence[str]] = FEATURE_SETS, stored: DataFrame | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """``walk_forward`` over folds that are new or changed, and stored scores for the rest.

    ``stored`` is an earlier result of this function. Of it only the scores of folds whose fingerprint
    still stands are used: prices and labels come from ``labelled``, so that restated prices show in
    the reservations, and stale folds or feature sets not asked for are left out.
    """
    fresh = walk_forward(labelled, config, sets, buckets, stored)
    if stored is None:
        return fresh
    wanted = fingerprints(labelled, config, sets)
    scores = (stored.withColumnRenamed("month", "test_month").join(wanted, FOLD, "left_semi")
              .select("symbol", "date", "feature_set", *SCORES, "fingerprint"))
    current = [name for name in fresh.columns if name in labelled.columns]
    reused = reservation_prices(labelled.select(*current).join(scores, ["symbol", "date"]), config)
    return fresh.unionByName(reused.select(*fresh.columns))


def reservation_prices(scored: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """Price to accept today: prior close times the predicted ratio plus a buffer."""
    price = (
        F.col("previous_adjusted_close") * F.exp("predicted_remaining_log_ratio")
        * F.lit(1.0 + config.reservation_buffer)
    )
    priced = scored.withColumn("reservation_adjusted", price)
    if "adjustment_factor" in scored.columns:
        priced = priced.withColumn("reservation_raw", F.col("reservation_adjusted") / F.col("adjustment_factor"))
    return priced


def fold_preparation(
    labelled: DataFrame, config: ModelConfig = ModelConfig(), features: Sequence[str] = FEATURE_SETS["all"],
) -> DataFrame:
    """Fill values and scales that each fold's classifier uses, per feature.

    One pass per symbol and feature: a month is merged into the state of the months before it, so the values
    of a fold are not read again by the next. A group holds one number per trading date.
    """
    names = list(features)
    long = labelled.select("symbol", "month", *[F.col(name).cast("double").alias(name) for name in names]).unpivot(
        ["symbol", "month"], names, "feature", "value")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, out = Expanding(), []
        for at, (month, some) in enumerate(rows.groupby("month", sort=True)):
            if at >= config.initial_months:
                mean, spread = state.moments()
                out.append((key[0], month, key[1], state.fill(), state.missing > 0, mean, spread))
            state.merge(Expanding(some["value"].to_numpy()))
        return pd.DataFrame(out, columns=["symbol", "test_month", "feature", "fill", "has_gaps", "mean", "spread"])

    return long.groupBy("symbol", "feature").applyInPandas(
        run, "symbol string, test_month string, feature string, fill double, has_gaps boolean, mean double, spread double")
