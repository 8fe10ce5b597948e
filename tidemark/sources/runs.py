"""Result folders that stand or fall as a whole.

Every run writes its tables to a folder of its own and is published by one row file appended to the
folder's manifest, last of all. Readers go by the manifest alone: a run that was lost midway is never
seen, and the tables of the last complete run stay as they were.

    <folder>/manifest/*.json     a line per table: run, name, path, schema, rows
    <folder>/runs/<run>/<name>   the tables
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tidemark.operators.quality import DataQualityError
from tidemark.session import children, delete

MANIFEST = "run string, name string, path string, format string, schema string, rows long"


def publish(tables: Mapping[str, DataFrame], folder: str, lines: Mapping[str, DataFrame] | None = None) -> str:
    """Write all ``tables`` (those of ``lines`` as JSON lines), then the manifest; gives the run's name.

    Names must differ. Row counts are observed while the tables are written. An error on the way leaves the folder's
    published state untouched.
    """
    frames = [(name, table, "parquet") for name, table in tables.items()]
    frames += [(name, table, "json") for name, table in (lines or {}).items()]
    if not frames or len({name for name, *_ in frames}) < len(frames):
        raise ValueError("a run needs tables of different names")
    spark = frames[0][1].sparkSession
    root = folder.rstrip("/")
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows = []
    for name, table, kind in frames:
        path, observation = f"runs/{run}/{name}", Observation()
        table.observe(observation, F.count(F.lit(1)).alias("rows")).write.format(kind).save(f"{root}/{path}")
        rows.append((run, name, path, kind, table.schema.json(), observation.get["rows"]))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return run


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row for every table of every published run."""
    if not children(spark, f"{folder.rstrip('/')}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{folder.rstrip('/')}/manifest")


def latest(spark: SparkSession, folder: str, run: str | None = None) -> dict[str, DataFrame]:
    """The tables of the last published run, or of ``run``."""
    listed = manifest(spark, folder)
    wanted = run or listed.agg(F.max("run")).first()[0]
    rows = [] if wanted is None else listed.where(F.col("run") == wanted).collect()  # a row per table
    if not rows:
        raise DataQualityError(f"{folder}: no published run")

    def table(row) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(row["schema"]))
        return spark.read.schema(schema).format(row["format"]).load(f"{folder.rstrip('/')}/{row['path']}")

    return {row["name"]: table(row) for row in rows}


def prune(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Delete older runs than the ``keep`` last published ones, unpublished older ones too; gives their names.

    Runs younger than the last published one may still be on their way and stay.
    """
    root = folder.rstrip("/")
    published = sorted(row["run"] for row in manifest(spark, folder).select("run").distinct().collect())
    if not published:
        return []
    stay = set(published[-keep:])
    gone = [run for run in children(spark, f"{root}/runs") if run < published[-1] and run not in stay]
    for run in gone:
        delete(spark, f"{root}/runs/{run}")
    return sorted(gone)
