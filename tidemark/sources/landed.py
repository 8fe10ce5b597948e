"""Readers of landed files and writers of result tables.

Layout of landed payloads: ``<root>/<source>/symbol=<code>/*.json``, one response per
file. Tables are Parquet or CSV (with header, a byte-order mark is accepted).
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark import schemas
from tidemark.operators.quality import duplicate_keys, require_columns, require
from tidemark.session import children
from tidemark.sources import runs

LEAD_FILES = {"tsm": "tsm_us.csv", "sox": "sox_us.csv", "fx": "usd_twd.csv"}


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, payload, file): each file is one response; the symbol comes from its folder."""
    return spark.read.text(path, wholetext=True).select(
        F.col("symbol").cast("string").alias("symbol"), F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file"))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of fixed schema from CSV or Parquet; NaN becomes NULL."""
    if path.endswith(".csv") or path.endswith("_csv"):
        raw = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    else:
        raw = spark.read.schema(schema).parquet(path)
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    return raw.withColumns({name: F.nanvl(name, F.lit(None).cast("double")) for name in doubles})


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """A daily table from a file or from a folder of published runs."""
    if children(spark, f"{path.rstrip('/')}/manifest"):
        return runs.latest(spark, path)["daily"]
    return read_table(spark, path, schemas.DAILY)


def load_leads(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three lead tables; a missing file or column stops here."""
    out = {}
    for name, filename in LEAD_FILES.items():
        schema = schemas.FX if name == "fx" else schemas.LEAD_PRICE
        path = f"{folder.rstrip('/')}/{filename}"
        header = spark.read.option("header", True).csv(path)
        require_columns(header, schema.fieldNames(), filename)
        chosen = header.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        require(duplicate_keys(chosen, ("date",)), f"{filename}: repeated date")
        out[name] = chosen
    return out


def write_raw(frames: Mapping[str, DataFrame], folder: str) -> None:
    """One Parquet table per source."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def write_by_symbol(df: DataFrame, path: str) -> None:
    """Partitioned by symbol: rows of one symbol go to one writer, so files stay few."""
    df.repartition("symbol").write.mode("overwrite").partitionBy("symbol").parquet(path)


def read_by_symbol(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_bucketed(df: DataFrame, path: str, buckets: int = 256) -> DataFrame:
    """One table for all symbols in ``buckets`` files, dealt by symbol and ordered by symbol and date.

    What groups, windows or joins by symbol over the table that ``read_bucketed`` gives needs no exchange.
    """
    spark, name = df.sparkSession, f"tidemark_{uuid.uuid4().hex}"
    (df.repartition(buckets, "symbol").write.bucketBy(buckets, "symbol").sortBy("symbol", "date")
     .format("parquet").option("path", path).saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # the files stay; sessions name them anew
    return read_bucketed(spark, path, df.schema, buckets)


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType, buckets: int = 256) -> DataFrame:
    """The table of ``write_bucketed``; ``schema`` and ``buckets`` must be those it was written with."""
    name = f"tidemark_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (symbol) SORTED BY (symbol, date) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_results(tables: Mapping[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Features, labelled, oracle, profile, predictions, purchases and metric tables, as one published run."""
    run = runs.publish(tables, folder)
    return runs.latest(next(iter(tables.values())).sparkSession, folder, run)


def write_json(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
