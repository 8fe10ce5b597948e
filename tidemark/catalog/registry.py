"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.catalog.sqltext import STEP, settled, with_stages
from tidemark.catalog.stages import Stages
from tidemark.session import ship_package

WIDE_TICKS = ("l_returnflag || l_linestatus", "'S' || CAST(l_suppkey AS VARCHAR)")


@dataclass(frozen=True)
class Case:
    name: str
    build: Callable[[Stages], DataFrame]
    sql: str | None
    symbols: str

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return self.build(Stages(spark, folder, self.symbols))


CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None, symbols: str = "flag", **stages: str):
    """Register a query; ``sql`` names the stages it reads, ``stages`` adds or replaces some."""
    def add(build: Callable[[Stages], DataFrame]) -> Callable[[Stages], DataFrame]:
        text = None if sql is None else settled(with_stages(sql, **stages))
        if text is not None and symbols == "supplier":
            text = text.replace(*WIDE_TICKS)
        if name in CASES:
            raise ValueError(f"{name} is registered twice")
        CASES[name] = Case(name, build, text, symbols)
        return build

    return add


def rounded(value: Column, digits: int) -> Column:
    """The Spark form of what ``sqltext.settled`` writes for SQL."""
    scale = float(f"1e{digits}")
    return F.floor(value * scale + STEP).cast("double") / scale


def tidy(df: DataFrame, exact: Iterable[str] = (), digits: int = 6) -> DataFrame:
    """Round doubles for comparison (sums depend on order); ``exact`` columns stay as they are."""
    keep = set(exact)
    return df.select(*[
        rounded(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) and f.name not in keep else F.col(f.name)
        for f in df.schema.fields
    ])


def columns(df: DataFrame, names: str, exact: str = "", digits: int = 6) -> DataFrame:
    """The named columns, doubles rounded but for the ``exact`` ones, which come last."""
    split = [name.strip() for name in names.split(",")]
    more = [name.strip() for name in exact.split(",") if name.strip()]
    return tidy(df.select(*split, *more), more, digits)
