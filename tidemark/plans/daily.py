"""Landed payload files to one checked, written daily table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import assemble, observed as O
from tidemark.session import scratch
from tidemark.sources import landed, parsers, runs

#: Sources in an envelope of rows: the fields asked for, and their parser.
ROWED = {
    "prices": (("date", *parsers.PRICE_FIELDS), parsers.parse_prices),
    "dividends": (("date", "stock_and_cache_dividend", "stock_or_cache_dividend"), parsers.parse_dividends),
    "splits": (("date", "type", "before_price", "after_price"), parsers.parse_splits),
    "margin": (("date", *parsers.MARGIN_FIELDS), parsers.parse_margin),
    "institutions": (("date", "name", "buy", "sell"), parsers.parse_institutions),
}
#: Corporate actions of one date add up or multiply, so only these sources must hold a date once.
ONE_TO_ONE = ("prices", "margin", "institutions", "nav", "official")
MAY_BE_EMPTY = ("dividends", "splits")


def parse_sources(payloads: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Every source parsed and written once; any bad or empty source stops the job.

    Empty tables and repeated keys are seen while a source is written: one job for each source.

    ``payloads`` holds (symbol, payload) per name of ``ROWED``, ``nav``, and ``official`` where
    exchange month files landed; without them the issuer's market price stands in.
    """
    tables = {name: parse(parsers.open_envelope(payloads[name], fields)) for name, (fields, parse) in ROWED.items()}
    tables["nav"] = parsers.parse_nav(payloads["nav"])
    if "official" in payloads:
        tables["official"] = parsers.parse_monthly_closes(payloads["official"])
    unruled = set(tables) - set(ONE_TO_ONE) - set(MAY_BE_EMPTY)
    if unruled:
        raise ValueError(f"no rule for {sorted(unruled)}")
    for name, table in tables.items():
        once = (O.unique(f"{name}: repeated key"),) if name in ONE_TO_ONE else ()
        empty = None if name in MAY_BE_EMPTY else f"{name}: nothing left after parsing"
        tables[name] = O.written_checked(table, f"source-{name}", *once, empty=empty)
    tables.setdefault("official", assemble.official_from_issuer(tables["nav"]))
    return tables


def daily_from_sources(
    tables: Mapping[str, DataFrame], official_source: str = assemble.LOCAL_SOURCE, path: str | None = None,
) -> DataFrame:
    """The written daily table; repeated keys or sources that disagree stop the job.

    The write itself observes both. A bad table is deleted again and never stands at ``path``.
    """
    order = ("prices", "dividends", "splits", "nav", "margin", "institutions", "official")
    daily = assemble.assemble_daily(*[tables[name] for name in order], official_source=official_source)
    return O.written_checked(daily, "daily", O.unique("daily: repeated key"), O.sources_agree(), path=path)


def daily_from_files(spark: SparkSession, root: str, out: str, with_exchange: bool = False) -> DataFrame:
    """``<root>/<source>/symbol=<code>/*.json`` to the daily table of the last run published at ``out``.

    One write for each source, one for the table; what only this job needs is deleted at its end.
    """
    names = (*ROWED, "nav", *(("official",) if with_exchange else ()))
    source = assemble.EXCHANGE_SOURCE if with_exchange else assemble.LOCAL_SOURCE
    with scratch(spark):
        tables = parse_sources({name: landed.read_payloads(spark, f"{root.rstrip('/')}/{name}") for name in names})
        runs.publish({"daily": daily_from_sources(tables, source)}, out)
    return runs.latest(spark, out)["daily"]
