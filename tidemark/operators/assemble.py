"""Landed source tables to one validated daily table per symbol and date."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.windows import spread_by_symbol
from tidemark.operators import adjust as A
from tidemark.operators.quality import KEY, cross_source_report, not_one_to_one, require

FLOWS = ("institutional_net", "foreign_net", "trust_net", "dealer_net")
LOCAL_SOURCE = "YUANTA_ETF_NAV_HISTORY"
EXCHANGE_SOURCE = "TWSE_STOCK_DAY_AVG"
US_SOURCE = "FinMind USStockPrice"


def official_from_issuer(nav: DataFrame) -> DataFrame:
    """Stand in for the exchange close when no exchange files landed."""
    return nav.select(*KEY, F.col("issuer_market_price").alias("official_close"))


def join_sources(
    prices: DataFrame, dividends: DataFrame, splits: DataFrame, nav: DataFrame,
    margin: DataFrame, institutions: DataFrame, official: DataFrame,
) -> DataFrame:
    """Left joins on (symbol, date): one exchange per side, shared by the whole chain."""
    joined = A.attach_events(prices, dividends, splits)
    for side in (nav, margin, institutions, official):
        joined = joined.join(side, list(KEY), "left")
    return joined.withColumns({
        "close_difference": F.col("close") - F.col("official_close"),
        "institutional_available": F.col("institutional_net").isNotNull(),
    }).withColumns({name: F.coalesce(name, F.lit(0.0)) for name in FLOWS})


def assemble_daily(
    prices: DataFrame, dividends: DataFrame, splits: DataFrame, nav: DataFrame,
    margin: DataFrame, institutions: DataFrame, official: DataFrame,
    official_source: str = LOCAL_SOURCE,
) -> DataFrame:
    """Joins first (by symbol and date), then every window (by symbol): two exchanges deep."""
    joined = join_sources(prices, dividends, splits, nav, margin, institutions, official)
    return A.adjust(A.distribution_yield(joined, dividends, splits)).withColumns({
        "feature_available_date": A.next_trading_date(),
        "official_close_source": F.lit(official_source),
    })


def check_daily(daily: DataFrame, *sides: DataFrame) -> None:
    """Stop on keys that are not one to one or on prices that disagree between sources."""
    for side in sides:
        require(not_one_to_one(daily, side), "join is not one to one")
    require(cross_source_report(daily).where("NOT passed"), "sources disagree")


def assemble_us_daily(prices: DataFrame) -> DataFrame:
    """Daily table of a market that has only vendor prices: placeholders elsewhere."""
    with_actions = A.infer_us_actions(A.vendor_adjusted(spread_by_symbol(prices)))
    table = A.trailing_yield(A.split_adjusted(with_actions), "cash_dividend", "split_ratio")
    return table.withColumns({
        "trading_value": F.col("volume") * F.col("close"),
        "nav": F.col("close"),
        "issuer_market_price": F.col("close"),
        "official_close": F.col("close"),
        "official_close_source": F.lit(US_SOURCE),
        "institutional_available": F.lit(False),
        "outstanding_units": F.lit(1.0),
        "feature_available_date": A.next_trading_date(),
        **{name: F.lit(0.0) for name in ("close_difference", "margin_balance", "short_balance", *FLOWS)},
    })
