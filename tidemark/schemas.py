"""Fixed schemas of the tables that the operators take and give."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "s": T.StringType(), "d": T.DateType(), "f": T.DoubleType(),
    "b": T.BooleanType(), "i": T.IntegerType(), "l": T.LongType(),
}


def table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


KEY = {"symbol": "s", "date": "d"}
PRICES = table(**KEY, open="f", high="f", low="f", close="f", volume="f", trading_value="f",
               price_change="f", transactions="f")
DIVIDENDS = table(**KEY, cash_dividend="f")
SPLITS = table(**KEY, split_ratio="f")
NAV = table(**KEY, nav="f", issuer_market_price="f", fund_size="f", outstanding_units="f")
MARGIN = table(**KEY, margin_balance="f", short_balance="f")
INSTITUTIONS = table(**KEY, institutional_net="f", foreign_net="f", trust_net="f", dealer_net="f")
OFFICIAL = table(**KEY, official_close="f")
US_OHLC = table(**KEY, open="f", high="f", low="f", close="f", adj_close="f", volume="f")
LEAD_PRICE = table(date="d", adj_close="f")
FX = table(date="d", usd_twd="f")
MONTHLY_ORACLE = table(symbol="s", month="s", oracle_date="d", oracle_open="f",
                       oracle_adjusted_open="f", oracle_trading_day="i", days_in_month="i")
DAILY = table(
    **KEY, open="f", high="f", low="f", close="f", volume="f", trading_value="f",
    price_change="f", transactions="f", cash_dividend="f", split_ratio="f", gross_return="f",
    total_return_index="f", adjusted_close="f", adjustment_factor="f", adjusted_open="f",
    adjusted_high="f", adjusted_low="f", split_adjusted_open="f", split_adjusted_high="f",
    split_adjusted_low="f", split_adjusted_close="f", nav="f", issuer_market_price="f",
    fund_size="f", outstanding_units="f", margin_balance="f", short_balance="f",
    institutional_net="f", foreign_net="f", trust_net="f", dealer_net="f",
    official_close="f", close_difference="f", institutional_available="b",
    distribution_yield_ttm="f", feature_available_date="d", official_close_source="s",
)
