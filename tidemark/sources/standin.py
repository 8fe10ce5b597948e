"""A market read from the given order tables, so that every operator has real input.

Line items play ticks: one bar per symbol and ship date. ``symbols="flag"`` gives six
deep symbols, ``symbols="supplier"`` as many symbols as there are suppliers, so that the
daily tables grow with the data. Ticks are combined by hash aggregation on plain
numbers; a hot symbol or date is folded map-side before it is shuffled.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.scalars import month_of
from tidemark.functions.windows import so_far
from tidemark.operators.quality import KEY
from tidemark.session import written

SPLIT_DATES = {"1998-06-01": 2.0, "2000-03-01": 4.0}
FIRST_MONTH = "1995-02"
HOLDOUT = ("2000-07", "2001-10")
DEVELOPMENT_START = "2000-02"
INITIAL_MONTHS = 60
NAMES = {
    "1-URGENT": "Foreign_Investor", "2-HIGH": "Investment_Trust", "3-MEDIUM": "Dealer",
    "4-NOT SPECIFIED": "Dealer_self", "5-LOW": "Foreign_Dealer_Self",
}
#: Orders of these priorities play the two lead series and the currency.
OUTSIDE = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


class Market:
    """Source tables of the stand-in market; lazy but for ``landed``, which writes the day facts."""

    def __init__(self, spark: SparkSession, folder: str, symbols: str = "flag") -> None:
        self.spark, self.folder, self.symbols = spark, folder.rstrip("/"), symbols

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        line = self.table("lineitem")
        symbol = (
            F.concat("l_returnflag", "l_linestatus") if self.symbols == "flag"
            else F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
        )
        date = F.col("l_shipdate").cast("date")
        first, second = map(_day, SPLIT_DATES)
        units = F.when(date < first, 1.0).when(date < second, 2.0).otherwise(8.0)
        level = F.lit(100.0) + F.col("l_extendedprice") / 10000.0 + F.datediff(date, _day("1995-01-01")) / 500.0
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        return line.select(
            symbol.alias("symbol"), date.alias("date"), units.alias("units"),
            (level / units).alias("price"), (F.col("l_quantity") * units).alias("quantity"),
            # Order of ticks in one number: order key, then price in cents (below 2^24).
            F.when(cents.between(0, 16777215), F.col("l_orderkey") * 16777216 + cents).otherwise(
                F.raise_error(F.lit("a price does not fit the tick order")).cast("long")).alias("seq"),
            "l_tax", "l_discount", "l_orderkey", F.col("l_quantity").alias("raw_quantity"),
        )

    @cached_property
    def days(self) -> DataFrame:
        """Everything the line items say about one symbol and date, in one aggregation."""
        on_margin = F.col("l_discount") >= 0.05
        return self.ticks.groupBy(*KEY).agg(
            F.min_by("price", "seq").alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
            F.sum("quantity").alias("volume"),
            F.sum(F.col("quantity") * F.col("price")).alias("trading_value"),
            F.count(F.lit(1)).cast("double").alias("transactions"),
            (F.lit(10.0) * F.avg("l_tax") / F.max("units")).alias("cash"),
            F.sum(F.when(on_margin, F.col("quantity"))).alias("margin_balance"),
            (F.count_if(F.col("l_discount") < 0.02) * F.max("units")).alias("short_balance"),
        )

    @cached_property
    def landed(self) -> "Market":
        """The same market with its day facts written once.

        For jobs that read several source tables: they share one scan of the ticks, and
        the planner knows the real size of what it joins.
        """
        copy = type(self)(self.spark, self.folder, self.symbols)
        copy.__dict__["days"] = written(self.days, "days")
        return copy

    @cached_property
    def prices(self) -> DataFrame:
        return self.days.select(
            *KEY, "open", "high", "low", "close", "volume", "trading_value",
            (F.col("close") - F.col("open")).alias("price_change"), "transactions")

    @cached_property
    def dividends(self) -> DataFrame:
        quarter_end = self.days.where(F.month("date").isin(3, 6, 9, 12))
        firsts = quarter_end.groupBy("symbol", month_of("date").alias("month")).agg(
            F.min("date").alias("date"), F.min_by("cash", "date").alias("cash_dividend"))
        return firsts.where("cash_dividend > 0").select(*KEY, "cash_dividend")

    @cached_property
    def splits(self) -> DataFrame:
        firsts = self.days.groupBy("symbol").agg(*[
            F.min(F.when(F.col("date") >= _day(start), F.col("date"))).alias(start) for start in SPLIT_DATES])
        pairs = F.array(*[
            F.struct(F.col(f"`{start}`").alias("date"), F.lit(ratio).alias("split_ratio"))
            for start, ratio in SPLIT_DATES.items()])
        return firsts.select("symbol", F.inline(pairs)).where("date IS NOT NULL")

    @cached_property
    def nav(self) -> DataFrame:
        return self.prices.select(
            *KEY, (F.col("trading_value") / F.col("volume")).alias("nav"),
            F.col("close").alias("issuer_market_price"), F.col("trading_value").alias("fund_size"),
            F.sum("volume").over(so_far()).alias("outstanding_units"))

    @cached_property
    def margin(self) -> DataFrame:
        return self.days.where("margin_balance IS NOT NULL").select(*KEY, "margin_balance", "short_balance")

    @cached_property
    def institutions_raw(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
        name = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[F.col("o_orderpriority")]
        filled = F.col("o_orderstatus") == "F"
        return (
            self.ticks.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(*KEY, name.alias("name"))
            .agg(F.sum(F.when(filled, F.col("raw_quantity")).otherwise(0.0)).alias("buy"),
                 F.sum(F.when(filled, F.lit(0.0)).otherwise(F.col("raw_quantity"))).alias("sell"))
        )

    @cached_property
    def official(self) -> DataFrame:
        return self.prices.select(*KEY, F.col("close").alias("official_close"))

    @cached_property
    def us_ohlc(self) -> DataFrame:
        date = F.col("date")
        first, second = map(_day, SPLIT_DATES)
        factor = (
            F.when(date < _day("1997-01-01"), 0.98 / 8.0).when(date < first, 1.0 / 8.0)
            .when(date < second, 1.0 / 4.0).otherwise(1.0)
        )
        return self.prices.select(
            *KEY, "open", "high", "low", "close", (F.col("close") * factor).alias("adj_close"), "volume")

    @cached_property
    def quotes(self) -> DataFrame:
        """Mean order value by day and priority: what the outside series are read from."""
        return self.table("orders").where(F.col("o_orderpriority").isin(*OUTSIDE)).groupBy(
            F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("priority")
        ).agg(F.avg("o_totalprice").alias("value"))

    def _by_priority(self, priority: str, name: str) -> DataFrame:
        return self.quotes.where(F.col("priority") == priority).select("date", F.col("value").alias(name))

    @cached_property
    def tsm(self) -> DataFrame:
        return self._by_priority(OUTSIDE[0], "adj_close")

    @cached_property
    def sox(self) -> DataFrame:
        return self._by_priority(OUTSIDE[1], "adj_close")

    @cached_property
    def fx(self) -> DataFrame:
        return self._by_priority(OUTSIDE[2], "usd_twd")
