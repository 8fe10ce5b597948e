"""Vendor payloads (JSON text keyed by symbol) to the fixed source tables.

A payload is one API response: a month or a range of one instrument. All vendor fields
are read as text and cast leniently, then checked; a bad payload or value fails the job
at the row where it is, without an extra pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.config import INSTITUTION_NAMES
from tidemark.functions.scalars import guard, number, plain_number, positive, roc_date
from tidemark.operators.quality import KEY, duplicate_keys, ohlc_ordered, require

# ---------------------------------------------------------------- fixed values
# Field names and markers of the vendors' responses.
PRICE_FIELDS = {
    "open": "open", "max": "high", "min": "low", "close": "close", "Trading_Volume": "volume",
    "Trading_money": "trading_value", "spread": "price_change", "Trading_turnover": "transactions",
}
US_FIELDS = {
    "Open": "open", "High": "high", "Low": "low", "Close": "close",
    "Adj_Close": "adj_close", "Volume": "volume",
}
MARGIN_FIELDS = {
    "MarginPurchaseTodayBalance": "margin_balance", "ShortSaleTodayBalance": "short_balance",
}
NAV_FIELDS = {
    "NOW_NAV": "nav", "NOW_PRICE": "issuer_market_price", "FUND_SIZE": "fund_size",
    "OS_UNIT": "outstanding_units",
}
CASH_MARK, SPLIT_MARK, AVERAGE_MARK = "息", "分割", "月平均"
SPLIT_SNAP = 0.02
# ------------------------------------------------------------- end fixed values


def place(frame: DataFrame, position: Column | None = None) -> Column:
    """Where a payload, or a row of it, came from: its file if known, else its symbol, and the row's number."""
    own = F.concat(F.lit("payload of "), F.coalesce("symbol", F.lit("?")))
    source = F.coalesce("file", own) if "file" in frame.columns else own
    return source if position is None else F.concat(source, F.lit(" row "), position.cast("string"))


def _rows(parsed: DataFrame, whole: Column, data: Column, message: str) -> DataFrame:
    """(symbol, _at, r): the rows of whole payloads, each with its place; any other payload fails with its own."""
    return parsed.select("symbol", place(parsed).alias("_file"), F.posexplode(guard(whole, data, message, place(parsed))).alias("_n", "r")).select(
        "symbol", F.concat("_file", F.lit(" row "), (F.col("_n") + 1).cast("string")).alias("_at"), "r")


def _evidence(rows: DataFrame, *raw: str) -> list[Column]:
    """The place of a row, where it is known, and the texts that were refused."""
    at = [F.col("_at")] if "_at" in rows.columns else []
    return [*at, *[F.concat(F.lit(f"{name}="), F.coalesce(F.col(name).cast("string"), F.lit("null"))) for name in raw]]


def open_envelope(payloads: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows of ``{status, msg, data: [{...}]}`` payloads, with their place ``_at``; a status other than 200 fails.

    Errors here and in the parsers name the file (or the symbol, where no file is known) and the row.
    """
    row = ", ".join(f"`{name}`: string" for name in fields)
    parsed = payloads.withColumn(
        "_p", F.from_json("payload", f"status int, msg string, data array<struct<{row}>>"))
    whole = (F.col("_p.status") == 200) & F.col("_p.data").isNotNull() & ~F.exists(
        "_p.data", lambda item: item.isNull())
    return _rows(parsed, whole, F.col("_p.data"), "payload refused: status, msg or data").select("symbol", "_at", "r.*")


def _date(name: str = "date") -> Column:
    return F.to_date(F.substring(name, 1, 10)).alias("date")


def _numeric(rows: DataFrame, fields: Mapping[str, str], source: str) -> list[Column]:
    """Renamed double columns; a missing or unreadable number fails."""
    return [
        guard(number(raw).isNotNull(), number(raw), f"{source}: invalid number in {raw}", *_evidence(rows, raw)).alias(name)
        for raw, name in fields.items()
    ]


def parse_prices(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", _date(), *_numeric(rows, PRICE_FIELDS, "prices"))


def parse_dividends(rows: DataFrame) -> DataFrame:
    """Rows of a cash kind with a positive amount."""
    amount = number("stock_and_cache_dividend")
    return rows.where(F.col("stock_or_cache_dividend").contains(CASH_MARK) & (amount > 0)).select(
        "symbol", _date(), amount.alias("cash_dividend"))


def parse_splits(rows: DataFrame) -> DataFrame:
    """Price before over price after, snapped to the next whole number when close to it."""
    raw = F.try_divide(number("before_price"), number("after_price"))
    snapped = F.when(F.abs(raw - F.rint(raw)) <= SPLIT_SNAP, F.rint(raw)).otherwise(raw)
    return rows.where(F.col("type").contains(SPLIT_MARK)).select(
        "symbol", _date(), guard(snapped > 0, snapped, "invalid split ratio", *_evidence(rows, "before_price", "after_price")).alias("split_ratio"))


def parse_margin(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", _date(), *_numeric(rows, MARGIN_FIELDS, "margin"))


def parse_institutions(rows: DataFrame) -> DataFrame:
    """Net buying per investor class; unknown classes fail, one known class stays uncounted."""
    buy, sell = number("buy"), number("sell")
    known = F.col("name").isin(*INSTITUTION_NAMES) & buy.isNotNull() & sell.isNotNull()
    net = rows.select("symbol", _date(), "name", guard(
        known, buy - sell, "unknown class or bad number", *_evidence(rows, "name", "buy", "sell")).alias("net"))

    def total(*names: str) -> Column:
        return F.sum(F.when(F.col("name").isin(*names), F.col("net")).otherwise(0.0))

    foreign, trust, dealers = ("Foreign_Investor",), ("Investment_Trust",), (
        "Dealer", "Dealer_self", "Dealer_Hedging")
    return net.groupBy(*KEY).agg(
        total(*foreign, *trust, *dealers).alias("institutional_net"),
        total(*foreign).alias("foreign_net"), total(*trust).alias("trust_net"),
        total(*dealers).alias("dealer_net"))


def parse_monthly_closes(payloads: DataFrame) -> DataFrame:
    """Exchange month files ``{stat, data: [[date, close], ...]}`` without their average row."""
    parsed = payloads.withColumn("_p", F.from_json("payload", "stat string, data array<array<string>>"))
    whole = (F.col("_p.stat") == "OK") & F.col("_p.data").isNotNull()
    rows = _rows(parsed, whole, F.col("_p.data"), "month file refused").where((F.size("r") >= 2) & ~F.get("r", F.lit(0)).contains(AVERAGE_MARK))
    return rows.select(
        "symbol", roc_date(F.get("r", F.lit(0))).alias("date"),
        plain_number(F.get("r", F.lit(1))).alias("official_close"))


def parse_nav(payloads: DataFrame) -> DataFrame:
    """Issuer history ``{ResultCode, ResultMsg, Data: [...]}``; non-positive values drop out."""
    row = ", ".join(f"`{name}`: string" for name in ("UPDATE_T", *NAV_FIELDS))
    parsed = payloads.withColumn(
        "_p", F.from_json("payload", f"ResultCode int, ResultMsg string, Data array<struct<{row}>>"))
    whole = (F.col("_p.ResultCode") == 0) & F.col("_p.Data").isNotNull()
    rows = _rows(parsed, whole, F.col("_p.Data"), "NAV payload refused").select("symbol", "_at", "r.*")
    return rows.select("symbol", _date("UPDATE_T"), *_numeric(rows, NAV_FIELDS, "nav")).where(
        "nav > 0 AND issuer_market_price > 0")


def parse_us_prices(rows: DataFrame) -> DataFrame:
    price = number("Adj_Close")
    return rows.select("symbol", _date(), guard(
        price > 0, price, "invalid adjusted close", *_evidence(rows, "Adj_Close")).alias("adj_close"))


def parse_us_ohlc(rows: DataFrame) -> DataFrame:
    """Vendor bars; prices must be positive and ordered, volume not negative."""
    bars = rows.select("symbol", _date(), *_numeric(rows, US_FIELDS, "US prices"))
    sane = positive("open", "high", "low", "close", "adj_close") & (F.col("volume") >= 0) & ohlc_ordered()
    return bars.withColumn("adj_close", guard(sane, F.col("adj_close"), "US prices: invalid bar"))


def parse_usd_twd(rows: DataFrame) -> DataFrame:
    """Spot mid rate; quotes that are no positive numbers on both sides drop out."""
    buy, sell = number("spot_buy"), number("spot_sell")
    return rows.where((buy > 0) & (sell > 0)).select(_date(), ((buy + sell) / 2.0).alias("usd_twd"))


def require_rows(df: DataFrame, key: Sequence[str] = KEY, source: str = "source") -> DataFrame:
    """Stop when a parsed source is empty or repeats a key; gives the source back."""
    if df.isEmpty():
        raise ValueError(f"{source}: nothing left after parsing")
    require(duplicate_keys(df, key), f"{source}: repeated key")
    return df


def official_closes(payloads: DataFrame, start: str, end: str) -> DataFrame:
    """All month files of the range as one table."""
    return parse_monthly_closes(payloads).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
