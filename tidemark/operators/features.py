"""Daily features known before the open: every end-of-day value comes from earlier rows.

All frames end at the previous row, so the one-row lag is part of the window itself and
one exchange and one sort by (symbol, date) serve the whole table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalars import month_of, month_progress, ratio, weekday_angle
from tidemark.functions.windows import by_date, in_month, known_by, running_product, trailing
from tidemark.operators.adjust import last_365_days
from tidemark.operators.quality import require_columns

RETURN_SPANS = (1, 5, 20, 60)
BALANCES = ("margin_balance", "short_balance", "outstanding_units")
TRADING_DAYS_A_YEAR = 252.0


REQUIRED = (
    "date", "open", "high", "low", "close", "volume", "trading_value", "total_return_index", "nav",
    "cash_dividend", "margin_balance", "short_balance", "institutional_net", "outstanding_units",
)


def lagged(value: Column | str, rows: int = 1) -> Column:
    return F.lag(value, rows).over(by_date())


def _per_row(columns: list[str]) -> dict[str, Column]:
    """First pass: yesterday's index and the split units since the start."""
    units = (
        running_product(F.coalesce("split_ratio", F.lit(1.0)))
        if "split_ratio" in columns else F.lit(1.0)
    )
    return {"_units": units, "_x1": lagged("total_return_index")}


def _series() -> dict[str, Column]:
    """Plain columns that the trailing frames read."""
    change = F.col("total_return_index") - F.col("_x1")
    return {
        "_gain": F.greatest(change, F.lit(0.0)),
        "_loss": F.greatest(-change, F.lit(0.0)),
        "_change": change,
        "_return": ratio(F.col("total_return_index"), F.col("_x1")) - 1.0,
        "_volume": F.col("volume") / F.col("_units"),
        **{f"_{name}": F.col(name) / F.col("_units") for name in BALANCES},
        "_premium": ratio(F.col("close"), F.col("nav")) - 1.0,
        "_net": ratio(F.col("institutional_net"), F.col("volume")),
    }


def _frames(columns: list[str]) -> dict[str, Column]:
    """Second pass: every window value the features need, each stated once.

    All share one partitioning and order, so Spark runs them in one window operator.
    """
    index, volume, returns = map(F.col, ("total_return_index", "_volume", "_return"))
    available = (
        F.col("institutional_available") if "institutional_available" in columns else F.lit(True)
    )
    month, quarter, fortnight = trailing(20), trailing(60), trailing(14)
    out = {f"_x{n + 1}": lagged(index, n + 1) for n in RETURN_SPANS}
    out |= {
        "_n60": F.count(index).over(quarter), "_mean60": F.avg(index).over(quarter),
        "_max60": F.max(index).over(quarter),
        "_n20": F.count(index).over(month), "_mean20": F.avg(index).over(month),
        "_std20": F.stddev_pop(index).over(month),
        "_rn20": F.count(returns).over(month), "_rstd20": F.stddev_pop(returns).over(month),
        "_vn20": F.count(volume).over(month), "_vmean20": F.avg(volume).over(month),
        "_vstd20": F.stddev_pop(volume).over(month), "_v1": lagged(volume),
        "_n14": F.count("_change").over(fortnight), "_gain14": F.avg("_gain").over(fortnight),
        "_loss14": F.avg("_loss").over(fortnight),
        "_premium1": lagged("_premium"), "_yield1": lagged("_yield"), "_net1": lagged("_net"),
        "_available1": lagged(available.cast("double")),
    }
    for name in BALANCES:
        for ago in (1, 6):
            out[f"_{name}{ago}"] = F.last(f"_{name}", ignorenulls=True).over(known_by(ago))
    return out


def full(value: Column, count: str, rows: int) -> Column:
    """``value`` of a trailing frame, NULL unless the frame held ``rows`` known values."""
    return F.when(F.col(count) == rows, value)


def technical() -> dict[str, Column]:
    x1 = F.col("_x1")
    gain, loss = full(F.col("_gain14"), "_n14", 14), full(F.col("_loss14"), "_n14", 14)
    return {
        **{f"ret_{n}": ratio(x1, F.col(f"_x{n + 1}")) - 1.0 for n in RETURN_SPANS},
        **{f"ma_gap_{n}": ratio(x1, full(F.col(f"_mean{n}"), f"_n{n}", n)) - 1.0 for n in (20, 60)},
        # Simple means of gains and losses; no losses at all give 100, no moves 50.
        "rsi_14": F.when((loss == 0) & (gain > 0), 100.0).when((loss == 0) & (gain == 0), 50.0)
        .otherwise(100.0 - 100.0 / (1.0 + ratio(gain, loss))),
        "bollinger_z_20": full(ratio(x1 - F.col("_mean20"), F.col("_std20")), "_n20", 20),
        "drawdown_60": ratio(x1, full(F.col("_max60"), "_n60", 60)) - 1.0,
        "volatility_20": full(F.col("_rstd20"), "_rn20", 20) * math.sqrt(TRADING_DAYS_A_YEAR),
        "volume_z_20": full(ratio(F.col("_v1") - F.col("_vmean20"), F.col("_vstd20")), "_vn20", 20),
    }


def valuation() -> dict[str, Column]:
    return {"premium_discount": F.col("_premium1"), "dividend_yield_ttm": F.col("_yield1")}


def chip() -> dict[str, Column]:
    """Balances change over five rows in today's units, gaps padded with the last value."""
    changes = {name: ratio(F.col(f"_{name}1"), F.col(f"_{name}6")) - 1.0 for name in BALANCES}
    return {
        "margin_change_5": changes["margin_balance"],
        "short_change_5": changes["short_balance"],
        "institutional_net_ratio": F.col("_net1"),
        "institutional_data_available": F.col("_available1"),
        "fund_flow_5": changes["outstanding_units"],
    }


def calendar() -> dict[str, Column]:
    """Known in advance, so not lagged. Needs the ``month`` helper column."""
    return {
        "trading_day": F.row_number().over(in_month()),
        "month_progress": month_progress("date"),
        "weekday_sin": F.sin(weekday_angle("date")),
        "weekday_cos": F.cos(weekday_angle("date")),
    }


def build_features(daily: DataFrame) -> DataFrame:
    """The daily table plus the 22 feature columns."""
    columns = daily.columns
    require_columns(daily, ("symbol", *REQUIRED), "daily table", non_empty=False)
    cash_yield = (
        F.col("distribution_yield_ttm") if "distribution_yield_ttm" in columns
        else ratio(last_365_days("cash_dividend"), F.col("close"))
    )
    framed = (
        daily.withColumns({**_per_row(columns), "_yield": cash_yield})
        .withColumns(_series()).withColumns(_frames(columns))
        .withColumns({**technical(), **valuation(), **chip()})
    )
    helpers = [name for name in framed.columns if name.startswith("_")]
    return (
        framed.drop(*helpers).withColumn("month", month_of("date"))
        .withColumns(calendar()).drop("month")
    )
