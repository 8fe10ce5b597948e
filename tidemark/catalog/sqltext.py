"""SQL building blocks: the stand-in market and each stage, stated independently in SQL.

The text is for a single-node engine that checks results; where the Spark plan uses a
trick (range window, counting ranks, one-pass selection), the SQL states the plain
definition instead (range join, rank windows, first row per month).
"""

from __future__ import annotations

import re

from tidemark.config import ALL_FEATURES, END_OF_DAY

STAGES: dict[str, str] = {}

STAGES["ticks"] = """
SELECT l_returnflag || l_linestatus AS symbol, d AS date, f AS units,
       (100e0 + l_extendedprice / 10000e0 + (d - DATE '1995-01-01') / 500e0) / f AS price,
       l_quantity * f AS quantity, l_quantity AS raw_quantity,
       l_orderkey * 16777216 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq,
       l_tax, l_discount, l_orderkey
FROM (SELECT *, CAST(l_shipdate AS DATE) AS d,
             CASE WHEN CAST(l_shipdate AS DATE) < DATE '1998-06-01' THEN 1e0
                  WHEN CAST(l_shipdate AS DATE) < DATE '2000-03-01' THEN 2e0 ELSE 8e0 END AS f
      FROM lineitem)
"""
STAGES["prices"] = """
SELECT *, close - open AS price_change FROM (
  SELECT symbol, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(quantity) AS volume,
         sum(quantity * price) AS trading_value, CAST(count(*) AS DOUBLE) AS transactions
  FROM ticks GROUP BY symbol, date)
"""
STAGES["dividends"] = """
SELECT symbol, date, cash_dividend FROM (
  SELECT symbol, date, 10e0 * avg(l_tax) / max(units) AS cash_dividend,
         row_number() OVER (PARTITION BY symbol, strftime(date, '%Y-%m') ORDER BY date) AS rn
  FROM ticks WHERE month(date) IN (3, 6, 9, 12) GROUP BY symbol, date)
WHERE rn = 1 AND cash_dividend > 0
"""
STAGES["splits"] = """
SELECT symbol, min(date) AS date, 2e0 AS split_ratio FROM ticks
WHERE date >= DATE '1998-06-01' GROUP BY symbol
UNION ALL
SELECT symbol, min(date) AS date, 4e0 AS split_ratio FROM ticks
WHERE date >= DATE '2000-03-01' GROUP BY symbol
"""
STAGES["nav"] = """
SELECT symbol, date, trading_value / volume AS nav, close AS issuer_market_price,
       trading_value AS fund_size,
       sum(volume) OVER (PARTITION BY symbol ORDER BY date) AS outstanding_units
FROM prices
"""
STAGES["margin"] = """
SELECT symbol, date, sum(quantity) FILTER (l_discount >= 0.05e0) AS margin_balance,
       count(*) FILTER (l_discount < 0.02e0) * max(units) AS short_balance
FROM ticks GROUP BY symbol, date HAVING count(*) FILTER (l_discount >= 0.05e0) > 0
"""
STAGES["institutions_raw"] = """
SELECT symbol, date,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Foreign_Investor' WHEN '2-HIGH' THEN 'Investment_Trust'
            WHEN '3-MEDIUM' THEN 'Dealer' WHEN '4-NOT SPECIFIED' THEN 'Dealer_self'
            ELSE 'Foreign_Dealer_Self' END AS name,
       sum(CASE WHEN o_orderstatus = 'F' THEN raw_quantity ELSE 0e0 END) AS buy,
       sum(CASE WHEN o_orderstatus = 'F' THEN 0e0 ELSE raw_quantity END) AS sell
FROM ticks JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
"""
STAGES["institutions"] = """
SELECT symbol, date,
       sum(CASE WHEN name = 'Foreign_Dealer_Self' THEN 0e0 ELSE buy - sell END) AS institutional_net,
       sum(CASE WHEN name = 'Foreign_Investor' THEN buy - sell ELSE 0e0 END) AS foreign_net,
       sum(CASE WHEN name = 'Investment_Trust' THEN buy - sell ELSE 0e0 END) AS trust_net,
       sum(CASE WHEN name LIKE 'Dealer%' THEN buy - sell ELSE 0e0 END) AS dealer_net
FROM institutions_raw GROUP BY symbol, date
"""
STAGES["us_ohlc"] = """
SELECT symbol, date, open, high, low, close,
       close * CASE WHEN date < DATE '1997-01-01' THEN 0.98e0 / 8e0 WHEN date < DATE '1998-06-01' THEN 1e0 / 8e0
                    WHEN date < DATE '2000-03-01' THEN 1e0 / 4e0 ELSE 1e0 END AS adj_close, volume
FROM prices
"""
for _name, _priority, _value in (
    ("tsm", "1-URGENT", "adj_close"), ("sox", "2-HIGH", "adj_close"), ("fx", "3-MEDIUM", "usd_twd"),
):
    STAGES[_name] = f"""
SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS {_value} FROM orders
WHERE o_orderpriority = '{_priority}' GROUP BY 1
"""

STAGES["with_events"] = """
SELECT p.*, coalesce(d.cash, 0e0) AS cash_dividend, coalesce(s.ratio, 1e0) AS split_ratio
FROM prices p
LEFT JOIN (SELECT symbol, date, sum(cash_dividend) AS cash FROM dividends GROUP BY ALL) d USING (symbol, date)
LEFT JOIN (SELECT symbol, date, product(split_ratio) AS ratio FROM splits GROUP BY ALL) s USING (symbol, date)
"""
_SPLIT_ADJUSTED = ", ".join(
    f"{c} / coalesce(product(split_ratio) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING "
    f"AND UNBOUNDED FOLLOWING), 1e0) AS split_adjusted_{c}" for c in ("open", "high", "low", "close"))
STAGES["adjusted"] = f"""
SELECT *, open * adjustment_factor AS adjusted_open, high * adjustment_factor AS adjusted_high,
       low * adjustment_factor AS adjusted_low, {_SPLIT_ADJUSTED}
FROM (SELECT *, adjusted_close / close AS adjustment_factor
      FROM (SELECT a.*, e.last_close * a.total_return_index / e.last_index AS adjusted_close
            FROM indexed a JOIN (SELECT symbol, arg_max(close, date) AS last_close,
                                        arg_max(total_return_index, date) AS last_index
                                 FROM indexed GROUP BY symbol) e USING (symbol)))
"""
STAGES["indexed"] = """
SELECT *, 100e0 * product(gross_return) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)
         AS total_return_index
FROM (SELECT *, coalesce((close + cash_dividend) * split_ratio
                         / lag(close) OVER (PARTITION BY symbol ORDER BY date), 1e0) AS gross_return
      FROM with_events)
"""
STAGES["yields"] = """
SELECT p.symbol, p.date, coalesce(sum(e.cash), 0e0) / any_value(p.close) AS distribution_yield_ttm
FROM prices p LEFT JOIN (
  SELECT q.symbol, q.date, d.cash_dividend / coalesce(product(s.split_ratio), 1e0) AS cash
  FROM prices q JOIN dividends d
    ON d.symbol = q.symbol AND d.date <= q.date AND d.date > q.date - 365
  LEFT JOIN splits s ON s.symbol = q.symbol AND s.date > d.date AND s.date <= q.date
  GROUP BY q.symbol, q.date, d.date, d.cash_dividend) e USING (symbol, date)
GROUP BY p.symbol, p.date
"""
STAGES["daily"] = """
SELECT a.*, n.nav, n.issuer_market_price, n.fund_size, n.outstanding_units,
       m.margin_balance, m.short_balance,
       coalesce(i.institutional_net, 0e0) AS institutional_net, coalesce(i.foreign_net, 0e0) AS foreign_net,
       coalesce(i.trust_net, 0e0) AS trust_net, coalesce(i.dealer_net, 0e0) AS dealer_net,
       p.close AS official_close, a.close - p.close AS close_difference,
       i.institutional_net IS NOT NULL AS institutional_available,
       y.distribution_yield_ttm,
       lead(a.date) OVER (PARTITION BY a.symbol ORDER BY a.date) AS feature_available_date,
       'YUANTA_ETF_NAV_HISTORY' AS official_close_source
FROM adjusted a LEFT JOIN nav n USING (symbol, date) LEFT JOIN margin m USING (symbol, date)
LEFT JOIN institutions i USING (symbol, date) LEFT JOIN prices p USING (symbol, date)
LEFT JOIN yields y USING (symbol, date)
"""
STAGES["us_actions"] = """
SELECT * EXCLUDE (implied, prev_close),
       CASE WHEN implied > 1.002e0 AND implied < 1.4e0 THEN prev_close * (1e0 - 1e0 / implied) ELSE 0e0 END
         AS cash_dividend,
       CASE WHEN implied >= 1.4e0 THEN round_even(implied, 0) ELSE 1e0 END AS split_ratio
FROM (SELECT *, lag(close) OVER w AS prev_close,
             (adj_close / lag(adj_close) OVER w) / (close / lag(close) OVER w) AS implied
      FROM us_ohlc WINDOW w AS (PARTITION BY symbol ORDER BY date))
"""
STAGES["us_yields"] = """
SELECT p.symbol, p.date, coalesce(sum(e.cash), 0e0) / any_value(p.close) AS distribution_yield_ttm
FROM us_actions p LEFT JOIN (
  SELECT q.symbol, q.date, d.cash_dividend / coalesce(product(s.split_ratio), 1e0) AS cash
  FROM us_actions q JOIN (SELECT * FROM us_actions WHERE cash_dividend > 0) d
    ON d.symbol = q.symbol AND d.date <= q.date AND d.date > q.date - 365
  LEFT JOIN (SELECT * FROM us_actions WHERE split_ratio <> 1) s
    ON s.symbol = q.symbol AND s.date > d.date AND s.date <= q.date
  GROUP BY q.symbol, q.date, d.date, d.cash_dividend) e USING (symbol, date)
GROUP BY p.symbol, p.date
"""
STAGES["us_daily"] = f"""
SELECT a.*, adj_close / close AS adjustment_factor, open * (adj_close / close) AS adjusted_open,
       high * (adj_close / close) AS adjusted_high, low * (adj_close / close) AS adjusted_low,
       adj_close AS adjusted_close,
       100e0 * adj_close / first_value(adj_close) OVER w AS total_return_index,
       coalesce(adj_close / lag(adj_close) OVER w, 1e0) AS gross_return,
       {_SPLIT_ADJUSTED}, y.distribution_yield_ttm, volume * close AS trading_value,
       lead(date) OVER w AS feature_available_date
FROM us_actions a JOIN us_yields y USING (symbol, date)
WINDOW w AS (PARTITION BY symbol ORDER BY date)
"""

_W = "(PARTITION BY symbol ORDER BY date)"


def _roll(expression: str, rows: int, value: str) -> str:
    frame = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) OVER {frame} = {rows} THEN {expression} OVER {frame} END"


def _change(column: str, rows: int) -> str:
    return f"{column} / nullif(lag({column}, {rows}) OVER {_W}, 0) - 1"


def _zscore(column: str, rows: int) -> str:
    mean, spread = _roll(f"avg({column})", rows, column), _roll(f"stddev_pop({column})", rows, column)
    return f"({column} - {mean}) / nullif({spread}, 0)"


STAGES["eod_base"] = f"""
SELECT *, trx - lag(trx) OVER {_W} AS chg, trx / lag(trx) OVER {_W} - 1 AS ret, volume / units AS vol,
       last_value(margin_balance / units IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
         ROWS UNBOUNDED PRECEDING) AS mb,
       last_value(short_balance / units IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
         ROWS UNBOUNDED PRECEDING) AS sb,
       outstanding_units / units AS ou
FROM (SELECT *, total_return_index AS trx,
             product(split_ratio) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS units
      FROM daily)
"""
_EOD = {
    **{f"ret_{n}": _change("trx", n) for n in (1, 5, 20, 60)},
    **{f"ma_gap_{n}": f"trx / {_roll('avg(trx)', n, 'trx')} - 1" for n in (20, 60)},
    "gain": _roll("avg(greatest(chg, 0e0))", 14, "chg"),
    "loss": _roll("avg(greatest(-chg, 0e0))", 14, "chg"),
    "bollinger_z_20": _zscore("trx", 20),
    "drawdown_60": f"trx / {_roll('max(trx)', 60, 'trx')} - 1",
    "volatility_20": f"{_roll('stddev_pop(ret)', 20, 'ret')} * sqrt(252e0)",
    "volume_z_20": _zscore("vol", 20),
    "premium_discount": "close / nav - 1",
    "dividend_yield_ttm": "distribution_yield_ttm",
    "margin_change_5": _change("mb", 5),
    "short_change_5": _change("sb", 5),
    "institutional_net_ratio": "institutional_net / nullif(volume, 0)",
    "institutional_data_available": "CAST(institutional_available AS DOUBLE)",
    "fund_flow_5": _change("ou", 5),
}
STAGES["eod"] = "SELECT *, " + ",\n  ".join(f"{sql} AS {name}" for name, sql in _EOD.items()) + "\nFROM eod_base"

# Stages that say in which order a running product is taken: row by row, by date, as the running frame of the
# Spark plan does. A window aggregate leaves the order to the engine, and doubles multiplied in another order
# differ in the last digits: enough to fall on the other side of a rounding step somewhere in a large market.
_GROSS = "coalesce((close + cash_dividend) * split_ratio / lag(close) OVER (PARTITION BY symbol ORDER BY date), 1e0)"
IN_DATE_ORDER = {
    "running": f"""
SELECT symbol, list_reduce(list([gross_return] ORDER BY date),
                           lambda done, added: list_append(done, done[-1] * added[1])) AS products
FROM (SELECT symbol, date, {_GROSS} AS gross_return FROM ({STAGES["with_events"]})) GROUP BY symbol""",
    "indexed": f"""
SELECT e.* EXCLUDE (place), 100e0 * products[place] AS total_return_index
FROM (SELECT *, {_GROSS} AS gross_return, row_number() OVER (PARTITION BY symbol ORDER BY date) AS place
      FROM with_events) e JOIN running USING (symbol)""",
}
STAGES["eod_rsi"] = """
SELECT *, CASE WHEN loss = 0 AND gain > 0 THEN 100e0 WHEN loss = 0 AND gain = 0 THEN 50e0
               ELSE 100e0 - 100e0 / (1e0 + gain / nullif(loss, 0)) END AS rsi_14
FROM eod
"""
STAGES["features"] = (
    "SELECT * EXCLUDE (" + ", ".join(END_OF_DAY) + "),\n  "
    + ",\n  ".join(f"lag({name}) OVER {_W} AS {name}" for name in END_OF_DAY)
    + """,
  CAST(row_number() OVER (PARTITION BY symbol, strftime(date, '%Y-%m') ORDER BY date) AS INTEGER) AS trading_day,
  day(date) / CAST(day(last_day(date)) AS DOUBLE) AS month_progress,
  sin(2e0 * pi() * (isodow(date) - 1) / 5e0) AS weekday_sin,
  cos(2e0 * pi() * (isodow(date) - 1) / 5e0) AS weekday_cos
FROM eod_rsi"""
)
STAGES["complete"] = """
SELECT f.*, strftime(f.date, '%Y-%m') AS month FROM features f
JOIN (SELECT symbol, strftime(max(date) - INTERVAL 1 MONTH, '%Y-%m') AS cutoff FROM prices GROUP BY symbol) c
USING (symbol) WHERE strftime(f.date, '%Y-%m') <= cutoff
"""


def labels_over(source: str) -> str:
    """Labels of the rows of ``source``, which must hold complete months with ``month``."""
    return f"""
SELECT *, adjusted_open / oracle_adjusted_open - 1 AS regret, date = oracle_date AS is_oracle,
       adjusted_open / oracle_adjusted_open - 1 <= 0.005e0 AS near_optimal,
       ln(remaining_min_adjusted_open / previous_adjusted_close) AS remaining_min_log_ratio
FROM (SELECT *, CAST(count(*) OVER (PARTITION BY symbol, month) AS INTEGER) AS days_in_month,
             min(adjusted_open) OVER (PARTITION BY symbol, month) AS oracle_adjusted_open,
             first_value(date) OVER (PARTITION BY symbol, month ORDER BY adjusted_open, date) AS oracle_date,
             min(adjusted_open) OVER (PARTITION BY symbol, month ORDER BY date
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining_min_adjusted_open,
             lag(adjusted_close) OVER (PARTITION BY symbol ORDER BY date) AS previous_adjusted_close
      FROM {source})
"""


STAGES["labelled_all"] = labels_over("complete")
STAGES["labelled"] = "SELECT * FROM labelled_all WHERE month >= '1995-02'"
STAGES["oracle"] = """
SELECT symbol, month, date AS oracle_date, open AS oracle_open, adjusted_open AS oracle_adjusted_open,
       trading_day AS oracle_trading_day, days_in_month
FROM labelled WHERE is_oracle
"""


def _pct(column: str) -> str:
    return (
        f"SELECT date, last_value({column} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) "
        f"/ last_value({column} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        f" - 1 AS ret"
    )


STAGES["tsm_ret"] = f"SELECT * FROM ({_pct('adj_close')} FROM tsm) WHERE ret IS NOT NULL"
STAGES["sox_ret"] = f"SELECT * FROM ({_pct('adj_close')} FROM sox) WHERE ret IS NOT NULL"
STAGES["fx_up"] = f"""
SELECT date, CAST(up AS DOUBLE) AS usd_twd_up,
       CAST(up AND coalesce(lag(up) OVER (ORDER BY date), false)
            AND coalesce(lag(up, 2) OVER (ORDER BY date), false) AS DOUBLE) AS up_streak3
FROM (SELECT date, coalesce(ret > 0, false) AS up FROM ({_pct('usd_twd')} FROM fx))
"""
STAGES["led"] = """
SELECT *, coalesce(tsm_lead_ret < 0, false) AS tsm_dump, coalesce(sox_lead_ret < 0, false) AS sox_dump,
       coalesce(tsm_lead_ret <= -0.01e0, false) AS tsm_dump_1pct,
       coalesce(tsm_lead_ret >= 0, false) AS tsm_not_dump,
       coalesce(usd_twd_up_streak3, 1e0) < 0.5e0 AS fx_not_depreciating,
       coalesce(usd_twd_up, 1e0) < 0.5e0 AS fx_not_up
FROM (SELECT l.*, t.ret AS tsm_lead_ret, s.ret AS sox_lead_ret, x.usd_twd_up,
             x.up_streak3 AS usd_twd_up_streak3
      FROM (SELECT *, date - 1 AS asof FROM labelled) l
      ASOF LEFT JOIN tsm_ret t ON l.asof >= t.date
      ASOF LEFT JOIN sox_ret s ON l.asof >= s.date
      ASOF LEFT JOIN fx_up x ON l.asof >= x.date)
"""
STAGES["oos"] = """
SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY month) AS month_no FROM led)
WHERE month_no > 60
"""
STAGES["predictions"] = """
SELECT *, (date - DATE '1970-01-01') * 37 % 100 / 100e0 AS near_probability,
       coalesce(previous_adjusted_close, adjusted_open) * 0.99e0 AS reservation_adjusted
FROM oos
"""
STAGES["terminal"] = "SELECT symbol, arg_max(adjusted_close, date) AS terminal_close FROM adjusted GROUP BY symbol"


def first_hit(source: str, strategy: str, condition: str, deadline: int | None, forced: str = "NOT any_hit") -> str:
    """First row of the month meeting the condition within the deadline, else the last such row."""
    inside = f"trading_day <= {deadline}" if deadline else "true"
    return f"""
SELECT * EXCLUDE (hit, any_hit, rn), '{strategy}' AS strategy, {forced} AS forced FROM (
  SELECT *, bool_or(hit) OVER (PARTITION BY symbol, month) AS any_hit,
         row_number() OVER (PARTITION BY symbol, month ORDER BY hit DESC,
           CASE WHEN hit THEN trading_day ELSE -trading_day END) AS rn
  FROM (SELECT *, coalesce({condition}, false) AS hit FROM {source} WHERE {inside}))
WHERE rn = 1"""


_UNKNOWN = "CAST(NULL AS BOOLEAN)"
STAGES["baseline"] = " UNION ALL ".join([
    *[first_hit("oos", f"fixed_day_{n}", "false", n, _UNKNOWN) for n in (1, 5, 10, 15)],
    first_hit("oos", "last_day", "false", None, _UNKNOWN),
    first_hit("oos", "rsi30_or_last", "rsi_14 < 30", None, _UNKNOWN),
])
STAGES["lead_bought"] = " UNION ALL ".join(
    first_hit("oos", name, column, 5) for name, column in {
        "tsm_neg_or_day5": "tsm_dump", "sox_neg_or_day5": "sox_dump",
        "fx_pause_or_day5": "fx_not_depreciating", "tsm_dump1pct_or_day5": "tsm_dump_1pct",
        "tsm_buy_unless_adverse": "tsm_not_dump", "fx_single_pause_or_day5": "fx_not_up"}.items())
_BOTH = "near_probability >= 0.5e0 AND adjusted_open <= reservation_adjusted"
_POLICY_SQL = {
    "prob_and_res": (_BOTH, None), "prob_only": ("near_probability >= 0.5e0", None),
    "res_only": ("adjusted_open <= reservation_adjusted", None),
    "prob_and_res_deadline5": (_BOTH, 5), "prob_only_deadline5": ("near_probability >= 0.5e0", 5),
    "res_only_deadline5": ("adjusted_open <= reservation_adjusted", 5),
}
STAGES["policy_bought"] = " UNION ALL ".join(
    first_hit("predictions", name, condition, deadline) for name, (condition, deadline) in _POLICY_SQL.items())
STAGES["day1"] = "SELECT * FROM baseline WHERE strategy = 'fixed_day_1'"

_WORD = re.compile(r"[a-z_0-9]+")


def with_stages(body: str, **extra: str) -> str:
    """``body`` with the stages it names, and the stages those name, as CTEs in order.

    ``extra`` adds stages or replaces them by another text under the same name.
    """
    known = {**STAGES, **extra}
    ordered: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in dict.fromkeys(_WORD.findall(re.sub(r"'[^']*'", "", text))):
            if name in known and name not in path and name not in ordered and _reads(text, name):
                visit(known[name], (*path, name))
                ordered.append(name)

    visit(body, ())
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({known[name]})" for name in ordered) + "\n" + body


def _reads(text: str, name: str) -> bool:
    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) is not None


def rounded(columns: str, digits: int = 6) -> str:
    """``a, b`` to ``round(a, 6) AS a, round(b, 6) AS b``."""
    return ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in columns.split(","))


# Where a decimal step ends. Not at the half: many market values lie exactly there, and
# two engines that add in another order would fall on different sides of it.
STEP = 0.5001


def settled(text: str) -> str:
    """Spell out every ``round(x, n)`` as ``floor(x * 10^n + STEP) / 10^n``."""
    out, at = [], 0
    while (found := re.search(r"\bround\(", text[at:])) is not None:
        start = at + found.end()
        depth, end = 1, start
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inside = re.fullmatch(r"(.*), (\d+)", text[start:end - 1], re.S)
        if inside is None:
            out.append(text[at:end])
        else:
            scale = f"1e{inside.group(2)}"
            out.append(text[at:at + found.start()])
            out.append(f"floor(({settled(inside.group(1))}) * {scale} + {STEP}e0) / {scale}")
        at = end
    return "".join(out) + text[at:]


METRICS = f"""count(*) AS months, round(avg(regret), 6) AS mean_regret,
  round(quantile_cont(regret, 0.5), 6) AS median_regret, round(quantile_cont(regret, 0.75), 6) AS p75_regret,
  round(quantile_cont(regret, 0.9), 6) AS p90_regret, round(quantile_cont(regret, 0.95), 6) AS p95_regret,
  round(avg(CAST(regret <= 0.005e0 AS DOUBLE)), 6) AS within_0_5pct_rate,
  round(avg(CAST(regret <= 0.01e0 AS DOUBLE)), 6) AS within_1pct_rate,
  round(avg(trading_day), 6) AS mean_trading_day,
  round(avg(CAST(forced AS DOUBLE)), 6) AS forced_rate"""
FEATURE_LIST = ", ".join(ALL_FEATURES)
