"""Payload parsers, file readers and writers, quality checks."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import column, day, rows
from tidemark import schemas
from tidemark.functions import scalars as X
from tidemark.operators import quality as Q
from tidemark.sources import landed, parsers as P


def payload(spark, *bodies):
    return spark.createDataFrame([("X", json.dumps(body, ensure_ascii=False)) for body in bodies], "symbol string, payload string")


def envelope(spark, data, **extra):
    fields = tuple(dict.fromkeys(name for row in data for name in row))
    return P.open_envelope(payload(spark, {"status": 200, "msg": "success", "data": data, **extra}), fields)


@pytest.mark.parametrize("body", [
    {"status": 402, "msg": "quota", "data": []}, {"status": 200, "msg": "success"}, {"msg": "x", "data": []}])
def test_refused_payloads_fail(spark, body):
    with pytest.raises(PySparkException):
        P.open_envelope(payload(spark, body), ("date",)).collect()


def test_prices(spark):
    row = {"date": "2025-06-18", "open": "46.5", "max": 47.5, "min": 46, "close": 47, "Trading_Volume": 1000,
           "Trading_money": 47000, "spread": -0.5, "Trading_turnover": 12}
    got = rows(P.parse_prices(envelope(spark, [row])))[0]
    assert (got["date"], got["open"], got["high"], got["low"], got["price_change"]) == (day("2025-06-18"), 46.5, 47.5, 46.0, -0.5)
    with pytest.raises(PySparkException):
        P.parse_prices(envelope(spark, [{**row, "close": "--"}])).collect()


def test_dividends_keep_positive_cash_rows(spark):
    data = [{"date": "2025-01-17", "stock_and_cache_dividend": 2.7, "stock_or_cache_dividend": "除息"},
            {"date": "2025-02-17", "stock_and_cache_dividend": 1.0, "stock_or_cache_dividend": "除權"},
            {"date": "2025-03-17", "stock_and_cache_dividend": 0, "stock_or_cache_dividend": "除息"}]
    got = P.parse_dividends(envelope(spark, data))
    assert got.schema == schemas.DIVIDENDS and column(got, "cash_dividend") == [2.7]
    assert P.parse_dividends(envelope(spark, data[1:2])).count() == 0


@pytest.mark.parametrize("before, after, ratio", [(188.65, 47.16, 4.0), (100.0, 40.0, 2.5), (100.0, 40.4, 100 / 40.4)])
def test_split_ratios_snap_to_near_whole_numbers(spark, before, after, ratio):
    data = [{"date": "2025-06-18", "type": "分割", "before_price": before, "after_price": after}]
    assert column(P.parse_splits(envelope(spark, data)), "split_ratio") == pytest.approx([ratio])
    with pytest.raises(PySparkException):
        P.parse_splits(envelope(spark, [{**data[0], "after_price": 0}])).collect()


def test_institutions_count_five_of_six_classes(spark):
    names = ["Foreign_Investor", "Foreign_Dealer_Self", "Investment_Trust", "Dealer_self", "Dealer_Hedging"]
    nets = [60, 5, -10, 12, 5]
    data = [{"date": "2025-06-18", "name": n, "buy": 100 + v, "sell": 100} for n, v in zip(names, nets)]
    got = rows(P.parse_institutions(envelope(spark, data)))[0]
    assert (got["institutional_net"], got["foreign_net"], got["trust_net"], got["dealer_net"]) == (67.0, 60.0, -10.0, 17.0)
    with pytest.raises(PySparkException):
        P.parse_institutions(envelope(spark, [{**data[0], "name": "Stranger"}])).collect()


def test_exchange_months(spark):
    body = {"stat": "OK", "data": [[" 92/06/30", "1,037.50"], ["月平均收盤價", "37"], ["114/06/18", "47.16"]]}
    got = rows(P.parse_monthly_closes(payload(spark, body)), "date")
    assert [(r["date"], r["official_close"]) for r in got] == [(day("2003-06-30"), 1037.5), (day("2025-06-18"), 47.16)]
    assert P.official_closes(payload(spark, body), "2025-01-01", "2025-12-31").count() == 1
    for bad in ({"stat": "no data"}, {"stat": "OK", "data": [["2025-06-18", "1"]]}):
        with pytest.raises(PySparkException):
            P.parse_monthly_closes(payload(spark, bad)).collect()
    with pytest.raises(Q.DataQualityError):
        P.require_rows(P.parse_monthly_closes(payload(spark, body, body)))


def test_nav(spark):
    row = {"UPDATE_T": "2025-06-18 00:00:00", "NOW_NAV": 47.1, "NOW_PRICE": "47.2", "FUND_SIZE": 1, "OS_UNIT": 2}
    body = {"ResultCode": 0, "ResultMsg": "", "Data": [row, {**row, "UPDATE_T": "2025-06-19", "NOW_NAV": 0}]}
    assert column(P.parse_nav(payload(spark, body)), "nav") == [47.1]
    with pytest.raises(PySparkException):
        P.parse_nav(payload(spark, {**body, "ResultCode": 9})).collect()


def test_us_prices(spark):
    row = {"date": "2024-01-02", "Open": 10, "High": 11, "Low": 9, "Close": 10.5, "Adj_Close": 9.5, "Volume": 0}
    assert rows(P.parse_us_ohlc(envelope(spark, [row])))[0]["adj_close"] == 9.5
    assert column(P.parse_us_prices(envelope(spark, [row])), "adj_close") == [9.5]
    for change in ({"High": 10}, {"Low": 10.6}, {"Adj_Close": 0}, {"Volume": -1}):
        with pytest.raises(PySparkException):
            P.parse_us_ohlc(envelope(spark, [{**row, **change}])).collect()


def test_currency_quotes(spark):
    data = [{"date": "2024-01-02", "spot_buy": 31.0, "spot_sell": 31.2}, {"date": "2024-01-03", "spot_buy": -99, "spot_sell": 31},
            {"date": "2024-01-04", "spot_buy": "x", "spot_sell": 31}]
    assert column(P.parse_usd_twd(envelope(spark, data)), "usd_twd") == pytest.approx([31.1])
    with pytest.raises(ValueError):
        P.require_rows(P.parse_usd_twd(envelope(spark, data[1:])), ("date",))


def test_payload_files_carry_their_symbol(spark, tmp_path):
    for symbol in ("0050", "0056"):
        folder = tmp_path / f"symbol={symbol}"
        folder.mkdir()
        (folder / "a.json").write_text(json.dumps(
            {"stat": "OK", "data": [["92/06/30", "1,0"]]}, indent=1, ensure_ascii=False), encoding="utf-8")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        got = P.parse_monthly_closes(landed.read_payloads(spark, str(tmp_path)))
        assert sorted(column(got, "symbol")) == ["0050", "0056"]
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "true")


def test_errors_name_the_file_and_the_row(spark, tmp_path):
    def land(name, body):
        folder = tmp_path / name / "symbol=AB"
        folder.mkdir(parents=True)
        (folder / "one.json").write_text(body if isinstance(body, str) else json.dumps(body))
        return landed.read_payloads(spark, str(tmp_path / name))

    good = {"date": "2024-01-02", "MarginPurchaseTodayBalance": 1, "ShortSaleTodayBalance": 2}
    bad = land("number", {"status": 200, "msg": "success", "data": [good, {**good, "ShortSaleTodayBalance": "n/a"}]})
    with pytest.raises(PySparkException, match=r"number/symbol=AB/one.json row 2; ShortSaleTodayBalance=n/a"):
        P.parse_margin(P.open_envelope(bad, tuple(good))).collect()
    for name, body in (("cut", '{"status": 200, "msg": "success", "da'), ("quota", {"status": 402, "msg": "no", "data": []})):
        with pytest.raises(PySparkException, match=f"payload refused: status, msg or data; .*{name}/symbol=AB/one.json"):
            P.open_envelope(land(name, body), ("date",)).collect()
    with pytest.raises(PySparkException, match=r"row 1; name=Someone; buy=1; sell=null"):
        P.parse_institutions(P.open_envelope(land("class", {"status": 200, "msg": "success", "data": [
            {"date": "2024-01-02", "name": "Someone", "buy": 1}]}), ("date", "name", "buy", "sell"))).collect()
    with pytest.raises(PySparkException, match="NAV payload refused; .*nav/symbol=AB/one.json"):
        P.parse_nav(land("nav", {"ResultCode": 1, "ResultMsg": "x", "Data": None})).collect()
    held = spark.createDataFrame([("Q", json.dumps({"status": 200, "msg": "success", "data": [None]}))], "symbol string, payload string")
    with pytest.raises(PySparkException, match="payload of Q"):
        P.open_envelope(held, ("date",)).collect()


def test_daily_file_with_byte_order_mark(spark, tmp_path):
    names = schemas.DAILY.fieldNames()
    values = {"symbol": "0050", "date": "2024-01-02", "institutional_available": "true", "feature_available_date": "",
              "official_close_source": "s", "margin_balance": "NaN"}
    path = tmp_path / "daily.csv"
    path.write_text(",".join(names) + "\n" + ",".join(values.get(n, "1.5") for n in names) + "\n", encoding="utf-8-sig")
    got = rows(landed.read_daily(spark, str(path)))[0]
    assert got["symbol"] == "0050" and got["margin_balance"] is None and got["feature_available_date"] is None


def test_lead_files(spark, tmp_path):
    for name, filename in landed.LEAD_FILES.items():
        value = "usd_twd" if name == "fx" else "adj_close"
        (tmp_path / filename).write_text(f"date,{value},extra\n2024-01-02,31.5,x\n", encoding="utf-8-sig")
    leads = landed.load_leads(spark, str(tmp_path))
    assert column(leads["fx"], "usd_twd") == [31.5] and column(leads["tsm"], "date") == [day("2024-01-02")]
    (tmp_path / "sox_us.csv").write_text("date,close\n2024-01-02,1\n", encoding="utf-8")
    with pytest.raises(Q.DataQualityError):
        landed.load_leads(spark, str(tmp_path))
    (tmp_path / "sox_us.csv").unlink()
    with pytest.raises(PySparkException):
        landed.load_leads(spark, str(tmp_path))


def test_tables_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("A", day("2024-01-02"), 1.0), ("B", day("2024-01-02"), 2.0)], schemas.OFFICIAL)
    landed.write_by_symbol(frame, str(tmp_path / "daily"))
    back = landed.read_by_symbol(spark, str(tmp_path / "daily"), schemas.OFFICIAL)
    assert column(back.select("symbol", "date", "official_close"), "official_close", "symbol") == [1.0, 2.0]
    landed.write_raw({"official": frame}, str(tmp_path / "raw"))
    assert landed.write_results({"t": frame}, str(tmp_path / "out"))["t"].count() == 2
    landed.write_json(frame, str(tmp_path / "json"))
    assert spark.read.parquet(str(tmp_path / "raw" / "official")).count() == 2
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_missing_columns_and_empty_tables(spark):
    frame = spark.createDataFrame([("A", day("2024-01-02"), 1.0)], schemas.OFFICIAL)
    Q.require_columns(frame, ("symbol", "official_close"), "official")
    for bad in (lambda: Q.require_columns(frame, ("nav",), "official"),
                lambda: Q.require_columns(frame.limit(0), ("symbol",), "official"),
                lambda: Q.require(Q.duplicate_keys(frame.unionByName(frame)), "repeated")):
        with pytest.raises(Q.DataQualityError):
            bad()


def test_scalar_guards(spark):
    frame = spark.createDataFrame([(" 92/06/30", "2024-01"), ("114/06/18", "2024-12")], "roc string, month string")
    assert column(frame.select(X.roc_date("roc").alias("d"), "month"), "d", "month") == [day("2003-06-30"), day("2025-06-18")]
    for bad in (X.roc_date(F.lit("2025-06-18")), X.roc_date(F.lit("92/13/01")), X.month_text(F.lit("2024-13")),
                X.plain_number(F.lit("1.2.3"))):
        with pytest.raises(PySparkException):
            frame.select(bad.alias("x")).collect()
    odd = spark.createDataFrame([("1e3",), ("NaN",), ("inf",), ("x",), (None,)], "v string")
    assert [r["n"] for r in odd.select(X.number("v").alias("n")).collect()] == [1000.0, None, None, None, None]
