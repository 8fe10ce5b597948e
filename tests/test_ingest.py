"""Landed payload files to the daily table, through the job, with good and bad sources."""

from __future__ import annotations

import json

import pytest

from tests.conftest import day, rows
from tidemark.operators.quality import DataQualityError
from tidemark.plans.daily import daily_from_files, daily_from_sources, parse_sources
from tidemark.plans.research import refuse_repeats

DATES = ("2024-05-06", "2024-05-07", "2024-05-08")
CLOSES = (40.0, 41.0, 42.0)


def payload(data):
    return json.dumps({"status": 200, "msg": "success", "data": data})


def texts(**changed):
    bars = [{"date": d, "open": c, "max": c + 1, "min": c - 1, "close": c, "Trading_Volume": 9, "Trading_money": 9 * c,
             "spread": 0, "Trading_turnover": 3} for d, c in zip(DATES, CLOSES)]
    held = [{"date": d, "MarginPurchaseTodayBalance": 4, "ShortSaleTodayBalance": 2} for d in DATES]
    flows = [{"date": DATES[1], "name": "Investment_Trust", "buy": 8, "sell": 3}]
    cash = [{"date": DATES[2], "stock_and_cache_dividend": 0.5, "stock_or_cache_dividend": "除息"}]
    history = [{"UPDATE_T": d, "NOW_NAV": c, "NOW_PRICE": c, "FUND_SIZE": 1, "OS_UNIT": 7} for d, c in zip(DATES, CLOSES)]
    good = {"prices": payload(bars), "margin": payload(held), "institutions": payload(flows), "dividends": payload(cash),
            "splits": payload([]), "nav": json.dumps({"ResultCode": 0, "ResultMsg": "ok", "Data": history})}
    return {**good, **changed}


def frames(spark, texts):
    return {name: spark.createDataFrame([("X", text)], "symbol string, payload string") for name, text in texts.items()}


def test_payload_files_become_the_daily_table(spark, tmp_path):
    for name, text in texts().items():
        folder = tmp_path / "landed" / name / "symbol=X"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text(text)
    out = rows(daily_from_files(spark, str(tmp_path / "landed"), str(tmp_path / "daily")), "date")
    assert [(r["symbol"], r["date"], r["close"]) for r in out] == [("X", day(d), c) for d, c in zip(DATES, CLOSES)]
    assert [r["trust_net"] for r in out] == [0.0, 5.0, 0.0]
    assert [r["cash_dividend"] for r in out] == [0.0, 0.0, 0.5]
    assert [r["official_close"] for r in out] == list(CLOSES)


def test_a_repeated_date_stops_the_job(spark):
    held = [{"date": DATES[0], "MarginPurchaseTodayBalance": 4, "ShortSaleTodayBalance": 2}] * 2
    with pytest.raises(DataQualityError, match="margin"):
        parse_sources(frames(spark, texts(margin=payload(held))))


def test_an_empty_source_stops_the_job(spark):
    with pytest.raises(ValueError, match="prices"):
        parse_sources(frames(spark, texts(prices=payload([]))))


def test_disagreeing_prices_stop_the_job(spark):
    off = [{"UPDATE_T": d, "NOW_NAV": c, "NOW_PRICE": c + 0.5, "FUND_SIZE": 1, "OS_UNIT": 7} for d, c in zip(DATES, CLOSES)]
    tables = parse_sources(frames(spark, texts(nav=json.dumps({"ResultCode": 0, "ResultMsg": "ok", "Data": off}))))
    with pytest.raises(DataQualityError, match="disagree"):
        daily_from_sources(tables)


def test_two_purchases_of_a_month_stop_the_job(spark):
    bought = spark.createDataFrame([("X", "a", "2024-05"), ("X", "b", "2024-05")], "symbol string, strategy string, month string")
    refuse_repeats(bought)
    with pytest.raises(DataQualityError, match="purchase"):
        refuse_repeats(bought.unionByName(bought.limit(1)))
