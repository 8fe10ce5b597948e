from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    extra = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
             "spark.driver.memory": "8g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = build_session("tests", "local[8]", 4, **extra)
    ship_package(session)
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def days(start: str, count: int, step: int = 1) -> list[dt.date]:
    first = day(start)
    return [first + dt.timedelta(days=step * n) for n in range(count)]


def rows(df, *order: str) -> list[dict]:
    return [row.asDict() for row in (df.orderBy(*order) if order else df).collect()]


def column(df, name: str, *order: str) -> list:
    return [row[name] for row in rows(df, *order)]
