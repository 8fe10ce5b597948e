"""The store of scores: only changed partitions are rewritten, and what is read equals a fresh run."""

from __future__ import annotations

import os

import pandas as pd

from tests.conftest import rows
from tests.test_models import CONFIG, FEATURES, market, table
from tidemark.operators import walkforward as W
from tidemark.plans import store


def quick(train, test, columns, config):
    return pd.DataFrame({"near_probability": [min(1.0, len(train) / 1_000)] * len(test),
                         "predicted_remaining_log_ratio": [float(train[columns].sum().sum()) / 1e4] * len(test)})


def files(folder):
    return {os.path.join(d, name): os.stat(os.path.join(d, name)).st_mtime_ns
            for d, _, names in os.walk(folder) for name in names if name.endswith(".parquet")}


def month_of(path):
    return path.split("test_month=")[1][:7]


def test_only_changed_partitions_are_rewritten(spark, tmp_path):
    folder, frame = str(tmp_path / "store"), market()
    first = store.update(table(spark, frame), folder, CONFIG, FEATURES, estimator=quick)
    assert (first.scored, first.dropped) == (4, 0) and [m for _, m in first.partitions] == ["2020-05", "2020-06", "2020-07", "2020-08"]
    before = files(folder)
    assert len(before) == 4
    again = store.update(table(spark, frame), folder, CONFIG, FEATURES, estimator=quick)
    assert again == store.Update(0, 0, []) and files(folder) == before

    moved = frame.copy()
    moved.loc[moved["month"] == "2020-07", "a"] = 9.0
    second = store.update(table(spark, moved), folder, CONFIG, FEATURES, estimator=quick)
    assert (second.scored, second.dropped) == (2, 2) and [m for _, m in second.partitions] == ["2020-07", "2020-08"]
    after = files(folder)
    assert {p: t for p, t in after.items() if month_of(p) < "2020-07"} == {p: t for p, t in before.items() if month_of(p) < "2020-07"}
    assert not {p for p in after if month_of(p) >= "2020-07"} & set(before)

    columns = ["symbol", "date", "near_probability", "predicted_remaining_log_ratio", "reservation_adjusted", "fingerprint"]
    fresh = W.walk_forward(table(spark, moved), CONFIG, FEATURES, estimator=quick)
    assert rows(store.predictions(table(spark, moved), folder, CONFIG, FEATURES).select(*columns), "date") == rows(fresh.select(*columns), "date")

    shorter = store.update(table(spark, moved[moved["month"] <= "2020-06"]), folder, CONFIG, FEATURES, estimator=quick)
    assert (shorter.scored, shorter.dropped) == (0, 2) and {month_of(p) for p in files(folder)} == {"2020-05", "2020-06"}
    # restated prices alone change no score, but what is read
    dearer = frame.assign(previous_adjusted_close=frame["previous_adjusted_close"] * 2)
    dearer = dearer[dearer["month"] <= "2020-06"]
    assert store.update(table(spark, dearer), folder, CONFIG, FEATURES, estimator=quick).partitions == []
    twice = rows(store.predictions(table(spark, dearer), folder, CONFIG, FEATURES), "date")
    once = rows(fresh.where("month <= '2020-06'"), "date")
    assert [r["reservation_adjusted"] for r in twice] == [2 * r["reservation_adjusted"] for r in once]


def test_an_empty_store(spark, tmp_path):
    assert store.read(spark, str(tmp_path / "none")).count() == 0
    assert store.predictions(table(spark, market()), str(tmp_path / "none"), CONFIG, FEATURES).count() == 0
