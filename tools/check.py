"""Run registered queries against their SQL twins in DuckDB and report differences.

    python tools/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.catalog import load  # noqa: E402
from tidemark.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def plain(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return None
        if hasattr(value, "isoformat"):
            return value.isoformat()[:10]
        if isinstance(value, (bool, str)) or type(value).__name__ == "bool_":
            return str(value)
        return float(value)

    names = sorted(frame.columns)
    rows = [tuple(map(plain, row)) for row in frame[names].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def kinds(frame: pd.DataFrame, relation) -> dict[str, str]:
    return {name: str(kind) for name, kind in zip(relation.columns, relation.types)}


def compare(spark_rows: list[tuple], sql_rows: list[tuple]) -> str:
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} against {len(sql_rows)}"
    off = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    if not off:
        return ""
    near = all(
        x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x)))
        for a, b in off for x, y in zip(a, b))
    return f"{len(off)} of {len(sql_rows)} rows differ{' by rounding only' if near else ''}: {off[0]}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    spark = build_session("check", "local[8]", 8, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g", "spark.log.level": "ERROR"})
    connection = connect(options.sf)
    failed = 0
    for name, case in load().items():
        if options.names and not any(name.startswith(prefix) for prefix in options.names):
            continue
        begun = time.time()
        try:
            frame = case.run(spark, options.sf)
            types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
            got = frame.toPandas()
            took = time.time() - begun
            if case.sql is None:
                print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            relation = connection.sql(case.sql)
            wanted_types = dict(zip(relation.columns, map(str, relation.types)))
            wanted = relation.df()
            sql_took = time.time() - begun - took
            problem = (
                f"columns {sorted(got.columns)} against {sorted(wanted.columns)}"
                if sorted(got.columns) != sorted(wanted.columns)
                else compare(canonical(got), canonical(wanted)))
            alike = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"},
                     "date": {"DATE"}, "boolean": {"BOOLEAN"}}
            odd = {c: (types[c], wanted_types[c]) for c in types
                   if c in wanted_types and wanted_types[c] not in alike.get(types[c], set())}
            note = f" types {odd}" if odd else ""
            print(f"{'FAIL ' if problem else 'ok   '} {name}: {len(got)} rows, {took:.1f}s, sql {sql_took:.1f}s"
                  f"{note} {problem[:600]}", flush=True)
            failed += bool(problem)
        except Exception as error:  # noqa: BLE001
            failed += 1
            text = str(error)
            print(f"ERROR {name}: {type(error).__name__} {text[:700]}", flush=True)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
