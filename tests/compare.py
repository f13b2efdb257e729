"""Run a registered query and its SQL on the same tables and compare values, types aside."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veilframe.catalogue.fixtures import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return list(value) if isinstance(value, (list, tuple)) else value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(frame, sql: str, db: duckdb.DuckDBPyConnection) -> list[str]:
    result = db.execute(sql)
    want_columns = [d[0] for d in result.description]
    if sorted(frame.columns) != sorted(want_columns):
        return [f"columns {sorted(frame.columns)} but oracle {sorted(want_columns)}"]
    want, got = rows_of(want_columns, result.fetchall()), rows_of(frame.columns, frame.collect())
    out = [] if len(want) == len(got) else [f"{len(got)} rows but oracle {len(want)}"]
    if want != got:
        missing, extra = set(map(repr, want)) - set(map(repr, got)), set(map(repr, got)) - set(map(repr, want))
        out += [f"only oracle: {r}" for r in sorted(missing)[:4]] + [f"only spark: {r}" for r in sorted(extra)[:4]]
    return out


def main() -> None:
    import time

    import __spark_entry__ as entry
    from veilframe.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = sys.argv[2:]
    spark, db = local_session(), connect(sf)
    oracle = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            frame = query(spark, sf)
            found = differences(frame, oracle[name], db) if name in oracle else ["no oracle"]
        except Exception as problem:  # noqa: BLE001
            found = [repr(problem)[:1500]]
        print(f"{name:28s} {time.time() - start:6.1f}s {'ok' if not found else 'DIFF'}", flush=True)
        for line in found:
            print("     ", line[:600], flush=True)


if __name__ == "__main__":
    main()
