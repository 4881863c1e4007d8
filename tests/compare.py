"""Run registered queries and their SQL side by side.

``python -m tests.compare /root/testdata/sf0.01 [name-prefix ...]``
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def spark_rows(df):
    order = sorted(df.columns)
    return order, sorted((tuple(repr(plain(r[c])) for c in order) for r in df.collect()))


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(names)
    at = [names.index(c) for c in order]
    return order, sorted(tuple(repr(plain(r[i])) for i in at) for r in cursor.fetchall())


def difference(spark_result, duck_result) -> str | None:
    (sc, sr), (dc, dr) = spark_result, duck_result
    if sc != dc:
        return f"columns differ: {sc} and {dc}"
    if len(sr) != len(dr):
        only_s = list(set(sr) - set(dr))[:2]
        only_d = list(set(dr) - set(sr))[:2]
        return f"{len(sr)} rows and {len(dr)} rows over {sc}; spark only {only_s}; sql only {only_d}"
    if sr != dr:
        only_s = sorted(set(sr) - set(dr))
        only_d = sorted(set(dr) - set(sr))
        return f"{len(only_s)} of {len(sr)} rows differ over {sc}; spark {only_s[:2]}; sql {only_d[:2]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from labelloom.session import local_session

    sf_dir, *prefixes = sys.argv[1:]
    spark = local_session()
    con = connect(sf_dir)
    plans, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, plan in plans.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            left = spark_rows(plan(spark, sf_dir))
            mid = time.time()
            note = "rows only" if name not in sql else difference(left, duck_rows(con, sql[name])) or "ok"
        except Exception as error:  # noqa: BLE001
            mid = time.time()
            left = (None, [])
            note = "FAILED " + str(error).strip()[:900]
            if "-v" in prefixes:
                traceback.print_exc()
        if note not in ("ok", "rows only"):
            bad += 1
        print(f"{name:45s} {len(left[1]):7d} rows {mid - start:6.2f}s {note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
