"""Run registered queries against their comparison SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v.is_integer() else v)
    if hasattr(v, "is_integer") and not isinstance(v, int):
        return plain(float(v))
    return v


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def ordered(columns, rows):
    idx = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in idx) for r in rows)


def compare(spark, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = ordered(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"{sum(got[1].values())} rows, no SQL", took
    want = ordered(*oracle_rows(sql, sf_dir))
    if got[0] != want[0]:
        return False, f"columns {got[0]} vs {want[0]}", took
    if got[1] != want[1]:
        extra, missing = got[1] - want[1], want[1] - got[1]
        sample = [f"+ {x}" for x in list(extra)[:2]] + [f"- {x}" for x in list(missing)[:2]]
        return False, (
            f"{sum(got[1].values())} vs {sum(want[1].values())} rows; "
            f"{sum(extra.values())} extra {sum(missing.values())} missing\n  {got[0]}\n  " + "\n  ".join(sample)
        ), took
    return True, f"{sum(got[1].values())} rows", took


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    from urltriage.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, note, took = compare(spark, name, fn, oracles.get(name), sf)
        except Exception as e:  # noqa: BLE001
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:1500]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {took:6.2f}s  {note}", flush=True)
