"""Compare registered queries with their SQL: ``python -m tests.oracle SF_DIR [name-prefix ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from pagestrata.plans import catalog
from pagestrata.plans.fixtures import BASE_TABLES
from pagestrata.session import local_session


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _key(row):
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n", v if v is not None else 0) for v in row)


def compare(spark, con, name: str, sf_dir: str):
    """(ok, message, rows, Spark seconds)."""
    start = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - start
    if name not in catalog.ORACLES:
        return True, "no SQL", len(got), took
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != cols:
        return False, f"columns {cols} against {sorted(names)}", len(got), took
    at = [names.index(c) for c in cols]
    want = [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]
    got.sort(key=_key)
    want.sort(key=_key)
    note = ""
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        k = kinds[f.name].upper()
        same = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}.get(t)
        if same is None or same not in k:
            if not (same and k in ("NUMBER", "STRING", "BOOL")):
                note += f" type {f.name}: {t} / {k};"
    if got == want:
        return True, "equal" + note, len(got), took
    odd = [(g, w) for g, w in zip(got, want) if g != w][:2]
    gs, ws = set(map(str, got)), set(map(str, want))
    only = [r for r in got if str(r) not in ws][:2], [r for r in want if str(r) not in gs][:2]
    return False, f"{len(got)} rows against {len(want)}; only Spark {only[0]}; only SQL {only[1]}{note} {str(odd)[:0]}", len(got), took


def main():
    sf_dir, picks = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in catalog.QUERIES:
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            ok, message, rows, took = compare(spark, con, name, sf_dir)
        except Exception as exc:
            ok, message, rows, took = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0, 0.0
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} rows={rows} {took:.1f}s {message}"[:1500], flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
