"""Run a Spark check and its SQL oracle on the same files and say how they differ."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def norm(v: object) -> object:
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(norm(x)) for x in v) + "]"
    return v


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(str, t)))


def kind(v: object) -> str:
    return type(v).__name__


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return bool(got), f"rows={len(got)} {took:.1f}s (no oracle)"
    res = con.execute(sql)
    want_names = [c[0] for c in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return False, f"columns {sorted(df.columns)} != {sorted(want_names)}"
    a, b = rows_of(df.columns, got), rows_of(want_names, want)
    if a != b:
        only_a = [x for x in a if x not in b][:3] if len(a) < 20000 else a[:2]
        only_b = [x for x in b if x not in a][:3] if len(b) < 20000 else b[:2]
        return False, (f"{sorted(df.columns)} spark={len(a)} sql={len(b)}\n   spark only: {only_a}"
                       f"\n   sql only:   {only_b}")
    kinds = ""  # a column of another kind is a difference, though its values compare equal
    if got:
        ia = {n: i for i, n in enumerate(df.columns)}
        ib = {n: i for i, n in enumerate(want_names)}
        for n in df.columns:
            ka = {kind(r[ia[n]]) for r in got} - {"NoneType"}
            kb = {kind(r[ib[n]]) for r in want} - {"NoneType"}
            if ka and kb and ka != kb:
                kinds += f" TYPE {n}: {ka} vs {kb}"
    return not kinds, f"rows={len(a)} {took:.1f}s{kinds}"


def main() -> None:
    import sys

    import __spark_entry__ as entry
    from evidex.session import build

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build(8)
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as exc:  # noqa: BLE001 - the report names every failure
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
