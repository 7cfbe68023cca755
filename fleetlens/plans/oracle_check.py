"""Side-by-side check of a catalogue query against its DuckDB oracle.

Used by the tests and by ``python -m fleetlens.plans.oracle_check``.
Rows are compared as multisets after sorting columns by name, with
floating point values rounded.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys

from fleetlens.sources.tables import TABLES


def _norm(v, digits: int = 6):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits)
    if isinstance(v, decimal.Decimal):
        return round(float(v), digits)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x, digits)) for k, x in v.items()))
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    return v


def _canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return cols, out


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, name: str, sf_dir: str, con=None) -> tuple[bool, str]:
    from fleetlens.plans.registry import oracle_sql, queries
    q = queries()[name]
    sql = oracle_sql().get(name)
    df = q(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    s_cols, s_rows = _canon(df.columns, rows)
    if sql is None:
        return True, f"{name}: {len(s_rows)} rows (no oracle)"
    con = con or duckdb_connection(sf_dir)
    res = con.execute(sql)
    d_cols_raw = [d[0] for d in res.description]
    d_cols, d_rows = _canon(d_cols_raw, res.fetchall())
    if s_cols != d_cols:
        return False, f"{name}: columns differ spark={s_cols} duckdb={d_cols}"
    if len(s_rows) != len(d_rows):
        return False, f"{name}: row count spark={len(s_rows)} duckdb={len(d_rows)}"
    if s_rows != d_rows:
        diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
        return False, f"{name}: values differ, first diffs {diff}"
    return True, f"{name}: {len(s_rows)} rows match"


def main(argv=None):
    argv = argv if argv is not None else sys.argv[1:]
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    from fleetlens.plans.registry import queries
    from fleetlens.session import get_session
    spark = get_session("local[8]", 8)
    names = argv or sorted(queries())
    con = duckdb_connection(sf_dir)
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and go on
            ok, msg = False, f"{n}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(("OK   " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
