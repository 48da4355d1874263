"""Run each registered Spark query and its DuckDB oracle side by side.

Compares row count, column names, a coarse type family per column, and an
order-insensitive hash of the values.  Usable from pytest and as a script:

    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from reelcat.sources.tables import TABLES  # noqa: E402


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _family_spark(dtype: str) -> str:
    d = dtype.lower()
    if d in ("bigint", "int", "smallint", "tinyint", "long", "integer"):
        return "int:" + ("64" if d in ("bigint", "long") else "32")
    if d in ("double", "float"):
        return "float"
    if d.startswith("decimal"):
        return "decimal"
    if d in ("string",) or d.startswith("varchar") or d.startswith("char"):
        return "string"
    if d.startswith("timestamp"):
        return "timestamp"
    return d


def _family_duck(dtype: str) -> str:
    d = dtype.upper()
    if d in ("BIGINT", "HUGEINT", "UBIGINT"):
        return "int:64"
    if d in ("INTEGER", "SMALLINT", "TINYINT", "UINTEGER", "USMALLINT", "UTINYINT"):
        return "int:32"
    if d in ("DOUBLE", "FLOAT"):
        return "float"
    if d.startswith("DECIMAL"):
        return "decimal"
    if d == "VARCHAR":
        return "string"
    if d.startswith("TIMESTAMP"):
        return "timestamp"
    if d == "BOOLEAN":
        return "boolean"
    if d == "DATE":
        return "date"
    return d.lower()


def _canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6f}"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    return str(v)


def table_digest(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_canon(r[i]) for i in order) for r in rows)
    h = hashlib.sha256()
    for line in lines:
        h.update(line.encode())
        h.update(b"\n")
    return h.hexdigest()


def compare(spark, sf_dir: str, name: str, query, sql: str | None, con=None) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_types = [_family_spark(t) for _, t in sdf.dtypes]
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    out = {"name": name, "rows": len(s_rows), "spark_sec": round(t1 - t0, 3)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck_connect(sf_dir)
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = [_family_duck(str(t)) for t in rel.types]
    d_rows = rel.fetchall()
    out["oracle_rows"] = len(d_rows)
    problems = []
    if len(s_rows) != len(d_rows):
        problems.append(f"row count {len(s_rows)} != {len(d_rows)}")
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns {sorted(s_cols)} != {sorted(d_cols)}")
    else:
        st = dict(zip(s_cols, s_types))
        dt = dict(zip(d_cols, d_types))
        bad = {c: (st[c], dt[c]) for c in s_cols if st[c] != dt[c]}
        if bad:
            problems.append(f"types {bad}")
        if table_digest(s_cols, s_rows) != table_digest(d_cols, d_rows):
            problems.append("value hash differs")
    out["status"] = "ok" if not problems else "; ".join(problems)
    return out


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import __spark_entry__ as E
    from reelcat.session import get_spark

    spark = get_spark()
    con = duck_connect(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    failed = 0
    for name, q in qs.items():
        if only and name not in only:
            continue
        try:
            res = compare(spark, sf_dir, name, q, sqls.get(name), con)
        except Exception as exc:  # report and continue
            res = {"name": name, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        if res["status"] not in ("ok", "rows-only"):
            failed += 1
        print(res, flush=True)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
