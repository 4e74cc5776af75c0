"""Local correctness check: run a catalog query in Spark and its SQL in DuckDB, compare.

Used by tests and by hand (``python -m fraudscope.plans.oracle sf_dir [names...]``).
Mirrors the driver's comparison: same column names, same row count, and the same
multiset of rows (floats compared after rounding to 9 significant digits, and
also reported bit-exact).
"""

from __future__ import annotations

import math
import sys
import time


def _norm(v, digits=9):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == 0:
            return 0.0
        return float(f"{v:.{digits}g}")
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def duckdb_run(sql: str, sf_dir: str):
    import duckdb

    from ..sources.tables import TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(spark, name: str, sf_dir: str, digits: int = 9, queries: dict | None = None, sql_of: dict | None = None) -> dict:
    """``queries`` and ``sql_of``: where the query and its SQL are registered (default: this package's catalog)."""
    from . import catalog

    t0 = time.time()
    sdf = (catalog.queries() if queries is None else queries)[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    out = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    sql = (catalog.oracle_sql() if sql_of is None else sql_of).get(name)
    if sql is None:
        out["status"] = "rows-only"
        return out
    dcols, drows = duckdb_run(sql, sf_dir)
    out["oracle_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        out["status"] = f"COLUMNS differ: spark={scols} oracle={dcols}"
        return out
    order = [dcols.index(c) for c in sorted(scols)]
    sorder = [scols.index(c) for c in sorted(scols)]

    def canon(rows, idx, d):
        return sorted((tuple(_norm(r[i], d) for i in idx) for r in rows), key=repr)

    exact = canon(srows, sorder, 17) == canon(drows, order, 17)
    close = canon(srows, sorder, digits) == canon(drows, order, digits)
    out["status"] = "ok" if close else "VALUES differ"
    out["bit_exact"] = exact
    if not close:
        a, b = canon(srows, sorder, digits), canon(drows, order, digits)
        diff = [x for x in a if x not in set(b)][:3]
        out["sample_spark_only"] = [str(x)[:300] for x in diff]
        out["sample_oracle_only"] = [str(x)[:300] for x in [x for x in b if x not in set(a)][:3]]
    return out


def main(argv):
    from ..session import local_session
    from .catalog import queries

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(queries())
    spark = local_session(8)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir)
        except Exception as e:  # report and keep going
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
