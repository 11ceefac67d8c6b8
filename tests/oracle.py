"""Runs named queries in Spark and their checking SQL in DuckDB and compares rows.

    python tests/oracle.py [sf_dir] [name substring ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    return str(v)


def duck(sf_dir: str):
    import duckdb

    from keelson.fixtures import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, q, sf_dir):
    """Returns (status, detail)."""
    df = q.build(spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    if not q.sql:
        return "rows", f"{len(rows)} rows"
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return "FAIL", f"columns {sorted(set(names) ^ set(cols))}"
    idx = [names.index(c) for c in cols]
    exp = sorted(tuple(canon(r[i]) for i in idx) for r in cur.fetchall())
    if rows != exp:
        a, b = set(rows) - set(exp), set(exp) - set(rows)
        return "FAIL", (f"spark {len(rows)} duck {len(exp)}; {cols}\n   only spark({len(a)}): {sorted(a)[:3]}"
                        f"\n   only duck({len(b)}): {sorted(b)[:3]}")
    kinds = {c: t for c, t in df.dtypes}
    odd = [c for c, t in kinds.items() if t in ("int", "float", "smallint") or "array" in t or "map" in t or "decimal" in t]
    return ("ok" if rows else "EMPTY"), f"{len(rows)} rows" + (f" types {odd}" if odd else "")


def main(argv):
    from keelson.queries import CATALOG
    from keelson.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    pick = argv[1:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.local.dir": "/tmp"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for q in CATALOG.values():
        if pick and not any(p in q.name for p in pick):
            continue
        t = time.time()
        try:
            status, detail = compare(spark, con, q, sf)
        except Exception as e:  # noqa: BLE001
            status, detail = "ERROR", f"{type(e).__name__}: {str(e)[:900]}"
        bad += status in ("FAIL", "ERROR")
        print(f"{status:6} {time.time() - t:6.2f}s {q.name}: {detail}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
