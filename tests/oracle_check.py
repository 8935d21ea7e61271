"""Run registered queries against their SQL on DuckDB: ``[CHECK_SF_DIR=...] python tests/oracle_check.py [names...]``."""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def duck(sf=SF):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, name, run, sql, sf=SF):
    """(matches, text) for one query."""
    start = time.time()
    df = run(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"rows only: {len(got)} rows, {took:.1f}s"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} / {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, f"{len(a)} rows, {took:.1f}s"
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return False, f"{len(a)}/{len(b)} rows; spark only {only_a}; sql only {only_b}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from bench import session

    spark, con = session(8), duck()
    all_queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or all_queries:
        try:
            good, text = compare(spark, con, name, all_queries[name], sql.get(name))
        except Exception as e:  # noqa: BLE001
            good, text = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if good else "FAIL", name, text, flush=True)
