"""Side-by-side check of registered queries against their SQL twins in DuckDB.

    python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(repr(row[i]) for i in order) for row in rows))


def compare(df, con, sql) -> str | None:
    """None when equal, otherwise what differs first."""
    spark_rows = df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    a_names, a = canonical(df.columns, [tuple(r) for r in spark_rows])
    b_names, b = canonical(names, cur.fetchall())
    if a_names != b_names:
        return f"columns {a_names} / {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {a_names} {bad[0][0]} / {bad[0][1]}"
    if not a:
        return "no rows"
    return None


def main() -> None:
    from sparktraces.plans import catalog
    from tests.conftest import make_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = make_session()
    con = connect(sf_dir)
    failed = 0
    registry = catalog.load()
    for name, q in registry.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = q.run(spark, sf_dir)
            if q.sql is None:
                note = f"rows only: {len(df.collect())}"
                bad = False
            else:
                why = compare(df, con, q.sql)
                note, bad = why or "ok", why is not None
        except Exception as error:  # report and go on to the next query
            note, bad = f"{type(error).__name__}: {str(error)[:1500]}", True
        failed += bad
        print(f"{'FAIL' if bad else 'pass'} {name} {time.time() - start:.1f}s {note if bad or q.sql is None else ''}", flush=True)
    print("failed", failed)
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
