"""Compare a Spark result with the SQL oracle's rows (used by tests and by hand).

python -m tests.compare [--sf DIR] [key ...]   checks the given (or all) keys.
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def _type_name(t: pa.DataType) -> str:
    return "string" if pa.types.is_string(t) or pa.types.is_large_string(t) else str(t)


def rows_and_types(table: pa.Table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted(tuple(map(_plain, row)) for row in zip(*columns)) if names else []
    return names, [_type_name(table.schema.field(n).type) for n in names], rows


def difference(spark_rows: pa.Table, oracle_rows: pa.Table) -> str | None:
    """None when names, types and the multiset of rows are all equal."""
    names, types, rows = rows_and_types(spark_rows)
    names2, types2, rows2 = rows_and_types(oracle_rows)
    if names != names2:
        return f"columns {names} != {names2}"
    if types != types2:
        return f"types {[x for x in zip(names, types, types2) if x[1] != x[2]]}"
    if rows != rows2:
        ours, theirs = set(rows), set(rows2)
        return (
            f"{len(rows)} vs {len(rows2)} rows; only spark {sorted(ours - theirs)[:2]}; "
            f"only oracle {sorted(theirs - ours)[:2]}"
        )
    return None


def main(argv=None) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from catalens.session import session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args(argv)

    spark, con = session(), connect(args.sf)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for key in args.keys or queries:
        start = time.perf_counter()
        try:
            ours = queries[key](spark, args.sf).toArrow()
            took = time.perf_counter() - start
            if key not in oracles:
                print(f"----  {key:28s} {ours.num_rows:6d} rows {took:6.2f}s  no oracle")
                continue
            start = time.perf_counter()
            theirs = con.sql(oracles[key]).to_arrow_table()
            problem = difference(ours, theirs)
            rows = ours.num_rows
        except Exception as error:  # report and go on with the next key
            problem, rows, took = f"{type(error).__name__}: {str(error)[:400]}", -1, time.perf_counter() - start
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'}  {key:28s} {rows:6d} rows {took:6.2f}s "
              f"{time.perf_counter() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main())
