"""Runs queries beside their SQL: python tests/oracle.py [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings symbols edges usages text_units skim_decls hierarchy_nodes files call_log source_files eval_items".split()


def canonical(value):
    """A comparable form of one value, alike for both engines."""
    import datetime

    import numpy as np

    if value is None or value != value and not isinstance(value, (list, dict)):
        return ""
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in value.items()) + "}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, np.number)) or type(value).__name__ == "Decimal":
        return f"{round(float(value), 6) + 0:.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    return sorted(tuple(map(canonical, row)) for row in zip(*(table.column(n).to_pylist() for n in names))) if table.num_rows else []


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """'' if both give the same columns and rows, else what differs."""
    got = query(spark, sf_dir).toArrow()
    want = duck(sf_dir).execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} and {sorted(want.column_names)}"
    kinds = {n: (str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in got.column_names}
    odd = {n: k for n, (x, y) in kinds.items() if (k := (x, y)) and x != y and not {x, y} <= {"string", "large_string"} and not x.startswith(("list", "struct", "timestamp"))}
    if odd:
        print("  types:", name, odd)
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return ""
    import collections

    x, y = collections.Counter(a), collections.Counter(b)
    return f"rows {len(a)} and {len(b)}; only Spark: {list((x - y).items())[:2]}; only SQL: {list((y - x).items())[:2]}"


if __name__ == "__main__":
    sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
    import __spark_entry__ as e
    from conftest import session

    spark = session()
    bad = 0
    queries, sql = e.queries(), e.oracle_sql()
    for name in sys.argv[1:] or queries:
        t = time.time()
        try:
            said = compare(spark, name, queries[name], sql[name], "/root/testdata/sf0.01") if name in sql else f"no SQL; {queries[name](spark, '/root/testdata/sf0.01').count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{'ok ' if not said or said.startswith('no SQL') else 'BAD'} {name} {time.time() - t:.1f} s {said}", flush=True)
    print(bad, "bad")
