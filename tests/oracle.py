"""Runs registered queries and their SQL side by side and compares rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE",
    "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, list):
        return "[" + ", ".join(plain(v) for v in value) + "]"
    return repr(value)


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, types and rows; empty when equal."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    kinds = {d[0]: str(d[1]) for d in relation.description}
    theirs = relation.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for f in df.schema:
        want = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
        if want != kinds[f.name]:
            problems.append(f"type of {f.name}: {want} != {kinds[f.name]}")
    order = sorted(names)
    ours = sorted(tuple(plain(r[n]) for n in order) for r in df.collect())
    at = [names.index(n) for n in order]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in theirs)
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} != {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ over {order}, first {bad[0]}")
    if not ours:
        problems.append("no rows")
    return problems


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from flowlens.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                rows = df.collect()
                state = [] if rows else ["no rows"]
                note = f"rows only: {len(rows)}, e.g. {str(rows[0])[:160] if rows else ''}"
            else:
                state, note = compare(df, con, sql), ""
        except Exception as e:  # noqa: BLE001
            state, note = [f"{type(e).__name__}: {str(e)[:900]}"], ""
        failed += bool(state)
        print(f"{'FAIL' if state else 'ok  '} {name} {time.time() - started:.1f}s {note} {state or ''}", flush=True)
    print("failed", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
