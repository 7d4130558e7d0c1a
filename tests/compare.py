"""Run registered queries next to their SQL and report differences: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(value):
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def differences(spark, con, name: str, sf_dir: str) -> list[str]:
    from hashmark.catalog import ORACLES, QUERIES

    frame = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    if name not in ORACLES:
        return [] if got else ["no rows"]
    relation = con.sql(ORACLES[name])
    columns, want = relation.columns, relation.fetchall()
    out = []
    if sorted(columns) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} != {sorted(columns)}"]
    types = dict(zip(columns, [str(t) for t in relation.types]))
    for c, t in frame.dtypes:
        if SAME.get(t, t) != types[c]:
            out.append(f"type of {c}: {t} != {types[c]}")
    a, b = rows_of(frame.columns, got), rows_of(columns, want)
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        head = sorted(columns)
        out.append(f"{len(sa - sb)} rows only in Spark, {len(sb - sa)} only in SQL: {head} {sorted(sa - sb)[:2]} {sorted(sb - sa)[:2]}")
    if not a:
        out.append("no rows")
    return out


def main() -> None:
    from hashmark.catalog import QUERIES
    from hashmark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/sf{sf}"
    con = duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            found = differences(spark, con, name, sf_dir)
        except Exception as error:  # report and go on to the next query
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'ok ' if not found else 'BAD'} {name} {time.time() - start:.1f}s", *found, sep="\n     " if found else " ", flush=True)
    print(f"{len(names) - bad} of {len(names)} match")


if __name__ == "__main__":
    main()
