"""Compare registered queries with their SQL in DuckDB: python -m tests.check [names...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if glob.glob(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


_SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                "boolean": "BOOLEAN"}


def compare(spark, con, name, query, sql, sf_dir) -> str | None:
    """None when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    mine = df.collect()
    result = con.execute(sql)
    theirs_columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(theirs_columns):
        return f"columns {sorted(df.columns)} != {sorted(theirs_columns)}"
    types = {c: str(t) for c, t in zip(theirs_columns, [d[1] for d in result.description])}
    wrong = {c: (t, types[c]) for c, t in df.dtypes if _SPARK_TYPES.get(t) != types[c]}
    a, b = _rows(df.columns, mine), _rows(theirs_columns, theirs)
    if a != b:
        extra, lack = list(set(a) - set(b))[:3], list(set(b) - set(a))[:3]
        return f"rows {len(a)} vs {len(b)}; only Spark {extra}; only SQL {lack}"
    if wrong:
        return f"types {wrong}"
    if not a:
        return "no rows"
    return None


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.session import make_session

    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    spark = make_session()
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and name not in names and not any(name.startswith(n) for n in names if n[-1] == "_"):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, query, sqls[name], sf_dir)
            else:
                n = query(spark, sf_dir).count()
                problem = None if n else "no rows"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s "
              f"{problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
