"""Run catalogue queries and their DuckDB statements side by side; values must be equal, types alike.

    python tests/compare.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TESTDATA = os.environ.get("STAYRATE_TESTDATA", "/root/testdata")

_KINDS = {
    "bigint": "int64", "int": "int32", "integer": "int32", "varchar": "string", "string": "string",
    "double": "double", "date": "date", "boolean": "boolean", "timestamp": "timestamp", "timestamp_ntz": "timestamp",
}


def kind(name: str) -> str:
    name = name.lower().replace(" ", "")
    return _KINDS.get(name, name)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def spark_rows(df):
    names = sorted(df.columns)
    types = {n: kind(t) for n, t in df.dtypes}
    return types, Counter(tuple(r) for r in df.select(*names).collect())


def duck_rows(con, sql: str):
    types = {r[0]: kind(str(r[1])) for r in con.execute(f"describe {sql}").fetchall()}
    names = sorted(types)
    inner = ", ".join(f'"{n}"' for n in names)
    return types, Counter(con.execute(f"select {inner} from ({sql})").fetchall())


def difference(spark, con, sf_dir: str, run, sql: str | None) -> str:
    """Empty when equal."""
    types, rows = spark_rows(run(spark, sf_dir))
    if sql is None:
        return "" if sum(rows.values()) else "no rows"
    duck_types, duck_result = duck_rows(con, sql)
    if types != duck_types:
        both = set(types) | set(duck_types)
        return "types: " + str({n: (types.get(n), duck_types.get(n)) for n in both if types.get(n) != duck_types.get(n)})
    if not rows:
        return "no rows on either side" if not duck_result else "no rows in Spark"
    if rows != duck_result:
        only_spark, only_duck = list((rows - duck_result).items()), list((duck_result - rows).items())
        sample = "\n   ".join(map(str, sorted(only_spark, key=str)[:3] + ["--"] + sorted(only_duck, key=str)[:3]))
        return f"{len(only_spark)} / {len(only_duck)} rows differ of {sum(rows.values())} / {sum(duck_result.values())}\n   {sorted(types)}\n   {sample}"
    return ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from stayrate.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    sf_dir = f"{TESTDATA}/sf{args.sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, runs, sqls = duck(sf_dir), queries(), oracle_sql()
    bad = 0
    for key in args.keys or runs:
        start = time.time()
        try:
            problem = difference(spark, con, sf_dir, runs[key], sqls.get(key))
        except Exception as error:  # report and go on with the next key
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        state = "DIFF" if problem else ("ok" if key in sqls else "rows")
        print(f"{state:5} {time.time() - start:6.2f}s {key} {problem}", flush=True)
    unknown = set(sqls) - set(runs)
    print(f"{len(runs)} queries, {len(sqls)} statements, {bad} problems {unknown or ''}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
