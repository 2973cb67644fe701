"""Run registered queries beside their SQL twins and compare rows, names and values."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def kind(value) -> str:
    """Values of different kinds are never equal, even if Python says 1 == 1.0 == True."""
    for name, types in (("bool", bool), ("int", int), ("float", float),
                        ("time", dt.datetime), ("date", dt.date)):
        if isinstance(value, types):
            return name
    return type(value).__name__


def normal(value) -> str:
    if isinstance(value, float) and math.isnan(value):
        return "float:nan"
    return f"{kind(value)}:{value!r}"


def as_rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = sorted(tuple(normal(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], data


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when both agree, otherwise what differs."""
    df = query(spark, sf_dir)
    mine = as_rows(df.columns, df.collect())
    result = con.execute(sql)
    theirs = as_rows([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows != {len(theirs[1])}"
    different = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if different:
        return f"{len(different)} rows differ, first {different[0]} (columns {mine[0]})"
    return None


def main() -> None:
    import __spark_entry__ as entry_module
    from conftest import make_session

    spark = make_session()
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con = database(sf_dir)
    queries, sqls = entry_module.queries(), entry_module.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf_dir, queries[name], sqls[name])
                status = problem or "equal"
                bad += problem is not None
            else:
                status = f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as error:  # report and go on to the next query
            status, bad = f"ERROR {str(error)[:1500]}", bad + 1
        print(f"{name:32s} {time.time() - start:6.2f}s {status}", flush=True)
    print(f"{bad} of {len(names or queries)} failed; without SQL: {sorted(set(queries) - set(sqls))}")


if __name__ == "__main__":
    main()
