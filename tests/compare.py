"""Runs registered queries beside their SQL twins and reports differences."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for row in rows:
        values = []
        for i in order:
            v = row[i]
            if isinstance(v, float):
                v = None if math.isnan(v) else v
                v = repr(v)
            values.append(str(v))
        out.append(tuple(values))
    return [names[i] for i in order], sorted(out)


def compare(df, con, sql):
    """None when equal, else a short text."""
    start = time.time()
    names, mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    cursor = con.execute(sql)
    other_names, theirs = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if names != other_names:
        return f"columns {names} / {other_names}", spent
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}; {mine[:2]} / {theirs[:2]}", spent
    different = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if different:
        return f"{len(different)} of {len(mine)} rows differ {names}: {different[0][0]} / {different[0][1]}", spent
    return None, spent


def main(folder: str, chosen: list[str]) -> None:
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sensorframe.hotGroupRows", os.environ.get("HOT", "2000000"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if chosen and name not in chosen and not any(c.endswith("*") and name.startswith(c[:-1]) for c in chosen):
            continue
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem, spent = compare(df, con, oracles[name])
                if problem is None and not df.columns:
                    problem = "no columns"
            else:
                rows = df.collect()
                problem = f"(rows only) {len(rows)}" if rows else "(rows only) EMPTY"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        if problem and not problem.startswith("(rows only) ") or problem == "(rows only) EMPTY":
            bad += 1
        print(f"{name:28s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
