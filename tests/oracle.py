"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_value(y) for y in x)
    if hasattr(x, "item") and not isinstance(x, (str, bytes)):
        return _value(x.item())
    return int(x) if isinstance(x, bool) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows([c[0] for c in cur.description], cur.fetchall())
    assert mine[0] == theirs[0], (mine[0], theirs[0])
    only_mine = [r for r in mine[1] if r not in set(theirs[1])][:3] if mine[1] != theirs[1] else []
    only_theirs = [r for r in theirs[1] if r not in set(mine[1])][:3] if mine[1] != theirs[1] else []
    assert mine[1] == theirs[1], (len(mine[1]), len(theirs[1]), only_mine, only_theirs)
    return len(mine[1])
