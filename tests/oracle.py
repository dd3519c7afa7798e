"""Compare a query with its SQL on DuckDB: names, number of rows and values."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, dict):
        return [plain(v) for v in x.values()]
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((str([plain(r[k]) for k in order]) for r in data))


def compare(query, sql, spark, sf):
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    differ = [(a, b) for a, b in zip(got, want, strict=False) if a != b]
    assert len(got) == len(want) and not differ, (len(got), len(want), len(differ), differ[:3])
    return len(got)
