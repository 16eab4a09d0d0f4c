"""Compares a query's rows with its SQL's, over the same Parquet tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows_of(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


def same(spark, connection, query, sql, sf_dir):
    df = query(spark, sf_dir)
    found = connection.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(found.fetchall(), found.columns)
