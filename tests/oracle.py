"""Comparison of a query with its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)

    def rows(names, values):
        at = [list(names).index(c) for c in columns]
        return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in values), key=repr)

    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
