"""A query's rows against its SQL in DuckDB."""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cells(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: None if v is None else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted([tuple(text(r[i]) for i in order) for r in rows], key=str)


def assert_same(df, con, sql: str) -> None:
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert cells(df.collect(), df.columns) == cells(found.fetchall(), found.columns)
