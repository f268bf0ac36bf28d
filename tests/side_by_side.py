"""Runs a query and its SQL on the same tables."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def same(spark, query, sql):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    df = query(spark, SF)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)

    def norm(rows, columns):
        at = sorted(range(len(columns)), key=lambda k: columns[k])
        return sorted(repr(tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in at)) for r in rows)

    assert norm(df.collect(), df.columns) == norm(rel.fetchall(), rel.columns)
