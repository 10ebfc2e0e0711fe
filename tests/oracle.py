"""Runs a query and its SQL on the same tables and compares the rows."""

import os

import duckdb


def differences(spark, sf_dir, query, sql):
    connection = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    made = query(spark, sf_dir)
    columns = sorted(made.columns)
    found = connection.sql(sql)
    assert sorted(found.columns) == columns
    mine = sorted(repr([row[c] for c in columns]) for row in made.collect())
    theirs = sorted(repr([row[found.columns.index(c)] for c in columns]) for row in found.fetchall())
    return [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b][:3] or (len(mine) != len(theirs) and [(len(mine), len(theirs))]) or []
