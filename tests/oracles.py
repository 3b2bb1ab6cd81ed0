"""Comparing a registered query with its DuckDB SQL."""

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


def differences(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf_dir}/{f}')")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(",".join(plain(r[c]) for c in columns) for r in df.collect())
    found = con.sql(sql)
    names = list(found.columns)
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(",".join(plain(r[i]) for i in order) for r in found.fetchall())
    return [x for x in got if x not in set(expected)][:3], [x for x in expected if x not in set(got)][:3], len(got) - len(expected)
