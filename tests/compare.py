"""Rows of a query against rows of its SQL, whatever their order."""

import math
from pathlib import Path

SF = "/root/testdata/sf0.001"


def views():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"create view {p.name.split('.')[0]} as select * from '{p}'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(x, 6) if isinstance(x, float) else x


def same(con, spark, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    result = con.execute(sql)
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == names
    order = [theirs.index(n) for n in names]
    ours = sorted((tuple(map(_cell, r)) for r in df.select(*names).collect()), key=repr)
    assert ours == sorted((tuple(_cell(r[i]) for i in order) for r in result.fetchall()), key=repr)
