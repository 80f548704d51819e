"""Rows of Spark and DuckDB as sorted text, so that they can be compared whatever their order."""

from decimal import Decimal


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.6f}".rstrip("0").rstrip(".").replace("-0", "0") if float(v) == 0 else f"{float(v):.6f}"
    return str(v)


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


def check(df, con, sql):
    got = rows([tuple(r) for r in df.collect()], df.columns)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    want = rows(out.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert got == want
