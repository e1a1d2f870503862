"""Comparison helpers: order-insensitive equality of a Spark result and a DuckDB result."""

from __future__ import annotations

import math

TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else repr(round(v, 9)))
    return (1, repr(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def assert_same(df, rel, check_types=True):
    s_cols = df.columns
    d_cols = rel.columns
    assert sorted(s_cols) == sorted(d_cols), (s_cols, d_cols)
    if check_types:
        st = {f.name: TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
        dt = dict(zip(d_cols, [str(t) for t in rel.types]))
        assert st == dt, (st, dt)
    s_rows = rows_of(s_cols, [tuple(r) for r in df.collect()])
    d_rows = rows_of(d_cols, rel.fetchall())
    assert len(s_rows) == len(d_rows), (len(s_rows), len(d_rows))
    assert s_rows == d_rows, [x for x in s_rows if x not in d_rows][:3] + ["vs"] + [x for x in d_rows if x not in s_rows][:3]


def assert_same_order(df, rel):
    """Rows of both results in the order they come in."""
    cols = df.columns
    at = [rel.columns.index(c) for c in cols]
    got = [tuple(_norm(v) for v in r) for r in df.collect()]
    assert got == [tuple(_norm(r[i]) for i in at) for r in rel.fetchall()]
