"""Comparing a Spark result with DuckDB's, column by column, in any order of rows."""


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(shown, v))
    return str(v)


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(tuple(shown(r[i]) for i in at) for r in rows)


def assert_same(df, result):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert got == want
