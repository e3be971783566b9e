"""Shared by the tests."""

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    """Rows as comparable text, with columns in the order of their names."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: "NULL" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


def same_as_sql(duck, df, sql):
    got = duck.sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(got.fetchall(), got.columns)
