"""What several test modules share."""

SMALL = "/root/testdata/sf0.001"


def canonical(v):
    if isinstance(v, float):
        return repr(v)
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return "[" + ",".join(canonical(x) for x in v) + "]"
    return repr(v)


def same_rows(df, con, sql):
    names = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in names) for r in df.collect())
    out = con.execute(sql)
    cols = [d[0] for d in out.description]
    assert sorted(cols) == names
    want = sorted(tuple(canonical(r[cols.index(c)]) for c in names) for r in out.fetchall())
    assert got == want
