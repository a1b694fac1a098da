"""Comparison of DataFrames as sorted rows."""


def as_rows(df, *by):
    own = sorted(df.columns)
    rows = [tuple(r[c] for c in own) for r in df.collect()]
    return sorted(rows, key=lambda r: [(x is not None, str(type(x)), x) for x in r])
