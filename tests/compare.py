"""Two results as sorted lists of rows, for any order of rows and columns."""


import pandas as pd


def _plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float) and v == int(v) if isinstance(v, float) and abs(v) < 1e15 else False:
        return int(v)
    if isinstance(v, float):
        return round(v, 5)
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(df):
    cols = sorted(df.columns)
    return sorted((str([_plain(v) for v in r]) for r in df[cols].astype(object).itertuples(index=False)))


def same(spark_df, duck_df):
    assert sorted(spark_df.columns) == sorted(duck_df.columns)
    assert rows(spark_df) == rows(duck_df)
