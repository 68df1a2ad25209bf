"""Comparison of a DataFrame with what DuckDB gives."""

from pyspark.sql import types as T


def same(spark_df, frame) -> bool:
    a, b = spark_df.toPandas(), frame
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    for f in spark_df.schema:
        if isinstance(f.dataType, T.IntegralType) and a[f.name].hasnans:  # with nulls they come as floats
            a[f.name] = a[f.name].astype("Int64")
            b[f.name] = b[f.name].astype("Int64")
    rows = lambda x: sorted(map(repr, x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None)))
    return rows(a) == rows(b)
