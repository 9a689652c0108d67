"""Small tables for the operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, start=0, source="s"):
    """Documents with the given texts, or (id, text) pairs."""
    pairs = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in pairs], DOCS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def duck(sql, **tables):
    """Rows of DuckDB SQL over pandas tables."""
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    return con.sql(sql).fetchall()


def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, and extra columns with names like those inside the operators."""
    from pyspark.sql import functions as F

    long = "word " * 60_000
    df = docs_of(spark, [(1, None), (2, ""), (3, " \n\n "), (4, "one short line"), (4, "one short line"), (None, "no id here"), (5, long), (6, "x" * 300_000)])
    df = df.union(spark.createDataFrame([(7, "null host", None, None, None)], DOCS))
    return df.withColumns({"__id": F.lit(1), "__bad": F.lit("x"), "__ns": F.lit(2), "__gone": F.lit(None).cast("string"), "h": F.lit(3), "key": F.lit("k"), "words": F.lit(1.5), "rep": F.lit(0)})
