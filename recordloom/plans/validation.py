"""Comparison of code checks: one pair of columns for each method, combined policies, and times."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code
from ..operators.common import spread

#: Methods for Python: a column of code to a column of errors, null if there are none.
PYTHON: dict[str, Callable[[Column], Column]] = {
    "ast": code.python_error,
    "names": code.lint,
    # What can't be parsed, undefined names and left-out code are errors; warnings alone are fine.
    "policy": lambda c: F.when(code.lint(c).rlike(r"(?m)^error"), code.lint(c)),
}


def python_checks(df: DataFrame, column: str, methods: dict[str, Callable[[Column], Column]] = PYTHON) -> DataFrame:
    """``is_valid_python_with_<method>`` and ``<method>_error`` for each method."""
    df = spread(df)
    for name, check in methods.items():
        df = df.withColumn(f"{name}_error", check(F.col(column))).withColumn(f"is_valid_python_with_{name}", F.col(f"{name}_error").isNull())
    return df


def sql_checks(df: DataFrame, schema: str, query: str) -> DataFrame:
    """Validity of schemas, queries and both, and messages, by the parser and by running them in SQLite.

    A query runs after its schema, so where the schema fails the pair does.
    """
    spark = df.sparkSession
    df = code.sql_errors(spark, df, schema).withColumnRenamed("error", "__schema")
    df = code.sql_errors(spark, df, query).withColumnRenamed("error", "__query")
    df = df.withColumns({"is_valid_schema_with_parser": F.col("__schema").isNull(), "is_valid_query_with_parser": F.col("__query").isNull(), "error_msgs_parser": code.pair_error(F.col("__schema"), F.col("__query"))})
    df = df.withColumn("is_valid_sql_with_parser", F.col("is_valid_schema_with_parser") & F.col("is_valid_query_with_parser")).drop("__schema", "__query")
    df = df.withColumn("__s", code.run_in_sqlite(F.col(schema), F.lit(""))).withColumn("__b", code.run_in_sqlite(F.col(schema), F.col(query)))
    df = df.withColumns({"is_valid_schema_with_sqlite": F.col("__s")["ok"], "is_valid_sql_with_sqlite": F.col("__b")["ok"]})
    query_error = F.when(F.col("__s")["ok"], F.col("__b")["error"])
    df = df.withColumns({"is_valid_query_with_sqlite": F.when(F.col("__s")["ok"], F.col("__b")["ok"]), "error_msgs_sqlite": code.pair_error(F.col("__s")["error"], query_error)})
    return df.drop("__s", "__b")


def only(dialect: Column, name: str, check: Column) -> Column:
    """A check's result in rows of one dialect, written in any case and with any spaces; null in others."""
    return F.when(F.lower(F.replace(dialect, F.lit(" "), F.lit(""))) == name, check)


def seconds(df: DataFrame) -> float:
    """How long all rows take, without writing them."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began
