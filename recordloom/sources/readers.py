"""Scans of contexts, artefacts and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonx import repair_json
from ..plans.config import DataSource


def read_source(spark: SparkSession, source: DataSource | None, schema: str | None = None) -> DataFrame:
    """A data source, with only its ``fields`` scanned. CSV types are inferred unless a schema is given, which saves a pass.

    A malformed JSON line raises. A data set of the ``huggingface`` format is a Parquet export, of which only files of the
    training split are read if any has ``train`` in its name.
    """
    if source is None:
        raise ValueError("no data source")
    if source.format == "csv":
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(source.uri)
    elif source.format == "jsonl":
        reader = spark.read.option("mode", "FAILFAST")
        df = (reader.schema(schema) if schema else reader).json(source.uri)
    elif source.format == "huggingface":
        df = _training(spark, source.uri)
    else:
        raise ValueError(f"unsupported format: {source.format}")
    return df.select(*source.fields) if source.fields else df


def _training(spark: SparkSession, uri: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    split = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "*train*"))
    return spark.read.parquet(*[s.getPath().toString() for s in split]) if split else spark.read.parquet(uri)


def objects_of_json(df: DataFrame, text: str, keep: list[str] | None = None, name: str = "object") -> DataFrame:
    """One row for each object of JSON text (an array, one object, or lines of objects), as a map of strings under ``name``.

    Text is repaired first; text that gives no object gives no row. Arrays and objects in cells stay JSON.
    """
    fixed = repair_json(F.col(text))
    as_array = F.when(F.startswith(fixed, F.lit("[")), fixed).otherwise(F.concat(F.lit("["), fixed, F.lit("]")))
    rows = df.select(*(keep or []), F.explode(F.from_json(as_array, "array<map<string,string>>")).alias(name))
    return rows.where(F.col(name).isNotNull())


def rows_of_json(df: DataFrame, text: str, columns: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row for each object of JSON text, see :func:`objects_of_json`; cells are strings. Without ``columns``, the names that any object has, in the order of the alphabet."""
    rows = objects_of_json(df, text, keep, "__object")
    if columns is None:
        names = rows.select(F.explode(F.map_keys("__object")).alias("n")).distinct().orderBy("n")  # as many as columns
        columns = [r["n"] for r in names.collect()]
    return rows.select(*(keep or []), *[F.try_element_at("__object", F.lit(c)).alias(c) for c in columns])


def names_agree(objects: DataFrame, key: str, columns: list[str], name: str = "object") -> DataFrame:
    """``key`` and ``ok``: whether all objects of a key together have exactly the names ``columns``."""
    have = F.array_distinct(F.flatten(F.collect_set(F.map_keys(name))))
    want = F.array(*map(F.lit, columns)).cast("array<string>")
    return objects.groupBy(key).agg(have.alias("__have")).select(key, ((F.size(F.array_except("__have", want)) == 0) & (F.size(F.array_except(want, "__have")) == 0)).alias("ok"))


def lines_of_json(df: DataFrame, text: str, schema: str, keep: list[str] | None = None) -> DataFrame:
    """One row for each line of JSON text."""
    lines = df.select(*(keep or []), F.explode(F.split(text, "\n")).alias("__line")).where(F.col("__line").rlike(r"\S"))
    return lines.select(*(keep or []), F.from_json("__line", schema).alias("__r")).select(*(keep or []), "__r.*")


def first_row(df: DataFrame) -> DataFrame:
    """The first row, to be shown; it costs a job only when it is."""
    return df.limit(1)


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(order).limit(n)


def unioned(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def column(name: str) -> Column:
    """A column whose name may have any characters."""
    return F.col(f"`{name}`")
