"""Sinks: lines of JSON, CSV, JSON artefacts and text."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import asdict, is_dataclass
from itertools import count
from pathlib import Path
from typing import Any

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _claimed(system: JavaObject, mark: JavaObject) -> bool:
    """Whether the file ``mark`` was made just now, by this caller alone."""
    if system.getScheme() == "file":
        try:
            os.makedirs(os.path.dirname(mark.toUri().getPath()) or ".", exist_ok=True)
            os.close(os.open(mark.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        system.create(mark, False).close()
    except Py4JJavaError:
        if system.exists(mark):
            return False
        raise
    return True


def _names(base: str) -> Iterator[str]:
    stem, dot, ext = base.rpartition(".") if "." in Path(base).name else (base, "", "")
    yield base
    for k in count(1):
        yield f"{stem}_{k}{dot}{ext}"


def unused_path(spark: SparkSession, base: str) -> str:
    """``base``, or ``base_1``, ``base_2``, ... before the extension: the first that isn't there."""
    return next(p for p in _names(base) if not _system(spark, p)[0].exists(_system(spark, p)[1]))


def write_jsonl(df: DataFrame, base: str) -> str:
    """Write rows as lines of JSON under the first path of :func:`unused_path` that nobody else is writing to; the path.

    A path is claimed by a file beside it, which file systems (but for object stores) make for one only, and which goes
    when all is written.
    """
    spark = df.sparkSession
    for path in _names(base):
        folder, _, name = path.rpartition("/")
        claim = f"{folder}/.{name}.claim" if folder else f".{name}.claim"
        system, mark = _system(spark, claim)
        if system.exists(_system(spark, path)[1]) or not _claimed(system, mark):
            continue
        try:
            if not system.exists(_system(spark, path)[1]):
                df.write.mode("errorifexists").json(path)
                return path
        finally:
            system.delete(mark, False)
    raise AssertionError


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write one batch of a growing artefact, as lines of JSON; a batch that is written again replaces itself, and no other is rewritten."""
    df.write.mode("overwrite").json(f"{path}/batch={batch}")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of an artefact, with their number as ``batch``."""
    return spark.read.schema(f"{schema}, batch int").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Write rows as CSV with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def save_artifacts(df: DataFrame, path: str, config: Any, metadata: dict | None = None) -> None:
    """Write a result with its settings and metadata."""
    df.write.mode("overwrite").json(f"{path}/dataset")
    spark = df.sparkSession
    notes = {"config": asdict(config) if is_dataclass(config) else dict(config), "metadata": metadata}
    spark.createDataFrame([(json.dumps(notes),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/notes")


def load_artifacts(spark: SparkSession, path: str) -> tuple[DataFrame, dict, dict | None]:
    """A saved result, its settings and metadata."""
    notes = json.loads(spark.read.text(f"{path}/notes").first()["value"])
    return spark.read.json(f"{path}/dataset"), notes["config"], notes["metadata"]


def to_jsonl_text(df: DataFrame, order: str) -> DataFrame:
    """All rows as one text of JSON lines, in order: for tables that fit into a prompt."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.to_json(F.struct(*df.columns)).alias("j"))))
    return df.agg(F.array_join(F.transform(items, lambda x: x["j"]), "\n").alias("jsonl"))


def records(df: DataFrame) -> Iterator[dict]:
    """Rows one by one; only one partition is on the driver at a time."""
    return (row.asDict(recursive=True) for row in df.toLocalIterator())


def show(df: DataFrame, n: int = 1) -> None:
    """Print rows, a line for each field."""
    df.show(n, truncate=False, vertical=True)


def rendered(df: DataFrame, *columns: str, width: int = 0) -> Column:
    """A row for display: a line for each column, its name as a title and its value, nulls as a dash."""
    from ..functions.text import title

    names = columns or tuple(df.columns)
    return F.array_join(F.array(*[F.concat(title(F.lit(c), width), F.lit(": "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-"))) for c in names]), "\n")
