"""Quality analytics over flags, messages and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, with_row_index

GRAVEST = "fatal error warning convention refactor".split()


def value_counts(df: DataFrame, column: str, normalise: bool = False) -> DataFrame:
    """Counts of each value that isn't null, the most frequent first, or their shares."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    if not normalise:
        return counts.orderBy(F.desc("count"), column)
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, (F.col("count") / F.col("total")).alias("share"))


def group_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Means by key; a null key is no group."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("mean"))


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """Counts of ``a`` by the given values of ``b``, 0 where there are none."""
    kept = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return kept.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(f"n_{v}") for v in values])


def non_null_counts(df: DataFrame) -> DataFrame:
    """For each column, how many values aren't null."""
    return df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])


def first_category(message: Column, categories: list[str], ignore_case: bool = True) -> Column:
    """The first of the categories that the message contains, or null."""
    fold = F.lower if ignore_case else (lambda c: c)
    return F.coalesce(*[F.when(F.contains(fold(message), fold(F.lit(c))), F.lit(c)) for c in categories])


def severity(mask: Column) -> Column:
    """The gravest message kind in a bit mask."""
    out = None
    for k, name in enumerate(GRAVEST):
        bit = 1 << k
        on = mask.bitwiseAND(F.lit(bit)) > 0
        out = F.when(on, name) if out is None else out.when(on, name)
    return out


def by_severity(messages: Column) -> Column:
    """An array of structs with ``type``, gravest first, in their order."""
    order = F.array(*map(F.lit, GRAVEST))
    tagged = F.transform(messages, lambda m, i: F.struct(F.array_position(order, m["type"]).alias("k"), i.alias("i"), m.alias("m")))
    return F.transform(F.array_sort(tagged), lambda x: x["m"])


def running_counts(df: DataFrame, order: str, valid: Column, partition: str | None = None) -> DataFrame:
    """Successes and failures so far; with a partition, within each.

    Without one, rows are range-partitioned by the order and counted within each part; the counts of earlier parts, a table
    as long as there are parts, are added.
    """
    good, bad = F.count_if(valid), F.count_if(~F.coalesce(valid, F.lit(False)))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if partition:
        window = so_far(Window.partitionBy(partition).orderBy(order))
        return df.withColumn("successes", good.over(window)).withColumn("failures", bad.over(window))
    placed = saved(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()))
    window = so_far(Window.partitionBy("__part").orderBy("__at"))
    parts = placed.groupBy("__part").agg(good.alias("good"), bad.alias("bad"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # of parts, not of rows
    before = parts.select("__part", F.coalesce(F.sum("good").over(earlier), F.lit(0)).alias("__good"), F.coalesce(F.sum("bad").over(earlier), F.lit(0)).alias("__bad"))
    counted = placed.withColumn("successes", good.over(window)).withColumn("failures", bad.over(window)).join(F.broadcast(before), "__part")
    return counted.withColumns({"successes": F.col("successes") + F.col("__good"), "failures": F.col("failures") + F.col("__bad")}).select(*df.columns, "successes", "failures")


def longest_name(values: Column) -> Column:
    """Characters of the longest key of a map, 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.map_keys(values), F.char_length)), F.lit(0))


def by_message(messages: Column) -> Column:
    """The distinct codes of an array of structs with ``code``, sorted."""
    return F.array_sort(F.array_distinct(F.transform(messages, lambda m: m["code"])))


def code_sets(df: DataFrame, key: str, code: str) -> DataFrame:
    """The distinct codes of each key, sorted, as ``codes``; nulls are left out."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(code)).alias("codes"))


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows in the given order."""
    return df.orderBy(F.desc(order)).limit(n)


def rows_between(df: DataFrame, order: str, start: int, stop: int) -> DataFrame:
    """The rows at places ``start`` to ``stop`` - 1 in the given order."""
    return with_row_index(df, order, name="__row").where(F.col("__row").between(start, stop - 1)).drop("__row")


def byte_counts(df: DataFrame, key: str, read: list[Column], written: list[Column], output: Column) -> DataFrame:
    """Bytes read, written and put out by key, and (read + written) / out, 0 where nothing came out."""
    size = lambda columns: sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in columns), F.lit(0)).cast("long")
    sums = df.groupBy(key).agg(F.sum(size(read)).alias("bytes_read"), F.sum(size(written)).alias("bytes_written"), F.sum(size([output])).alias("bytes_out"))
    return sums.withColumn("overhead", F.coalesce((F.col("bytes_read") + F.col("bytes_written")) / F.nullif(F.col("bytes_out"), F.lit(0)), F.lit(0.0)))


def joined_text(df: DataFrame, key: str, order: str, part: Column, separator: str) -> DataFrame:
    """Parts of each key joined in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    return df.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["p"]), separator).alias("joined"))


def usage(df: DataFrame, by: str, prompt: str, answer: str) -> DataFrame:
    """Calls, calls without an answer, and bytes of prompts and answers, by model or role; a null prompt was no call."""
    called = df.where(F.col(prompt).isNotNull())
    size = lambda c: F.sum(F.octet_length(F.coalesce(F.col(c), F.lit(""))).cast("long"))
    return called.groupBy(by).agg(F.count("*").alias("calls"), F.count_if(F.coalesce(F.col(answer), F.lit("")) == "").alias("empty"), size(prompt).alias("prompt_bytes"), size(answer).alias("answer_bytes"))
