"""Algebra of tags and of proposed seed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small


def keep_first(df: DataFrame, key: Column | str, *order: str) -> DataFrame:
    """The first row of each key in the given order; null keys count as one key. Each task keeps its first rows before any are sent."""
    first = df.groupBy(F.col(key) if isinstance(key, str) else key).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("__first"))
    return first.select(*[F.col(f"__first.`{c}`") for c in df.columns])


def add_values(tags: DataFrame, new: DataFrame) -> DataFrame:
    """``tags`` (``name, value, weight, pos``) with those of ``new`` whose value its tag lacks, in any case; ``added`` marks them.

    Tags are matched by name in any case. Of equal new values the first counts.
    """
    return _added(tags, new, "name", "value")


def _added(old: DataFrame, new: DataFrame, *names: str) -> DataFrame:
    """Both, with ``added``; of the new rows the first of each key, in any case, that no old row has. Nulls are equal."""
    keys = F.struct(*[F.lower(n).alias(n) for n in names])
    fresh = keep_first(new.withColumn("__key", keys), "__key", "pos")
    have = old.select(keys.alias("__had")).distinct()
    fresh = fresh.join(have, F.col("__key").eqNullSafe(F.col("__had")), "left_anti").drop("__key")
    return old.withColumn("added", F.lit(False)).unionByName(fresh.withColumn("added", F.lit(True)))


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """``tags`` (one row for each, ``name, pos``) with the new ones whose name isn't there in any case; ``added`` marks them."""
    return _added(tags, new, "name")


def diversity(tags: DataFrame) -> DataFrame:
    """The product over tags of their counts of distinct values; 0 without tags."""
    sizes = tags.groupBy("name").agg(F.count_distinct("value").alias("n"))
    return sizes.agg(F.coalesce(F.round(F.product(F.col("n").cast("double"))), F.lit(0.0)).alias("diversity"))


def new_columns(proposed: DataFrame, existing: DataFrame, key: str = "column_name") -> DataFrame:
    """Proposed columns that the sample doesn't have yet."""
    return proposed.join(small(existing.select(key).distinct()), key, "left_anti")


def with_tags(models: DataFrame, required: list[str]) -> DataFrame:
    """Models that carry all required tags."""
    return models.where(F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.col("tags"))) == 0)


def rank_top(proposed: DataFrame, n: int, quality: str = "quality_rank", *order: str) -> DataFrame:
    """The ``n`` best, by integer quality (0 if missing or not a number), then in the given order."""
    return proposed.withColumn("__q", F.coalesce(F.expr(f"try_cast({quality} AS int)"), F.lit(0))).orderBy(F.desc("__q"), *order).limit(n).drop("__q")


def proposals(batches: DataFrame, existing: DataFrame, n: int) -> DataFrame:
    """Crowd-sourced columns: the union of all workers' (``worker, pos, column_name, quality_rank``), each name once, without the sample's own, the ``n`` best."""
    once = keep_first(batches, "column_name", "worker", "pos")
    return rank_top(new_columns(once, existing), n, "quality_rank", "worker", "pos")


def truncated(tags: Column, k: int) -> Column:
    """The first ``k`` tags of an array; all if there are no more."""
    return F.slice(tags, 1, k) if k > 0 else F.slice(tags, 1, 0)


def name_maps(columns: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Maps from column names to scrubbed ones, and back."""
    forward = scrub_names(columns)
    return forward, {new: old for old, new in forward.items()}


def restored(df: DataFrame, original: list[str]) -> DataFrame:
    """Scrubbed columns under their original names again; others keep theirs."""
    _, back = name_maps(original)
    return df.toDF(*[back.get(c, c) for c in df.columns])


def symmetric_difference(a: Column, b: Column) -> Column:
    """Elements in one of two arrays only."""
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def zip_rename(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns renamed by position; the counts must agree."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def scrub_names(names: list[str]) -> dict[str, str]:
    """Column names as snake case that starts with a letter; equal results get a number."""
    import re

    out: dict[str, str] = {}
    used: set[str] = set()
    for name in names:
        new = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "column"
        new = f"col_{new}" if new[0].isdigit() else new
        base, k = new, 2
        while new in used:
            new, k = f"{base}_{k}", k + 1
        used.add(new)
        out[name] = new
    return out
