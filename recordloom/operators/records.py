"""Checks and merges of generated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_field(fields: list[str]) -> Column:
    """The first field, in order, that is null; null if none is."""
    return F.coalesce(*[F.when(F.col(f"`{f}`").isNull(), F.lit(f)) for f in fields], F.lit(None).cast("string"))


def well_formed(record: Column, required: list[str]) -> Column:
    """Whether a map has all required names and no blank value."""
    names = F.array(*map(F.lit, required)).cast("array<string>")
    return (F.size(F.array_except(names, F.map_keys(record))) == 0) & F.forall(F.map_values(record), lambda v: F.coalesce(v.rlike(r"\S"), F.lit(False)))


def passes(response: Column) -> Column:
    """A judge's verdict: all but a response with FAIL."""
    return ~F.contains(response, F.lit("FAIL"))


def verdict(response: Column) -> Column:
    """A field validator's error: the response if it holds FAIL, else null."""
    return F.when(F.contains(response, F.lit("FAIL")), F.regexp_replace(response, r"^\s+|\s+$", ""))


def merged(df: DataFrame, context: list[str], record: dict[str, Column]) -> DataFrame:
    """Context columns and record fields; a field replaces a context column of its name."""
    kept = [F.col(f"`{c}`") for c in context if c not in record]
    return df.select(*kept, *[c.alias(n) for n, c in record.items()])


def counters(df: DataFrame, valid: Column) -> DataFrame:
    """Successes and failures."""
    return df.agg(F.count_if(valid).alias("successes"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("failures"))


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """What a small table has for a key, or the default."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def first_verdict(*checks: tuple[Column, str], default: str) -> Column:
    """The name of the first check that holds, or the default."""
    return F.coalesce(*[F.when(check, name) for check, name in checks], F.lit(default))


def overwritten(old: Column, *changes: tuple[Column, Column]) -> Column:
    """A column with other values where a condition holds, the first that does; a null condition changes nothing."""
    out = None
    for condition, value in changes:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return old if out is None else out.otherwise(old)


def flagged(df: DataFrame, flag: Column, *wanted: Column) -> DataFrame:
    """Rows whose flag is known and for which all of ``wanted`` hold, with the flag as ``flag``."""
    out = df.where(flag.isNotNull())
    for condition in wanted:
        out = out.where(condition)
    return out.withColumn("flag", flag)


def with_seeds(generated: DataFrame, seeds: DataFrame, key: str = "id") -> DataFrame:
    """Generated rows with the seeds that they were made from, without the key; rows of unknown seeds are dropped."""
    return generated.join(seeds, key).drop(key)
