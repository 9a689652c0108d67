"""Draws that depend on keys alone: the same on every run, executor and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, *keys: Column | str) -> Column:
    """Hex digest of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.lit(k) if isinstance(k, str) else k.cast("string") for k in keys]))


def u01(seed: int | str, *keys: Column | str) -> Column:
    """A number in [0, 1) from the seed and the keys."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(values: Column, u: Column) -> Column:
    """A uniform pick from an array, by a number in [0, 1)."""
    return F.get(values, F.floor(u * F.size(values)).cast("int"))


def weighted_pick(values: list[str], weights: list[float | None], u: Column) -> Column:
    """A weighted pick; a weight that isn't given is 1, and weights need not sum to 1."""
    if not values:
        raise ValueError("no values to pick from")
    full = [1.0 if w is None else float(w) for w in weights]
    total, running, branches = sum(full), 0.0, None
    for value, weight in zip(values[:-1], full[:-1], strict=True):
        running += weight
        branches = (F.when if branches is None else branches.when)(u * F.lit(total) < F.lit(running), F.lit(value))
    return F.lit(values[-1]) if branches is None else branches.otherwise(F.lit(values[-1]))


def integer(low: int, high: int, u: Column) -> Column:
    """An integer in [low, high)."""
    return (F.lit(low) + F.floor(u * F.lit(high - low))).cast("int")


def gate(rate: float, seed: int | str, *keys: Column | str) -> Column:
    """True with probability ``rate``."""
    return u01(seed, *keys) < F.lit(float(rate))


def shuffled(values: Column, seed: int | str, key: Column) -> Column:
    """An array in an order drawn for ``key``."""
    tagged = F.transform(values, lambda v: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), v.cast("string"))).alias("h"), v.alias("v")))
    return F.transform(F.array_sort(tagged), lambda x: x["v"])
