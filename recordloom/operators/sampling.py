"""Row generators and samplers; all draws come from keys, so that runs repeat."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import digest, pick, u01, weighted_pick
from .common import with_row_index

Tags = list[tuple[str, list[str], list[float | None]]]


def mix_tags(slots: DataFrame, key: str, tags: Tags, seed: int = 0) -> DataFrame:
    """One independent weighted draw for each slot and tag. Tags are (name, values, weights); a missing weight is 1."""
    return slots.select("*", *[weighted_pick(values, weights, u01(seed, name, F.col(key))).alias(name) for name, values, weights in tags])


def combinations(tags: Tags) -> int:
    """How many different draws there are; none without tags."""
    return prod(len(set(values)) for _, values, _ in tags) if tags else 0


def sample_with_replacement(df: DataFrame, n: int, order: str, seed: int = 0) -> DataFrame:
    """``min(n, rows)`` draws of rows, with their number as ``slot``."""
    indexed = with_row_index(df, order, name="row_index")
    rows = indexed.count()
    slots = df.sparkSession.range(min(n, rows)).select(F.col("id").alias("slot"))
    return slots.withColumn("row_index", F.floor(u01(seed, "row", F.col("slot")) * F.lit(rows)).cast("long")).join(indexed, "row_index").drop("row_index")


def sample_without_replacement(df: DataFrame, n: int, key: str, seed: int = 0, cap: int | None = 50) -> DataFrame:
    """``n`` rows, or ``cap`` if that is less, in the order of a hash of their key; all if there are no more."""
    n = n if cap is None else min(n, cap)
    return df.orderBy(digest(seed, F.col(key)), key).limit(n)


def shuffle_rows(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows in the order of a hash of their key."""
    return df.orderBy(digest(seed, F.col(key)), key)


def few_shot(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """``k`` rows as lines of JSON, for a prompt."""
    return shuffle_rows(df, key, seed).limit(k).select(F.to_json(F.struct(*df.columns)).alias("line"))


def hierarchical_draw(slots: DataFrame, key: str, tree: dict[str, list[str]], levels: list[str], seed: int = 0) -> DataFrame:
    """A uniform domain, then one of its topics, then a level, for each slot."""
    domains = F.array(*map(F.lit, tree))
    topics = F.create_map(*[x for d, t in tree.items() for x in (F.lit(d), F.array(*map(F.lit, t)))])
    out = slots.withColumn("domain", pick(domains, u01(seed, "domain", F.col(key))))
    out = out.withColumn("topic", pick(F.element_at(topics, F.col("domain")), u01(seed, "topic", F.col(key))))
    return out.withColumn("complexity", pick(F.array(*map(F.lit, levels)), u01(seed, "complexity", F.col(key))))


#: Combinations of either half of the seeds, at most: numbers below it stay whole in 64 bits.
HALF = 1 << 61


def _halves(sizes: list[int]) -> int:
    """How many of the sizes make up the first half of the product: the halves are as equal as can be."""
    return min(range(len(sizes) + 1), key=lambda k: max(prod(sizes[:k]), prod(sizes[k:])))


def seed_permutations(spark: SparkSession, seeds: dict[str, list[str]], max_permutations: int = 10_000, seed: int = 0) -> DataFrame:
    """Up to ``max_permutations`` distinct tuples of the product of the seeds' values, numbered by ``id``.

    The numbers of tuples are those from 0 on, put through a keyed permutation of all numbers below the product: the
    product is neither built nor sorted, however large. A number is a pair of halves, (left, right); in each of four rounds
    a hash of one half is added to the other, which can be undone, so no two tuples are equal. Equal values of a seed count once.
    """
    lists = {name: list(dict.fromkeys(values)) for name, values in seeds.items()}
    sizes = [len(v) for v in lists.values()]
    total, cut = prod(sizes) if sizes else 0, _halves(sizes)
    a, b = max(1, prod(sizes[:cut])), max(1, prod(sizes[cut:]))
    if max(a, b) > HALF:
        raise ValueError(f"too many combinations: {total}")
    hashed = lambda k, half: F.conv(F.substring(digest(seed, str(k), half), 1, 15), 16, 10).cast("long")
    left, right = F.expr(f"id DIV {b}"), F.pmod(F.col("id"), F.lit(b))
    df = spark.range(min(max_permutations, total)).select("id", left.alias("__left"), right.alias("__right"))
    for k in range(4):
        half, other, n = ("__left", "__right", a) if k % 2 == 0 else ("__right", "__left", b)
        df = df.withColumn(half, F.pmod(F.col(half) + hashed(k, F.col(other)), F.lit(n)))
    columns = []
    for half, names in (("__left", list(lists)[:cut]), ("__right", list(lists)[cut:])):
        step = prod(len(lists[n]) for n in names)
        for name in names:
            step //= max(1, len(lists[name]))
            place = F.pmod(F.expr(f"`{half}` DIV {max(1, step)}"), F.lit(max(1, len(lists[name]))))
            columns.append(F.get(F.array(*map(F.lit, lists[name])), place.cast("int")).alias(name))
    return df.select("id", *columns)


def round_robin(slots: DataFrame, slot: str, contexts: DataFrame, order: str) -> DataFrame:
    """Each slot with the context whose place is the slot's number modulo the count of contexts."""
    indexed = with_row_index(contexts, order, name="context_index")
    n = indexed.count()
    return slots.withColumn("context_index", F.pmod(F.col(slot), F.lit(max(1, n))).cast("long")).join(indexed, "context_index").drop("context_index")


def empty_contexts(spark: SparkSession, n: int) -> DataFrame:
    """``n`` slots without any context."""
    return spark.range(n).select(F.col("id").alias("slot"))


def row_at(df: DataFrame, key: str, index: int | None = None, seed: int = 0) -> DataFrame:
    """The row whose key is ``index``, or one drawn row."""
    return shuffle_rows(df, key, seed).limit(1) if index is None else df.where(F.col(key) == index)


def subset(values: Column, k: Column | int, seed: int, key: Column) -> Column:
    """``k`` elements of an array, in drawn order."""
    from ..functions.hashing import shuffled

    return F.slice(shuffled(values, seed, key), 1, k)


def first_seeds(seeds: DataFrame, rows: int, per_seed: int) -> DataFrame:
    """As many of the numbered seeds (``id``) as it takes to make so many rows."""
    return seeds.where(F.col("id") < -(-rows // max(1, per_seed)))


def request_prefix(seed: int, *keys: Column) -> Column:
    """Ten characters that tell requests apart: of a hash, so that runs repeat."""
    return F.left(digest(seed, *keys), F.lit(10))
