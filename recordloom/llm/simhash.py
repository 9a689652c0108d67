"""SimHash near-duplicates: a tiled exact comparison of 256-bit signatures with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, by_id, fresh, like, mix, need, saved, slices, with_value, word_hashes

#: Bits in which near-duplicates may differ, of 256.
RADIUS = 40
#: 64-bit words of a signature, and how many of them the tiles compare first. No word can differ in more bits than all of
#: them, so signatures that already differ in more than the radius there are out, and no near pair is.
WORDS, GATE = 4, 2
#: Signatures up to which all pairs are compared; beyond, those that agree in a part and nearly so in its group (``groups_of``).
ALL_PAIRS = 1 << 14
#: Signatures from which groups have three parts, not two: fewer pairs, more and smaller buckets.
MANY = 2_000_000
#: Parts at least, so that one has ``PART_BITS`` bits at most.
LEAST_PARTS, PART_BITS = 32, 8
#: Signatures in a piece of a cell at most; a task compares one piece with itself or two pieces. Rows of exploded signatures in a task, and tasks at least.
BLOCK, TASK_ROWS, TASKS = 1 << 18, 200_000, 64
TILE_A, TILE_B = 32, 4096
#: Signatures in a bucket at least, on average; rows of a bucket that are compared at once; near pairs that are kept before groups are joined.
FILL, SLAB, PENDING = 64, 256, 4096
#: Edges up to which one task joins them to groups; beyond, all tasks do it in rounds.
LOCAL_EDGES = 4_000_000

#: The bits of a byte as eight counters of one byte each.
_LANES = np.array([int.from_bytes(bytes(v >> (7 - i) & 1 for i in range(8)), "little") for v in range(256)], U64)


def signatures_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of each text over its distinct words, as rows of four 64-bit numbers, and the count of distinct words."""
    hashes, owner = word_hashes(texts)
    order = np.lexsort((hashes, owner)) if len(texts) >= 1 << 16 else None
    if order is None:
        keys = np.sort((owner.astype(U64) << U64(48)) | (hashes >> U64(16)))
    else:
        keys = (owner[order].astype(U64) << U64(48)) | (hashes[order] >> U64(16))
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    owner = (keys >> U64(48)).astype(np.int64)
    word = keys & U64((1 << 48) - 1)
    ones = np.zeros((len(texts), 64 * WORDS), np.int32)
    step = 1 << 14
    for a in range(0, len(word), step):
        w, o = word[a : a + step], owner[a : a + step]
        with np.errstate(over="ignore"):
            wide = np.stack([mix(w + U64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(WORDS)], axis=1)
        runs = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        begins = np.unique(np.concatenate((runs, np.arange(0, len(w), 255))))  # a counter holds up to 255
        sums = np.add.reduceat(_LANES[wide.view(np.uint8)], begins, axis=0).view(np.uint8)
        heads = np.searchsorted(begins, runs)
        ones[o[runs]] += np.add.reduceat(sums, heads, axis=0, dtype=np.int32)
    n = np.bincount(owner, minlength=len(texts))
    return np.packbits(2 * ones > n[:, None], axis=1).view(U64), n


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the four words ``s0`` to ``s3`` of the signature.

    Rows without ``doc_id``, without text or without any word have no signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sig, n = signatures_of(batch.column(1).to_pylist())
            there = n > 0
            sig = sig[there]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(there)), *(pa.array(sig[:, k].view(np.int64)) for k in range(WORDS))],
                names=["doc_id", *(f"s{k}" for k in range(WORDS))],
            )

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, s0 long, s1 long, s2 long, s3 long")


class Groups:
    """Numbers from 0 to n-1 in groups; ``of[i]`` is the least number in i's group."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        """Put u[k] and v[k] into one group, for each k."""
        while True:
            u, v = self.of[u], self.of[v]
            differ = u != v
            if not differ.any():
                return
            u, v = u[differ], v[differ]
            into = np.arange(len(self.of))
            np.minimum.at(into, np.maximum(u, v), np.minimum(u, v))  # each group with a lesser neighbour goes into the least
            while ((further := into[into]) != into).any():
                into = further
            self.of = into[self.of]


@lru_cache(1)
def _buffers() -> tuple[np.ndarray, ...]:
    size = TILE_A * TILE_B
    return np.empty(size, U64), np.empty(size, np.uint8), np.empty(size, np.uint8), np.zeros(size + 8, bool)


def near_pairs(a: np.ndarray, pa_: np.ndarray | None, b: np.ndarray, pb: np.ndarray | None, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs of signatures that differ in at most ``radius`` bits, tile by tile.

    If both sides are sorted by their population counts, ``pa_`` and ``pb``, tile pairs whose counts differ beyond the
    radius are skipped. The first ``GATE`` words are compared for all pairs of a tile, the others where these don't exceed
    the radius by themselves. same: b begins with a, and each pair of these comes once.
    """
    a_words, b_words = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    differ, count, more, near = _buffers()
    step = max(TILE_A, TILE_A * TILE_B // max(len(b), 1))
    for i in range(0, len(a), step):
        i_to = min(i + step, len(a))
        for j in range(i - i % TILE_B if same else 0, len(b), TILE_B):
            j_to = min(j + TILE_B, len(b))
            if pa_ is not None and pb is not None:
                if pb[j] - pa_[i_to - 1] > radius:
                    break
                if pa_[i] - pb[j_to - 1] > radius:
                    continue
            wide = j_to - j
            n = (i_to - i) * wide
            x, far, extra = (buffer[:n].reshape(-1, wide) for buffer in (differ, count, more))
            for k in range(GATE):
                np.bitwise_xor(a_words[k, i:i_to, None], b_words[k, None, j:j_to], out=x)
                np.bitwise_count(x, out=extra if k else far)
                if k:
                    far += extra
            near[n : n + 8] = False
            np.less_equal(far.ravel(), radius, out=near[:n])
            eights = np.flatnonzero(near[: n + -n % 8].view(U64))
            if not len(eights):
                continue
            hit = (eights[:, None] * 8 + np.arange(8)).ravel()
            hit = hit[near[hit]]
            u, v = hit // wide + i, hit % wide + j
            if same:
                u, v = u[u < v], v[u < v]
            rest = np.zeros(len(u), np.int32)
            for k in range(WORDS):
                rest += np.bitwise_count(a_words[k, u] ^ b_words[k, v])
            if (rest <= radius).any():
                yield u[rest <= radius], v[rest <= radius]


class Part(NamedTuple):
    """Some bits of a signature next to each other."""

    word: int
    shift: int
    bits: int

    def of(self, words: np.ndarray) -> np.ndarray:
        """The values of this part, from the words of signatures, a row for each word."""
        return ((words[self.word] >> U64(self.shift)) & U64((1 << self.bits) - 1)).astype(np.int64)


def groups_of(radius: int, group: int) -> list[list[Part]]:
    """The bits of signatures in more parts than ``radius``, in groups of ``group`` parts; one part without bits if that is 0.

    Two signatures that differ in at most ``radius`` bits differ in fewer bits than parts in one group at least: else they
    would differ in as many bits as there are parts. In that group they agree in one part. So no near pair is lost if
    those pairs are compared that agree in a part and differ in fewer bits of its group than this has parts.
    """
    if not group:
        return [[Part(0, 0, 0)]]
    n = max(radius + 1, LEAST_PARTS)
    parts = []
    for word in range(WORDS):
        pieces = n // WORDS + (word < n % WORDS)
        parts += [Part(word, a, b - a) for a, b in pairwise(64 * i // pieces for i in range(pieces + 1))]
    parts.sort(key=lambda p: -p.bits)
    n_groups = -(-n // group)
    short = n_groups * group - n  # groups with a part less, the longest ones
    lone, rest = parts[: short * (group - 1)], parts[short * (group - 1) :]
    return [lone[i::short] for i in range(short)] + [rest[i :: n_groups - short] for i in range(n_groups - short)]


@lru_cache(1 << 10)
def _masks(bits: tuple[int, ...], before: int, drop: int) -> np.ndarray:
    """The differences in parts of ``bits`` bits of at most as many bits as parts, in each of the first ``before`` parts some; without their lowest ``drop`` bits."""
    masks = np.arange(1 << sum(bits))
    there = np.bitwise_count(masks) <= len(bits)
    for k in range(before):
        there &= (masks >> sum(bits[:k])) % (1 << bits[k]) != 0
    return np.unique(masks[there] >> drop)


def compare(cell: pa.Table, groups: list[list[Part]], radius: int) -> pa.Table:
    """A spanning forest, as rows (u, v) with v < u, of the near pairs that one cell has to compare.

    A cell has signatures that agree in a part. They are in buckets by the other parts of its group, and buckets are compared
    that differ there in fewer bits than the group has parts; not those that agree in a part before: another cell has them.
    Once rows of a bucket are in one group of documents, they aren't compared with others of it.
    """
    number = cell.column("cell")[0].as_py()
    whole = number >> 20 & (1 << 20) - 1 == number & (1 << 20) - 1
    group, part = [(g, k) for g in groups for k in range(len(g))][number >> 48]
    others = group[:part] + group[part + 1 :]
    rep, second = cell.column("rep").to_numpy(), cell.column("second").to_numpy()
    words = np.stack([cell.column(f"s{k}").to_numpy().view(U64) for k in range(WORDS)])
    key, bits = np.zeros(len(rep), np.int64), tuple(p.bits for p in others)
    for k, p in enumerate(others):
        key |= p.of(words) << sum(bits[:k])
    kept = min(sum(bits), max(0, (len(rep) // FILL).bit_length() - 1))  # with fewer bits, buckets are fuller and more are compared
    key >>= sum(bits) - kept
    masks = _masks(bits, part, sum(bits) - kept)
    order = np.lexsort((key, second))
    rep, key, words = rep[order], key[order], np.ascontiguousarray(words[:, order])
    named = np.sort(rep)  # groups are named by the least document
    place = np.searchsorted(named, rep)
    one = len(rep) - int(second.sum())
    every = np.arange((1 << kept) + 1)
    starts = np.searchsorted(key[:one], every)
    across = starts if whole else one + np.searchsorted(key[one:], every)
    own = whole and not masks[0]
    index = np.arange(len(rep))
    found, pending, waiting, dense = Groups(len(rep)), [], 0, False
    for value in np.flatnonzero(starts[1:] > starts[:-1]):
        near = value ^ masks
        if whole:
            near = near[near > value]
        begin, end = across[near], across[near + 1]
        there = begin < end
        left = index[starts[value] : starts[value + 1]]
        if not there.any() and not (own and len(left) > 1):
            continue
        columns = np.concatenate([index[:0], *(index[i:j] for i, j in zip(begin[there].tolist(), end[there].tolist(), strict=True))])
        while len(left):
            rows, left = left[:SLAB], left[SLAB:]
            to = np.concatenate((left, columns)) if own else columns
            if dense:
                of = found.of[place[rows]]
                if (of == of[0]).all():
                    to = to[found.of[place[to]] != of[0]]
            if own:
                to = np.concatenate((rows, to))
            for u, v in near_pairs(words[:, rows].T, None, words[:, to].T, None, radius, own):
                pending.append((rows[u], to[v]))
                waiting += len(u)
            if waiting >= PENDING:
                found.join(*(place[np.concatenate(x)] for x in zip(*pending, strict=True)))
                pending, waiting, dense = [], 0, True
                left = left[np.argsort(found.of[place[left]], kind="stable")]
    if pending:
        found.join(*(place[np.concatenate(x)] for x in zip(*pending, strict=True)))
    moved = np.flatnonzero(found.of != np.arange(len(rep)))
    return pa.table({"u": named[moved], "v": named[found.of[moved]]})


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``node`` and ``root``, the least node of its group, for each node of ``edges`` (u, v) that is not a root itself.

    Up to ``local_edges`` edges one task joins them; beyond, large-star and small-star rounds over all tasks do.
    """
    edges = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    total = edges.count()
    if total <= local_edges:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            every = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype="int64"), *frames])
            nodes, index = np.unique(every[["u", "v"]].to_numpy(), return_inverse=True)
            index = index.reshape(-1, 2)
            groups = Groups(len(nodes))
            groups.join(index[:, 0], index[:, 1])
            moved = np.flatnonzero(groups.of != np.arange(len(nodes)))
            yield pd.DataFrame({"node": nodes[moved], "root": nodes[groups.of[moved]]})

        return edges.coalesce(1).mapInPandas(run, "node long, root long")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m")).select("u", "n", F.least("u", "m").alias("value"))
        large = with_value(both, least, ["u"], "v", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("value").alias("v")).distinct()
        low = saved(large.where("u > v"))
        least = low.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("value"))
        small = with_value(low, least, ["u"], "v", low.count()).select(F.col("v").alias("u"), F.col("value").alias("v")).where("u <> v")
        now = saved(small.union(least.select("u", F.col("value").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        total = now.count()
        if now.exceptAll(edges).isEmpty() and edges.exceptAll(now).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = now


def cells_of(unique: DataFrame, groups: list[list[Part]], block: int) -> DataFrame:
    """``unique`` once for each part, and more often where more than ``block`` signatures agree in one: ``cell`` is the part, its value and the two pieces compared, ``second`` whether a row is of the second."""
    parts = [p for g in groups for p in g]
    width = 1 << PART_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(parts) * width, np.int64)
        for batch in batches:
            words = np.stack([batch.column(k).to_numpy().view(U64) for k in range(WORDS)])
            for k, p in enumerate(parts):
                total += np.bincount(k * width + p.of(words), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    words = [f"s{k}" for k in range(WORDS)]
    counts = unique.select(*words).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    hot = {r["at"]: -(-r["n"] // block) for r in counts.where(F.col("n") > block).collect()}  # no more rows than parts have values
    values = [F.shiftrightunsigned(f"s{p.word}", p.shift).bitwiseAND(F.lit((1 << p.bits) - 1)).cast("int") for p in parts]
    rows = unique.select("rep", *words, F.posexplode(F.array(*values)).alias("part", "value"))
    cell = F.shiftleft(F.col("part").cast("long"), 48) + F.shiftleft(F.col("value").cast("long"), 40)
    if not hot:
        return rows.select(cell.alias("cell"), F.lit(False).alias("second"), "rep", *words)
    pieces = F.split(F.lit(",".join(str(hot.get(k, 1)) for k in range(len(parts) * width))), ",").cast("array<long>")
    rows = rows.withColumn("pieces", F.element_at(pieces, F.col("part") * width + F.col("value") + 1))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    cell += F.shiftleft(F.least("piece", "other"), 20) + F.greatest("piece", "other")
    return rows.select(cell.alias("cell"), (F.col("piece") > F.col("other")).alias("second"), "rep", *words)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK, local_edges: int = LOCAL_EDGES, all_pairs: int = ALL_PAIRS, many: int = MANY) -> DataFrame:
    """``doc_id`` and ``duplicate_of`` for each document that has a near-duplicate with a smaller id in its group.

    Two documents are near-duplicates if the 256-bit SimHashes of their distinct words differ in at most ``radius``
    bits; groups are the connected components, named by their least ``doc_id``. Up to ``all_pairs`` signatures every pair
    is compared; beyond, every pair but those that can't be within the radius (``groups_of``). Equal signatures are
    compared once.

    Null ``doc_id``, null text and texts without words are in no group. Very long texts are hashed whole, in parts. Texts
    with equal signatures are a tie and one group. Repeated rows, and rows that share a ``doc_id``, are one document.
    An empty table gives no rows. Other columns don't matter, whatever their names.
    """
    need(docs, "doc_id", "text")
    words = [f"s{k}" for k in range(WORDS)]
    sigs = saved(signatures(docs))
    unique = saved(sigs.groupBy(*words).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    n, total = unique.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    alike = with_value(sigs, unique.where("n > 1").select(*words, "n", F.col("rep").alias("value")), words, "doc_id", total)
    same = alike.where("doc_id <> value").select(F.col("doc_id").alias("u"), F.col("value").alias("v"))
    if n:
        groups = groups_of(radius, 0 if n <= all_pairs else 2 if n <= many else 3)
        tasks = 1 if n <= min(all_pairs, block) else min(10_000, max(TASKS, n * sum(map(len, groups)) // TASK_ROWS))
        cells = cells_of(unique, groups, block).repartition(tasks, "cell")
        same = same.union(cells.groupBy("cell").applyInArrow(lambda cell: compare(cell, groups, radius), "u long, v long"))
    return components(same, local_edges).select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the documents that :func:`near_duplicates` gives; the least id of each group stays.

    Rows without ``doc_id``, text or words stay. All rows of a document that goes, go; repeated rows of one that stays,
    stay. An empty table gives no rows. Further columns are kept.
    """
    (gone,) = fresh(docs, "gone")
    drop = near_duplicates(docs, radius).select(F.col("doc_id").alias(gone))
    return like(by_id(docs, drop, gone, "left_anti"), docs.columns)
