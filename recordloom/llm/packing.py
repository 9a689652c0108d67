"""Best-fit packing by the sum-of-squares rule."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

#: Words in a bin, documents that one task packs, and rows of one id and size that are kept together.
CAPACITY, SHARD_DOCS, RUN = 2048, 50_000, 1000


class SumOfSquares:
    """Open bins by residual gap. Each item goes where the sum over gaps of (open bins with that gap)² becomes least.

    Full bins are closed and don't count. Among equal sums an open bin is better than a new one, and a small gap than a
    large one; among bins of one gap, the one last used.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # of open bins, by gap
        self.stacks: dict[int, list[int]] = {}
        self.bins = 0
        self.slots: list[int] = []

    def place(self, size: int) -> tuple[int, int, int]:
        """The bin, the slot in it and the words before it, for an item of 1 to ``capacity`` words."""
        c, n = self.capacity, self.count
        best, change = c, 2 * int(n[c - size]) + 1 if size < c else 0
        if size < c:
            after = n[: c - size].copy()  # open bins that have the gap which is left, for gaps size to c - 1
            after[0] = 0
            by_gap = 2 * (after - n[size:c]) + 2
            by_gap[0] -= 1  # a bin that becomes full is closed
            by_gap[n[size:c] == 0] = np.iinfo(np.int64).max
            k = int(np.argmin(by_gap))
            if by_gap[k] <= change:
                best, change = k + size, int(by_gap[k])
        if best == c:
            bin_ = self.bins
            self.bins += 1
            self.slots.append(0)
        else:
            bin_ = self.stacks[best].pop()
            n[best] -= 1
        gap = best - size
        if gap:
            n[gap] += 1
            self.stacks.setdefault(gap, []).append(bin_)
        slot = self.slots[bin_]
        self.slots[bin_] += 1
        return bin_, slot, c - best


def pack_shard(ids: list[int], sizes: list[int], capacity: int, shard: int = 0) -> pd.DataFrame:
    """Placements of documents in the given order; see :func:`pack`."""
    packer, rows = SumOfSquares(capacity), []
    for doc, words in zip(ids, sizes, strict=True):
        for piece, start in enumerate(range(0, words, capacity)):
            size = min(capacity, words - start)
            bin_, slot, before = packer.place(size)
            rows.append(((shard << 40) + bin_, slot, before, doc, piece, start, size))
    return pd.DataFrame(rows, columns=["bin_id", "slot", "bin_start", "doc_id", "piece", "start_word", "n_words"], dtype="int64")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row for each piece of each document: ``bin_id``, ``slot`` and ``bin_start`` (its place in the bin, in pieces and
    in words), ``doc_id``, ``piece``, ``start_word`` and ``n_words`` (what part of the document it is).

    Sizes are words, parted by white space. A document of more than ``capacity`` words, however long, is cut into whole
    bins and a rest. Documents are spread over shards of about ``shard_docs`` by a hash of their id and size; each shard
    places its documents in the order of their ids, then sizes, by :class:`SumOfSquares`. No bin holds more than
    ``capacity`` words, and all words are placed once.

    Null, empty and blank texts have no words and no row. Rows without ``doc_id`` are packed under a null id. Repeated
    rows, and rows of one id and size (a tie), are packed one by one; they are counted first and spread in runs of ``RUN``,
    so that no shard gets all of them. An empty table gives no rows. Other columns don't matter, whatever their names.
    """
    need(docs, "doc_id", "text")
    words = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))
    id_ = F.col("doc_id").cast("long")
    # Null ids are told by a flag: in pandas a column with nulls would turn large ids into rounded floats.
    sizes = docs.select(F.coalesce(id_, F.lit(0)).alias("doc_id"), id_.isNotNull().alias("known"), words.alias("words"))
    shards = max(1, -(-docs.count() // shard_docs))
    alike = sizes.where("words > 0").groupBy("known", "doc_id", "words").agg(F.count("*").alias("copies"))
    runs = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))))
    runs = runs.withColumn("copies", F.least(F.lit(RUN), F.col("copies") - F.col("run") * RUN))
    runs = runs.withColumn("shard", F.pmod(F.xxhash64("known", "doc_id", "words", "run"), F.lit(shards)))

    def run(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["known", "doc_id", "words"], kind="stable")
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])]
        out = pack_shard(list(range(len(pdf))), pdf["words"].tolist(), capacity, int(key[0]))
        at = out["doc_id"].to_numpy()
        out["doc_id"] = pd.array(pdf["doc_id"].to_numpy()[at], dtype="Int64")
        out.loc[~pdf["known"].to_numpy()[at], "doc_id"] = pd.NA
        return out

    schema = "bin_id long, slot long, bin_start long, doc_id long, piece long, start_word long, n_words long"
    return runs.repartition(min(shards, 10_000), "shard").groupBy("shard").applyInPandas(run, schema)  # a number, lest shards be put together in few tasks


def lay_out(docs: DataFrame, placed: DataFrame, separator: str = "\n\n") -> DataFrame:
    """``bin_id``, ``text`` and ``doc_ids`` of each bin of ``placed``: its pieces in the order of their slots, words parted by single blanks, pieces by ``separator``.

    ``doc_id`` must tell the documents apart: placements under a null id, and of ids that ``docs`` doesn't have, are left
    out; of rows that share an id the one with the least text counts. A bin's text has ``capacity`` words at most, so no
    group is large. Empty tables give no rows.
    """
    need(docs, "doc_id", "text")
    once = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("text").alias("text"))
    pieces = placed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct("bin_id", "slot", "start_word", "n_words")).alias("pieces"))
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    cut = once.join(pieces, "doc_id").select("doc_id", words.alias("words"), F.explode("pieces").alias("p"))
    cut = cut.select("p.bin_id", "p.slot", "doc_id", F.array_join(F.slice("words", F.col("p.start_word").cast("int") + 1, F.col("p.n_words").cast("int")), " ").alias("piece"))
    bins = cut.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("slot", "piece", "doc_id"))).alias("ps"))
    return bins.select("bin_id", F.array_join(F.col("ps.piece"), separator).alias("text"), F.col("ps.doc_id").alias("doc_ids"))
