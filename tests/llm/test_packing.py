import random

import pytest
from pyspark.sql import functions as F

from recordloom.llm import packing

from .helpers import awkward, docs_of, rows


def brute(sizes, capacity):
    """Bins by trying every open bin and a new one, with the sum of squares counted anew each time."""
    bins, out = [], []

    def cost(gaps):
        return sum(gaps.count(g) ** 2 for g in set(gaps) if 0 < g)

    for size in sizes:
        best = None
        for b in [*range(len(bins)), None]:
            gap = capacity if b is None else bins[b]
            if gap < size or (b is not None and gap == 0):
                continue
            after = [*bins, capacity - size] if b is None else [g - size if k == b else g for k, g in enumerate(bins)]
            key = (cost(after), b is None, gap)
            if best is None or key < best[0]:
                best = (key, after)
        bins = best[1]
        out.append(best[0][2])
    return out, bins


@pytest.mark.parametrize("capacity", [7, 20, 64])
def test_each_choice_has_the_least_sum_of_squares(capacity):
    r = random.Random(capacity)
    sizes = [r.randint(1, capacity) for _ in range(150)]
    packer = packing.SumOfSquares(capacity)
    gaps = [capacity - packer.place(s)[2] for s in sizes]
    assert gaps == brute(sizes, capacity)[0]


def test_all_words_are_placed_once_and_no_bin_is_over(spark):
    r = random.Random(1)
    texts = ["w " * r.choice([1, 5, 40, 70, 100, 250]) for _ in range(300)]
    got = packing.pack(docs_of(spark, texts), capacity=100, shard_docs=80).toPandas()
    assert got.groupby("bin_id").n_words.sum().max() <= 100
    assert got.groupby("doc_id").n_words.sum().tolist() == [len(t.split()) for t in texts]
    for _, g in got.sort_values(["bin_id", "slot"]).groupby("bin_id"):
        assert g.bin_start.tolist() == [0, *g.n_words.cumsum().tolist()[:-1]]
        assert g.slot.tolist() == list(range(len(g)))
    for _, g in got.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        assert g.start_word.tolist() == [0, *g.n_words.cumsum().tolist()[:-1]]
    assert got.n_words.sum() > 0.85 * 100 * got.bin_id.nunique()


def test_bins_are_laid_out(spark):
    r = random.Random(2)
    texts = [" \n ".join(f"d{i}w{k}" for k in range(r.choice([1, 5, 40, 70, 250]))) for i in range(60)]
    docs = docs_of(spark, [*texts, (None, "no id"), (99, None)])
    placed = packing.pack(docs, capacity=100, shard_docs=20)
    bins = packing.lay_out(docs, placed).collect()
    every = " ".join(b.text for b in bins).split()
    assert sorted(every) == sorted(w for t in texts for w in t.split())
    assert all(len(b.text.split()) <= 100 for b in bins)
    slots = {(p.bin_id, p.slot): p for p in placed.where("doc_id IS NOT NULL").collect()}
    for b in bins:
        own = [slots[key] for key in sorted(k for k in slots if k[0] == b.bin_id)]
        assert b.doc_ids == [p.doc_id for p in own]
        assert b.text.split("\n\n") == [" ".join(texts[p.doc_id].split()[p.start_word : p.start_word + p.n_words]) for p in own]
    assert packing.lay_out(docs.limit(0), placed).count() == 0


def test_large_ids_beside_null_ids(spark):
    big = (1 << 62) + 1
    assert {r.doc_id for r in packing.pack(docs_of(spark, [(big, "a b"), (None, "c")])).collect()} == {big, None}


def test_many_rows_of_one_id_are_spread(spark):
    same = docs_of(spark, [(None, "a b c")]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(60_000))))
    got = packing.pack(same, shard_docs=10_000)
    per_shard = [r["n"] for r in got.groupBy(F.shiftright("bin_id", 40)).agg(F.count("*").alias("n")).collect()]
    assert sum(per_shard) == 60_000
    assert len(per_shard) == 6
    assert max(per_shard) < 20_000
    assert got.where("doc_id IS NOT NULL OR n_words <> 3").count() == 0
    assert got.select("bin_id", "slot").distinct().count() == 60_000


def test_awkward_rows(spark):
    got = packing.pack(awkward(spark)).toPandas()
    assert sorted(got.doc_id.dropna().unique()) == [4, 5, 6, 7]
    assert (got.doc_id == 4).sum() == 2
    assert got.doc_id.isna().sum() == 1
    assert got[got.doc_id == 5].n_words.sum() == 60_000
    assert packing.pack(awkward(spark).limit(0)).count() == 0
    assert rows(packing.pack(awkward(spark))) == rows(packing.pack(awkward(spark)))
