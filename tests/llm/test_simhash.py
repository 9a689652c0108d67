import random
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pytest

from recordloom.llm import common, simhash
from recordloom.llm.common import SLICE_BYTES, word_hashes

from .helpers import awkward, docs_of, rows


def words(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def corpus():
    r = random.Random(5)
    texts = [" ".join(words(r, 120)) for _ in range(60)]
    groups = []
    for k in range(12):
        base = words(r, 150)
        group = []
        for _ in range(r.choice([2, 3, 8])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 3])):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
            group.append(len(texts))
            texts.append(" ".join(copy))
        groups.append(group)
    return texts, groups


def brute(texts, radius):
    sig, n = simhash.signatures_of(texts)
    of = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            d = np.bitwise_count(sig[i] ^ sig[j])
            if n[i] and n[j] and d.sum() <= radius:
                a, b = sorted((of[i], of[j]))
                of = [a if x == b else x for x in of]
    return sorted(((i, g) for i, g in enumerate(of) if i != g), key=repr)


@pytest.mark.parametrize(("block", "local"), [(1 << 17, 10**6), (16, 0)])
def test_groups_are_those_of_brute_force(spark, block, local):
    texts, groups = corpus()
    got = rows(simhash.near_duplicates(docs_of(spark, texts), block=block, local_edges=local))
    assert got == brute(texts, simhash.RADIUS)
    together = {i for i, _ in got} | {g for _, g in got}
    assert sum(set(g) <= together for g in groups) >= 0.9 * len(groups)
    assert not together & set(range(60))


def test_near_pairs_are_all_within_the_radius():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    bits = np.unpackbits(np.repeat(base, 40, axis=0).view(np.uint8), axis=1)
    for row in bits:  # distances on both sides of the radius, in any of the words
        row[r.choice(256, r.integers(0, 45), replace=False)] ^= 1
    bits[::7, 64:] = r.integers(0, 2, bits[::7, 64:].shape)
    sig = np.packbits(bits, axis=1).view(np.uint64)
    pc = np.bitwise_count(sig).sum(axis=1).astype(int)
    order = np.argsort(pc, kind="stable")
    sig, pc = np.ascontiguousarray(sig[order]), pc[order]
    want = {(i, j) for i in range(len(sig)) for j in range(i + 1, len(sig)) if np.bitwise_count(sig[i] ^ sig[j]).sum() <= simhash.RADIUS}
    got = [(int(i), int(j)) for u, v in simhash.near_pairs(sig, pc, sig, pc, simhash.RADIUS, True) for i, j in zip(u, v, strict=True)]
    assert len(got) == len(set(got))
    assert set(got) == want
    half = len(sig) // 2
    across = {(int(i), int(j) + half) for u, v in simhash.near_pairs(sig[:half], pc[:half], sig[half:], pc[half:], simhash.RADIUS, False) for i, j in zip(u, v, strict=True)}
    assert across == {(i, j) for i, j in want if i < half <= j}


@pytest.mark.parametrize("group", [1, 2, 3])
@pytest.mark.parametrize("radius", [5, 40, 70])
def test_no_near_pair_is_lost_by_parts_and_few_pairs_are_compared(monkeypatch, group, radius):
    monkeypatch.setattr(simhash, "FILL", 4)
    groups = simhash.groups_of(radius, group)
    parts = [p for g in groups for p in g]
    assert sorted((p.word, p.shift + b) for p in parts for b in range(p.bits)) == [(w, b) for w in range(4) for b in range(64)]
    assert max(p.bits for p in parts) <= simhash.PART_BITS
    r = np.random.default_rng(group)
    base = r.integers(0, 1 << 63, (10_000, 4), dtype=np.uint64)
    bits = np.unpackbits(base.view(np.uint8), axis=1)
    for k in range(1000):  # partners at the radius and around it
        bits[k + 1000] = bits[k]
        bits[k + 1000, r.choice(256, radius + r.integers(-1, 3), replace=False)] ^= 1
    words = np.packbits(bits, axis=1).view(np.uint64).T
    near = np.flatnonzero(np.bitwise_count(words[:, :1000] ^ words[:, 1000:2000]).sum(axis=0) <= radius)
    found, pairs = set(), 0
    for at, part in enumerate(parts):
        for value in range(1 << part.bits):
            rep = np.flatnonzero(part.of(words) == value)
            if not len(rep):
                continue
            cell = pa.table({"cell": [at << 48 | value << 40] * len(rep), "second": [False] * len(rep), "rep": rep, **{f"s{k}": words[k, rep].view(np.int64) for k in range(4)}})
            with count_pairs() as compared:
                out = simhash.compare(cell, groups, radius)
            found |= set(zip(out["v"].to_pylist(), out["u"].to_pylist(), strict=True))
            pairs += compared[0]
    assert {(k, k + 1000) for k in near.tolist()} <= found
    if radius == simhash.RADIUS and group > 1:
        assert pairs < 0.25 * words.shape[1] ** 2 / 2


@contextmanager
def count_pairs():
    plain, total = simhash.near_pairs, [0]

    def counted(a, pa_, b, pb, radius, same):
        total[0] += len(a) * len(b)
        return plain(a, pa_, b, pb, radius, same)

    simhash.near_pairs = counted
    try:
        yield total
    finally:
        simhash.near_pairs = plain


@pytest.mark.parametrize(("many", "block"), [(10**6, 1 << 18), (0, 1 << 18), (10**6, 5), (0, 5)])
def test_parts_give_the_groups_of_brute_force(spark, monkeypatch, many, block):
    texts, _ = corpus()
    base = [f"c{i}" for i in range(200)]
    texts += [" ".join([*base[:k], f"n{k}", *base[k + 1 :]]) for k in range(60)]  # one large group, in the same cells
    for name, few in (("FILL", 1), ("SLAB", 4), ("PENDING", 1)):
        monkeypatch.setattr(simhash, name, few)
    assert rows(simhash.near_duplicates(docs_of(spark, texts), block=block, all_pairs=0, many=many)) == brute(texts, simhash.RADIUS)


def test_large_groups_take_few_comparisons():
    r = np.random.default_rng(9)
    bits = np.repeat(np.unpackbits(r.integers(0, 1 << 63, (1, 4), dtype=np.uint64).view(np.uint8))[None], 6000, axis=0)
    for row in bits:
        row[r.choice(256, 12, replace=False)] ^= 1
    words = np.packbits(bits, axis=1).view(np.uint64).T
    cell = pa.table({"cell": [0] * 6000, "second": [False] * 6000, "rep": np.arange(6000), **{f"s{k}": np.ascontiguousarray(words[k]).view(np.int64) for k in range(4)}})
    with count_pairs() as compared:
        out = simhash.compare(cell, simhash.groups_of(simhash.RADIUS, 0), simhash.RADIUS)
    assert out["u"].to_pylist() == list(range(1, 6000))
    assert set(out["v"].to_pylist()) == {0}
    assert compared[0] < 6000 * 6000 / 5


def test_hot_signatures_and_rows_without_ids_are_spread(spark, monkeypatch):
    texts, _ = corpus()
    docs = docs_of(spark, [*texts, *[texts[0]] * 40])
    want = brute([*texts, *[texts[0]] * 40], simhash.RADIUS)
    for few in (2, 10):
        monkeypatch.setattr(common, "HOT_KEYS", few)
        for local in (10**6, 0):
            assert rows(simhash.near_duplicates(docs, local_edges=local)) == want
    nameless = docs_of(spark, [(None, f"text {i}") for i in range(300)])
    joined = common.by_id(nameless, spark.range(10), "id", "left_anti")
    assert joined.count() == 300
    assert joined.columns == nameless.columns


def test_stage_keeps_the_first_of_each_group(spark):
    texts, _ = corpus()
    docs = docs_of(spark, texts)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in brute(texts, simhash.RADIUS)}


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.near_dedup(docs).columns == docs.columns
    assert simhash.near_dedup(docs).count() == docs.count()
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_hashes_do_not_depend_on_where_parts_are_cut():
    long = " ".join(f"t{i}" for i in range(SLICE_BYTES // 3))
    a, owner = word_hashes(["a b", long, "", "b a"])
    b, _ = word_hashes([long])
    assert (a[2:-2] == b).all()
    assert owner.tolist()[:2] == [0, 0]
    assert owner.tolist()[-2:] == [3, 3]
    assert a[0] == a[-1]
    assert len(set(b.tolist())) == SLICE_BYTES // 3
