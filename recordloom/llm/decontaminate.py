"""Benchmark decontamination: exact pieces by the pigeonhole rule, verified with Myers' bit-parallel distance."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, by_id, fresh, like, need, open_fs, shared_dir, slices

#: Edits allowed for each character of a normalised item. Items of fewer characters than this must be there as they are, as whole words.
ERROR_RATE, SHORT_CHARS = 0.1, 24
#: Characters of items that one automaton holds; more items are searched for in several passes, each with a file of its own.
ITEM_CHARS = 4 << 20

_WORDS = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    """Lower case, with one space for each run of characters that are neither letters nor digits."""
    return " ".join(_WORDS.findall(text.lower()))


def budget(n: int, rate: float = ERROR_RATE, short: int = SHORT_CHARS) -> int:
    """Edits allowed in an item of ``n`` characters: none in a short one."""
    return int(n * rate) if n >= short else 0


def myers(pattern: str, text: str, limit: int) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``, or ``limit`` + 1 if it is more."""
    m, masks = len(pattern), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best = score
    return min(best, limit + 1)


def myers_batch(patterns: np.ndarray, sizes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least distance of each pattern, of at most 64 characters, to any substring of its text: rows of code points, 0 for none."""
    n = len(patterns)
    one, top = U64(1), U64(1) << (sizes - 1).astype(U64)
    pv, mv, score = np.full(n, ~U64(0)), np.zeros(n, U64), sizes.astype(np.int64)
    best = score.copy()
    weights = one << np.arange(patterns.shape[1], dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(texts.shape[1]):
            c = texts[:, k]
            eq = ((patterns == c[:, None]) & (c != 0)[:, None]) @ weights
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv)
            mh = pv & xh
            score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
            ph, mh = ph << one, mh << one
            pv = mh | ~(xv | ph)
            mv = ph & xv
            np.minimum(best, np.where(c != 0, score, best), out=best)
    return best


class Finder:
    """The items' pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE, short: int = SHORT_CHARS) -> None:
        # A short item is searched for with a space on either side, as are the texts: whole words.
        self.items = [(i, t if len(t) >= short else f" {t} ", budget(len(t), rate, short)) for i, t in ((i, normalise(t)) for i, t in items) if t]
        self.nodes: list[tuple[int, int, int, int, int]] = []  # item, start of the piece; start, stop and edits of the node that holds it
        pieces: dict[str, list[int]] = {}
        for at, (_, text, k) in enumerate(self.items):
            cuts = [round(j * len(text) / (k + 1)) for j in range(k + 2)]
            for j in range(k + 1):
                # If the item has at most k edits, some piece is exact, and of the nested groups of 2, 4, ... pieces that
                # hold it none has more edits than pieces less one. The largest such group of up to 64 characters is tried first.
                a, b = j, j + 1
                for a_, b_ in groups_of(0, k + 1, j):
                    if cuts[b_] - cuts[a_] <= 64:
                        a, b = a_, b_
                        break
                pieces.setdefault(text[cuts[j] : cuts[j + 1]], []).append(len(self.nodes))
                self.nodes.append((at, cuts[j], cuts[a], cuts[b], b - a - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def hits(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(number of the normalised text, number of the item, distance) for each item found in each text, in order."""
        if not self.nodes:
            return []
        seen: set[tuple[int, int, int]] = set()
        found: dict[tuple[int, int], int] = {}
        for t, text in enumerate(texts):
            for end, (size, where) in self.automaton.iter(f" {text} "):  # spaces, for whole words at its ends
                for node in where:
                    at = self.nodes[node][0]
                    if self.items[at][2]:
                        seen.add((t, node, end - size))
                    else:  # the only piece is the item
                        found[t, at] = 0
        tried = sorted(seen)
        passed = []
        for a in range(0, len(tried), 20_000):
            part = tried[a : a + 20_000]
            pats, windows, limits = [], [], []
            for t, node, start in part:
                at, piece, lo, hi, e = self.nodes[node]
                pats.append(self.items[at][1][lo:hi])
                origin = start - piece  # where the item would start
                windows.append(texts[t][max(0, origin + lo - e) : max(0, origin + hi + e)])
                limits.append(e)
            short = np.array([len(p) <= 64 for p in pats])
            ok = ~short
            pick = np.flatnonzero(short)
            if len(pick):
                width, wide = max(len(pats[i]) for i in pick), max(len(windows[i]) for i in pick)
                pa_ = np.array([pats[i].ljust(width, "\0") for i in pick], f"U{width}").view(np.uint32).reshape(len(pick), -1)
                ta = np.array([windows[i] for i in pick], f"U{wide}").view(np.uint32).reshape(len(pick), -1)
                got = myers_batch(pa_, np.array([len(pats[i]) for i in pick]), ta)
                ok[pick] = got <= np.array([limits[i] for i in pick])
            passed += [x for x, fine in zip(part, ok, strict=True) if fine]
        last: dict[tuple[int, int], set[int]] = {}
        for t, node, start in passed:
            at, piece, *_ = self.nodes[node]
            _, text, k = self.items[at]
            origin = start - piece
            if origin in last.setdefault((t, at), set()) or found.get((t, at)) == 0:
                continue
            last[t, at].add(origin)
            d = myers(text, texts[t][max(0, origin - k) : max(0, origin + len(text) + k)], k)
            if d <= k:
                found[t, at] = min(d, found.get((t, at), d))
        return [(t, at, d) for (t, at), d in sorted(found.items())]


def groups_of(lo: int, hi: int, leaf: int) -> Iterator[tuple[int, int]]:
    """The nested halves of [lo, hi) that hold ``leaf``, from the whole down to the leaf alone."""
    while True:
        yield lo, hi
        if hi - lo == 1:
            return
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if leaf < mid else (mid, hi)


def _kept(items: DataFrame, passes: int) -> list[str]:
    """Folders in the shared folder, one for each pass, with the items of that pass."""
    where = f"{shared_dir(items.sparkSession).rstrip('/')}/items-{uuid.uuid4().hex}"
    items.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))).write.partitionBy("pass").parquet(where)
    return [f"{where}/pass={p}" for p in range(passes)]


def _read(where: str) -> list[tuple[int, str]]:
    system, path = open_fs(where)
    if system.get_file_info(path).type == fs.FileType.NotFound:  # a pass without items
        return []
    table = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["item_id", "text"])
    return list(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True))


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, short: int = SHORT_CHARS) -> DataFrame:
    """``doc_id``, ``item_id`` and ``distance``, the least edit distance of the item to any passage of the document, for
    each document that holds an item with at most ``rate`` edits a character.

    Both are compared in lower case with single spaces for all that is neither letter nor digit. Each item is split into
    one more pieces than the edits allowed, so one piece must be exact; exact hits are verified with Myers' bit-parallel
    algorithm. Items with fewer than ``short`` characters after that must be there exactly, as whole words (distance 0).

    Null, empty or blank texts and items match nothing; rows without ``doc_id`` or ``item_id`` are left out. Very long texts
    are searched whole. Of several passages as near (a tie) one row tells. Repeated rows give repeated results. Empty
    tables give no rows. Other columns don't matter, whatever their names.

    Up to ``ITEM_CHARS`` characters of items reach the tasks with their code; beyond, each pass of the documents searches
    for as many, and its tasks read them from the shared folder. The driver never holds more.
    """
    need(docs, "doc_id", "text")
    need(benchmark, "item_id", "text")
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    passes = max(1, -(-chars // ITEM_CHARS))
    sources = [[(r["item_id"], r["text"]) for r in items.collect()]] if passes == 1 else _kept(items, passes)
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(source: list[tuple[int, str]] | str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(_read(source) if isinstance(source, str) else source, rate, short)
            for batch in slices(batches):
                ids = batch.column(0)
                got = finder.hits([normalise(t) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([t for t, _, _ in got], pa.int64())), pa.array([finder.items[at][0] for _, at, _ in got], pa.int64()), pa.array([d for _, _, d in got], pa.int32())],
                    names=["doc_id", "item_id", "distance"],
                )

        return rows.mapInArrow(run, "doc_id long, item_id long, distance int")

    return reduce(DataFrame.union, map(search, sources))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without the documents in which :func:`contamination` finds an item.

    Rows without ``doc_id`` or text, and empty and blank texts, stay. All rows of a document that goes, go; repeated rows
    of one that stays, stay. Empty tables: no rows, or no items and all rows. Further columns are kept.
    """
    (gone,) = fresh(docs, "gone")
    drop = contamination(docs, benchmark, rate).select(F.col("doc_id").alias(gone)).distinct()
    return like(by_id(docs, drop, gone, "left_anti"), docs.columns)
