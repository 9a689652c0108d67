"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import shared_dir

U64 = np.uint64
#: A key is hot if it has more than one of so many rows; so there are fewer hot keys than this, and they can be broadcast.
HOT_KEYS = 10_000
#: Bytes of text that numpy works on at once; arrays of eight bytes for each byte of text stay small.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 4096


def open_fs(where: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a plain path."""
    where = where if "://" in where else where.replace("file:", "", 1)
    return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that its plan is short and a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder in the shared folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not use in any case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def need(df: DataFrame, *names: str) -> None:
    """Raise if ``df`` lacks one of the columns ``names``."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def with_text(df: DataFrame, changed: Column, text: Column) -> DataFrame:
    """``df`` with another ``text``, and ``n_chars`` where it has that column, in the rows that are ``changed``."""
    out = {"text": F.when(changed, text).otherwise(F.col("text"))}
    if "n_chars" in df.columns:
        out["n_chars"] = F.when(changed, F.char_length(text).cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return df.withColumns(out)


def like(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with just ``columns``, in that order."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def with_value(rows: DataFrame, values: DataFrame, keys: list[str], spread: str, total: int) -> DataFrame:
    """``rows`` with the ``value`` that ``values`` (``keys``, ``n``, ``value``) has for their keys; rows without one are left out.

    ``values`` has a row for each key that has one. ``n`` is the number of rows with the key and ``total`` at least that of all. The values of hot keys are broadcast, and
    their rows are spread by ``spread``; so no task gets all rows of such a key.
    """
    hot = F.col("n") > total // HOT_KEYS
    rows = rows.join(F.broadcast(values.where(hot).select(*keys, F.col("value").alias("hot_value"))), keys, "left")
    rows = rows.withColumn("salt", F.when(F.col("hot_value").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.hash(spread), F.lit(10_000))))
    cold = values.where(~hot).select(*keys, F.lit(0).alias("salt"), F.col("value").alias("cold_value"))
    joined = rows.join(cold, [*keys, "salt"], "left").withColumn("value", F.coalesce("hot_value", "cold_value"))
    return joined.where("value IS NOT NULL").drop("salt", "hot_value", "cold_value")


def by_id(docs: DataFrame, other: DataFrame, id_: str, how: str) -> DataFrame:
    """``docs`` joined (``how``: left or left_anti) with ``other``, whose column ``id_`` has whole numbers, by ``doc_id``. Rows without ``doc_id`` match nothing, and are spread by a hash of their text, so that no task gets all of them."""
    key, none = fresh(docs, "key", "none")
    own = F.col("doc_id").cast("long")
    left = docs.withColumns({none: own.isNull(), key: F.coalesce(own, F.xxhash64("text"))})
    right = other.withColumns({f"{none}r": F.lit(False), f"{key}r": F.col(id_)})
    joined = left.join(right, (F.col(key) == F.col(f"{key}r")) & (F.col(none) == F.col(f"{none}r")), how)
    return joined.drop(key, none, f"{key}r", f"{none}r")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``SLICE_BYTES`` of ``text`` each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.float64))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(min(max(np.searchsorted(ends, before + SLICE_BYTES, side="right"), start + 1), start + SLICE_ROWS, batch.num_rows))
            yield batch.slice(start, stop - start)
            start = stop


#: For each byte whether it belongs to a word: ASCII letters and digits, and all bytes of characters beyond ASCII.
_INSIDE = bytes(i >= 128 or chr(i).isalnum() for i in range(256))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * SLICE_BYTES + 2
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, base, U64), dtype=U64)
        down = np.cumprod(np.full(n, pow(base, -1, 1 << 64), U64), dtype=U64)
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x ^= x >> U64(33)
        x *= U64(0xC4CEB9FE1A85EC53)
        x ^= x >> U64(33)
    return x


def words_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The lower-cased words of ``texts`` in parts of at most twice ``SLICE_BYTES``: the part's bytes, where each word starts and stops in it, and the number of the text that each word is from.

    A word is a run of ASCII letters or digits and of characters beyond ASCII.
    """
    raw = "\0".join(t.replace("\0", " ") for t in texts).lower().encode("utf-8", "replace")
    first, text_no = 0, 0
    while first < len(raw):
        last = min(len(raw), first + 2 * SLICE_BYTES)
        flags = raw[first:last].translate(_INSIDE)
        if last < len(raw):  # cut between words; a word of more than a whole part is cut as it is
            cut = flags.rfind(b"\0")
            if cut >= 0:
                flags, last = flags[: cut + 1], first + cut + 1
        part = np.frombuffer(raw, np.uint8, last - first, first)
        edge = np.frombuffer(b"\0" + flags + b"\0", np.uint8)
        turns = np.flatnonzero(edge[1:] != edge[:-1])
        starts, stops = turns[::2], turns[1::2]
        breaks = np.flatnonzero(part == 0)
        yield part, starts, stops, np.searchsorted(breaks, starts) + text_no
        text_no += len(breaks)
        first = last


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``texts``, in order, and the number of the text each is from."""
    up, down = _powers()
    hashes, owners = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for part, starts, stops, owner in words_of(texts):
        with np.errstate(over="ignore"):
            running = np.zeros(len(part) + 1, U64)
            terms = part.astype(U64)
            terms *= up[: len(part)]
            np.cumsum(terms, out=running[1:])
            hashes.append(mix((running[stops] - running[starts]) * down[starts]))
        owners.append(owner)
    return np.concatenate(hashes), np.concatenate(owners)
