"""Quality rules by cross-document line frequency within a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, by_id, fresh, like, need, saved, with_text

#: A line is boilerplate of its host if it is in more distinct documents than both of these allow.
MIN_DOCS, MAX_SHARE = 10, 0.01
#: Frequent lines up to which they are broadcast by host, some 40 bytes each; beyond, they are joined to each document's lines.
BROADCAST_LINES = 500_000
#: A document is depleted if more than this share of its characters was in removed lines.
MAX_REMOVED = 0.75


def normalised(line: Column) -> Column:
    """A line in lower case, without white space at its ends."""
    return F.lower(F.btrim(line, F.lit(" \t\v\f\r")))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """``host``, ``h`` (the hash of a normalised line) and ``n_docs`` for lines above the limit of their host."""
    lines = _lines(docs)
    n_docs = docs.groupBy(F.col("source").alias("host")).agg(F.count_distinct("doc_id").alias("host_docs"))
    counts = lines.select("host", "h", "id").distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    return counts.join(n_docs, counts.host.eqNullSafe(n_docs.host)).where(F.col("n_docs") > max_share * F.col("host_docs")).select(counts.host, "h", "n_docs")


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line that is not blank: document, host, place, hash and length of the normalised line."""
    at = F.posexplode(F.split("text", "\n")).alias("at", "line")
    lines = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col("source").alias("host"), at)
    lines = lines.withColumn("line", normalised(F.col("line"))).where("line <> ''")
    return lines.select("id", "host", "at", F.xxhash64("line").alias("h"), F.char_length("line").alias("size"))


def slotted(hashes: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``slots`` of a table of ``keys`` and ``h``: the distinct hashes of a key, each in the slot of its rest by their number, so that one is looked up in the same time however many there are."""
    sets = hashes.groupBy(*keys).agg(F.collect_set("h").alias("hs"))
    slot = F.explode(F.transform("hs", lambda h: F.struct(F.pmod(h, F.size("hs")).alias("slot"), h.alias("h"))))
    none = F.explode(F.transform(F.sequence(F.lit(0), F.size("hs") - 1), lambda n: F.struct(n.cast("long").alias("slot"), F.lit(None).cast("long").alias("h"))))
    filled = sets.select(*keys, slot.alias("s")).union(sets.select(*keys, none.alias("s"))).groupBy(*keys, "s.slot").agg(F.collect_list("s.h").alias("hs"))
    return filled.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", "hs")))["hs"].alias("slots"))


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``docs`` without boilerplate lines, and without the documents that these leave depleted.

    A line is hashed after normalising. It is removed from the documents of a host (``source``) if more than
    ``min_docs`` and more than ``max_share`` of that host's distinct documents hold it. A document is rejected if more
    than ``max_removed`` of the characters of its normalised lines were in such lines. ``n_chars`` follows the text.

    Null hosts are one host. Blank lines are neither counted nor removed. Null and blank texts have no lines and stay.
    Rows without ``doc_id`` stay as they are and are not counted. Repeated rows count as one document and get the same
    decision; so do lines that a document repeats. At a limit (a tie) a line or a document stays. Very long texts are
    handled whole. An empty table gives no rows. Further columns are kept, whatever their names.
    """
    need(docs, "doc_id", "text", "source")
    host, slots, id_ = fresh(docs, "host", "bad", "id")
    frequent = saved(frequent_lines(docs, min_docs, max_share))
    if frequent.count() <= broadcast_lines:
        bad = slotted(frequent, "host").toDF(host, slots)
        joined = docs.join(F.broadcast(bad), F.col("source").eqNullSafe(F.col(host)), "left")
    else:
        marked = _lines(docs).join(frequent.toDF("bad_host", "bad_h", "n_docs"), F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("h") == F.col("bad_h")))
        bad = slotted(marked.select("id", "host", "h"), "id", "host").toDF(id_, host, slots)
        # Rows that share an id may have several hosts: a row has the lines of its own.
        hosts = bad.groupBy(id_).agg(F.collect_list(F.struct(F.col(host).alias("host"), F.col(slots).alias("slots"))).alias(host))
        joined = by_id(docs, hosts, id_, "left")
        joined = joined.withColumn(slots, F.get(F.filter(host, lambda b: b["host"].eqNullSafe(F.col("source"))), F.lit(0))["slots"])

    def marked_line(line: Column) -> Column:
        return bind(normalised(line), lambda norm: F.struct(((norm != "") & bind(F.xxhash64(norm), found)).alias("bad"), F.char_length(norm).cast("long").alias("size"), line.alias("line")))

    def found(h: Column) -> Column:
        return F.array_contains(F.get(F.col(slots), F.pmod(h, F.size(slots)).cast("int")), h)

    def judged(lines: Column) -> Column:
        return bind(F.filter(lines, lambda m: ~m["bad"]), lambda kept: F.when(F.size(kept) < F.size(lines), cut(kept, lines)))

    def cut(kept: Column, lines: Column) -> Column:
        size = lambda marks: F.aggregate(marks["size"], F.lit(0).cast("long"), lambda n, k: n + k)
        return F.struct((size(kept) >= F.lit(1 - max_removed) * size(lines)).alias("fine"), F.array_join(kept["line"], "\n").alias("text"))

    result = bind(F.transform(F.split("text", "\n"), marked_line), judged)
    candidate = F.col(slots).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    (out,) = fresh(joined, "result")
    joined = joined.withColumn(out, F.when(candidate, result)).where(F.col(out).isNull() | F.col(out)["fine"])
    return like(with_text(joined, F.col(out).isNotNull(), F.col(out)["text"]), docs.columns)


_NORMAL = "lower(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))"

#: DuckDB SQL for :func:`quality_rules` with its defaults; ``{docs}`` is the table.
SQL = f"""
WITH src AS (SELECT * FROM {{docs}}),
lines AS (
  SELECT doc_id, source, place, line, {_NORMAL} AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM src WHERE doc_id IS NOT NULL)
),
hosts AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM src GROUP BY source),
bad AS (
  SELECT f.source, f.norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM lines WHERE norm <> '' GROUP BY source, norm) f
  JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE n > {MIN_DOCS} AND n > {MAX_SHARE} * host_docs
),
marked AS (SELECT l.*, b.norm IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.norm = b.norm),
found AS (
  SELECT doc_id, coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY place), '') AS rest,
    sum(length(norm)) AS total, coalesce(sum(length(norm)) FILTER (NOT gone), 0) AS left_over, bool_or(gone) AS touched
  FROM marked GROUP BY doc_id
)
SELECT s.doc_id, CASE WHEN f.touched THEN f.rest ELSE s.text END AS text, s.lang, s.source,
  CASE WHEN f.touched THEN length(f.rest) ELSE s.n_chars END AS n_chars
FROM src s LEFT JOIN found f ON s.doc_id = f.doc_id
WHERE f.touched IS NOT TRUE OR f.left_over >= {1 - MAX_REMOVED} * f.total
"""
