"""Line dedup by winnowing: fingerprints of line runs, joined by position, extended both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_id, fresh, like, need, saved, with_text, with_value

#: A passage is a run of so many lines, or one line of so many characters or of so many words.
RUN_LINES, LONG_CHARS, LONG_WORDS = 2, 250, 50
_BLANKS = " \t\v\f\r"


def _strip(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def _long(line: Column, chars: int, words: int) -> Column:
    """Whether a stripped line has so many characters or words; the words are split only where there are blanks enough."""
    size = F.char_length(line)
    few = (size < 2 * words - 1) | (size - F.char_length(F.translate(line, _BLANKS, "")) < words - 1)
    return F.when(size >= chars, True).when(few, False).otherwise(F.size(F.split(line, f"[{_BLANKS}]+")) >= words)


def fingerprints(docs: DataFrame, run_lines: int = RUN_LINES, long_chars: int = LONG_CHARS, long_words: int = LONG_WORDS) -> DataFrame:
    """Winnowed lines: ``id``, ``h``, ``chars``, ``long``, ``around`` and ``places``.

    Of each window of ``run_lines`` line hashes the rightmost least one is selected, so two equal runs of that many lines
    select the same line. Lines of at least ``long_chars`` characters or ``long_words`` words are always selected. ``around``
    has the hashes of ``run_lines`` - 1 lines on either side (blank ones aside), null beyond the ends, and ``places`` where
    they stand among all lines of the text.
    """
    w = run_lines
    lines = F.transform(F.split("text", "\n"), lambda line, at: F.struct(_strip(line).alias("line"), at.alias("at")))
    lines = F.transform(F.filter(lines, lambda x: x["line"] != ""), lambda x: F.struct(F.xxhash64(x["line"]).alias("h"), F.char_length(x["line"]).alias("chars"), _long(x["line"], long_chars, long_words).alias("long"), x["at"].alias("at")))
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), lines.alias("lines"))
    rows = rows.where(F.size("lines") > 0).select("id", F.col("lines.h").alias("hs"), F.col("lines.chars").alias("sizes"), F.col("lines.long").alias("longs"), F.col("lines.at").alias("ats"))
    size = F.size("hs")

    def pick(n):  # noqa: ANN001, ANN202
        """Whether line n is the rightmost least of some whole window."""
        own = F.get("hs", n)
        windows = F.sequence(F.greatest(n - (w - 1), F.lit(0)), F.least(n, size - w))

        def chosen(start):  # noqa: ANN001, ANN202
            return F.forall(F.sequence(start, start + (w - 1)), lambda k: F.when(k <= n, F.get("hs", k) >= own).otherwise(F.get("hs", k) > own))

        return F.when(F.greatest(n - (w - 1), F.lit(0)) <= F.least(n, size - w), F.exists(windows, chosen)).otherwise(False)

    def near(values: str, n: Column) -> Column:
        return F.transform(F.sequence(n - (w - 1), n + (w - 1)), lambda k: F.when(k >= 0, F.get(values, k)))

    at = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda n: F.struct(F.get("hs", n).alias("h"), F.get("sizes", n).alias("chars"), F.get("longs", n).alias("long"), pick(n).alias("won"), near("hs", n).alias("around"), near("ats", n).alias("places")),
    )
    return rows.select("id", F.explode(at).alias("f")).select("id", "f.*").where("long or won")


def repeated_lines(docs: DataFrame, run_lines: int = RUN_LINES, long_chars: int = LONG_CHARS, long_words: int = LONG_WORDS) -> DataFrame:
    """``id``, ``marks`` (for the lines in order, whether to delete them, as far as any is) and ``n_gone``, of each document that has any."""
    w = run_lines
    prints = saved(fingerprints(docs, run_lines, long_chars, long_words))  # read several times: the texts are not
    total = prints.count()
    twice = prints.groupBy("h").agg(F.count("*").alias("n"), F.lit(True).alias("value")).where("n > 1")
    # A fingerprint that occurs once is in no repeated run: only the others are extended, both ways, to every run through them.
    found = with_value(prints, twice, ["h"], "id", total)
    # A run is told by two numbers of 64 bits, its first line and the others; a lone line by its hash and length.
    runs = F.transform(
        F.sequence(F.lit(0), F.lit(w - 1)),
        lambda k: F.struct(F.get("around", k).alias("key"), F.xxhash64(F.lit(w), F.slice("around", k + 2, w - 1)).alias("key2"), F.slice("places", k + 1, w).alias("places")),
    )
    whole = F.filter(runs, lambda r: ~F.exists(r["places"], lambda at: at.isNull()))
    alone = F.array(F.struct(F.col("h").alias("key"), F.col("chars").cast("long").alias("key2"), F.slice("places", w, 1).alias("places")))
    runs = found.select("id", F.explode(F.when(F.col("long"), F.concat(whole, alone)).otherwise(whole)).alias("r")).select("id", "r.*", F.size("r.places").alias("length"))
    runs = runs.withColumn("start", F.get("places", F.lit(0)))
    first = runs.groupBy("key", "key2", "length").agg(F.count("*").alias("n"), F.min(F.struct("id", "start")).alias("value")).where("n > 1")
    later = with_value(runs, first, ["key", "key2", "length"], "id", (w + 1) * total).where(F.struct("id", "start") > F.col("value"))
    gone = later.select("id", F.explode("places").alias("at")).groupBy("id").agg(F.collect_set("at").alias("ats"))
    # By the line's place, so that a text is cut in time linear in its lines.
    others = F.array_except(F.sequence(F.lit(0), F.array_max("ats")), F.col("ats"))
    marks = F.concat(F.transform("ats", lambda at: F.struct(at.alias("at"), F.lit(True).alias("gone"))), F.transform(others, lambda at: F.struct(at.alias("at"), F.lit(False).alias("gone"))))
    return gone.select("id", F.array_sort(marks)["gone"].alias("marks"), F.size("ats").alias("n_gone"))


def line_dedup(docs: DataFrame, run_lines: int = RUN_LINES, long_chars: int = LONG_CHARS, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` without the passages that occurred before; documents of which no line but blank ones is left go.

    A passage is a run of ``run_lines`` lines or more, or one line of ``long_chars`` characters or ``long_words`` words or
    more. Lines are compared without white space at their ends; blank lines are passed over, and stay. The first
    occurrence, by ``doc_id`` and place in the text, stays; the lines of every later one are deleted. ``n_chars`` follows
    the text.

    Rows without ``doc_id`` or text, and empty and blank texts, stay as they are and match nothing. Repeated rows are one
    document: neither is later than the other (a tie). Within one document later repeats go too. Very long texts are
    handled whole. An empty table gives no rows. Further columns are kept, whatever their names.
    """
    need(docs, "doc_id", "text")
    id_, marks, n_gone = fresh(docs, "id", "marks", "n_gone")
    gone = repeated_lines(docs, run_lines, long_chars, long_words).toDF(id_, marks, n_gone)
    joined = by_id(docs, gone, id_, "left")
    lines = F.split("text", "\n")
    solid = F.size(F.filter(lines, lambda line: _strip(line) != ""))
    left = F.filter(lines, lambda line, at: ~F.coalesce(F.get(F.col(marks), at), F.lit(False)))
    whole = F.col(n_gone).isNull() | (F.col(n_gone) < solid)
    return like(with_text(joined.where(whole), F.col(n_gone).isNotNull(), F.array_join(left, "\n")), docs.columns)


#: DuckDB SQL for :func:`line_dedup` with its defaults; ``{docs}`` is the table.
SQL = f"""
WITH src AS (SELECT * FROM {{docs}}),
raw AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS norm
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM src WHERE doc_id IS NOT NULL)
),
lines AS (SELECT doc_id, place, norm, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS n FROM raw WHERE norm <> ''),
pairs AS (SELECT doc_id, n, norm, lead(norm) OVER (PARTITION BY doc_id ORDER BY n) AS norm2 FROM lines),
later AS (
  SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY norm, norm2 ORDER BY doc_id, n) AS k FROM pairs WHERE norm2 IS NOT NULL) WHERE k > 1
),
long AS (
  SELECT doc_id, n FROM (
    SELECT doc_id, n, row_number() OVER (PARTITION BY norm ORDER BY doc_id, n) AS k FROM lines
    WHERE length(norm) >= {LONG_CHARS} OR (length(norm) >= {2 * LONG_WORDS - 1} AND len(string_split_regex(norm, '[ \t\x0B\f\r]+')) >= {LONG_WORDS})
  ) WHERE k > 1
),
gone AS (SELECT doc_id, n FROM later UNION SELECT doc_id, n + 1 FROM later UNION SELECT doc_id, n FROM long),
marked AS (
  SELECT r.doc_id, r.place, r.line, r.norm, g.n IS NOT NULL AS gone
  FROM raw r LEFT JOIN lines l ON r.doc_id = l.doc_id AND r.place = l.place LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.n = g.n
),
found AS (
  SELECT doc_id, string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY place) AS rest, count(*) FILTER (gone) AS n_gone, count(*) FILTER (norm <> '') AS n_lines
  FROM marked GROUP BY doc_id
)
SELECT s.doc_id, CASE WHEN f.n_gone > 0 THEN f.rest ELSE s.text END AS text, s.lang, s.source,
  CASE WHEN f.n_gone > 0 THEN length(f.rest) ELSE s.n_chars END AS n_chars
FROM src s LEFT JOIN found f ON s.doc_id = f.doc_id
WHERE coalesce(f.n_gone, 0) = 0 OR f.n_gone < f.n_lines
"""
