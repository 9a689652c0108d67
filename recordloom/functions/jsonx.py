"""JSON in text: validity, extraction, repair and normal forms."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .binding import bind
from .text import strip

OBJECT = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"


@F.pandas_udf(StringType())
def json_error(texts: pd.Series) -> pd.Series:
    """The parser's message for text that isn't JSON, else null. Null in, null out."""

    def check(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            json.loads(text)
        except (json.JSONDecodeError, RecursionError) as error:
            return str(error)
        return None

    return texts.map(check).astype(object)


class _Scanner:
    """A tolerant reader: single quotes, bare words, missing commas and closers, trailing commas, Python constants."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def skip(self) -> None:
        while self.at < len(self.text) and (self.text[self.at].isspace() or self.text[self.at] == ","):
            self.at += 1

    def value(self, depth: int = 0) -> Any:
        self.skip()
        if self.at >= len(self.text) or depth > 200:
            return None
        c = self.text[self.at]
        if c == "{":
            return self.members(depth)
        if c == "[":
            return self.items(depth)
        if c in "\"'":
            return self.quoted(c)
        return self.bare()

    def members(self, depth: int) -> dict:
        out: dict = {}
        self.at += 1
        while True:
            self.skip()
            if self.at >= len(self.text):
                return out
            c = self.text[self.at]
            if c in "}]":
                self.at += 1
                return out
            key = self.quoted(c) if c in "\"'" else self.word(":")
            self.skip()
            if self.at < len(self.text) and self.text[self.at] == ":":
                self.at += 1
                out[str(key)] = self.value(depth + 1)
            elif key == "":
                self.at += 1

    def items(self, depth: int) -> list:
        out: list = []
        self.at += 1
        while True:
            self.skip()
            if self.at >= len(self.text):
                return out
            if self.text[self.at] in "]}":
                self.at += 1
                return out
            before = self.at
            out.append(self.value(depth + 1))
            if self.at == before:
                self.at += 1

    def quoted(self, mark: str) -> str:
        self.at += 1
        out = []
        escapes = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == mark:
                break
            if c == "\\" and self.at < len(self.text):
                c = self.text[self.at]
                self.at += 1
                if c == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", code := self.text[self.at : self.at + 4]):
                    out.append(chr(int(code, 16)))
                    self.at += 4
                    continue
                c = escapes.get(c, c)
            out.append(c)
        return "".join(out)

    def word(self, stops: str) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in stops + ",{}[]\n":
            self.at += 1
        return self.text[start : self.at].strip()

    def bare(self) -> Any:
        word = self.word("")
        known = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None, "NaN": None}
        if word in known:
            return known[word]
        try:
            return int(word)
        except ValueError:
            try:
                return float(word)
            except ValueError:
                return word


def repair(text: str | None) -> str | None:
    """JSON text from nearly-JSON text; an empty string where there is none at all."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except (json.JSONDecodeError, RecursionError):
        pass
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        return ""
    scanner = _Scanner(text)
    scanner.at = min(starts)
    values = [scanner.value()]
    while (nxt := min((i for i in (text.find("{", scanner.at), text.find("[", scanner.at)) if i >= 0), default=-1)) >= 0:
        scanner.at = nxt
        values.append(scanner.value())
    return json.dumps(values[0] if len(values) == 1 else values, ensure_ascii=False)


@F.pandas_udf(StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repair, na_action="ignore").astype(object)


def repair_json(c: Column) -> Column:
    """:func:`repair` for a column."""
    return _repaired(c)


def tagged_json(c: Column) -> Column:
    """What stands in the first ``<json>`` tags, or all of it, repaired; an error object where that is empty."""
    pattern = r"(?s)<json>(.*?)</json>"
    body = repair_json(F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c))
    return F.when(body.isNull() | body.isin("", "{}", "null"), F.lit('{"error": "there is no JSON in the text"}')).otherwise(body)


def fenced_json(c: Column) -> Column:
    """JSON without a fence, repaired; null where there is none."""
    body = repair_json(strip(F.regexp_replace(c, r"```(?:json)?", "")))
    return F.when(body != "", body)


def objects_in(c: Column) -> Column:
    """The objects in a text that parse, braces nested once at most."""
    return F.filter(F.regexp_extract_all(c, F.lit(OBJECT), F.lit(0)), lambda x: x.rlike(r'^\{\s*["}]') & F.try_parse_json(x).isNotNull())  # the parser is slow to fail


def is_jsonl(c: Column) -> Column:
    """Whether a text holds an object that parses."""
    return F.size(objects_in(c)) > 0


def largest_object(c: Column) -> Column:
    """The longest object that parses, the first of equals; ``{}`` if none does. A closing TERMINATE is passed over."""
    found = objects_in(F.regexp_replace(c, r"\s*TERMINATE\s*$", ""))
    longest = F.aggregate(found, F.lit(""), lambda best, x: F.when(F.char_length(x) > F.char_length(best), x).otherwise(best))
    return bind(longest, lambda x: F.when(x == "", F.lit("{}")).otherwise(x))


def values_list(c: Column) -> Column:
    """A list of values: of one element with commas, its parts."""
    return F.when((F.size(c) == 1) & F.contains(F.get(c, F.lit(0)), F.lit(",")), F.transform(F.split(F.get(c, F.lit(0)), ","), strip)).otherwise(c)


def rank_texts(order: Column, texts: Column) -> Column:
    """Texts in the order of 0-based ``order``; places out of range are passed over, texts left out follow. Null order: as they are."""

    def place(t: Column) -> Column:
        ranked = F.transform(F.filter(F.array_distinct(t["order"]), lambda i: (i >= 0) & (i < F.size(t["texts"]))), lambda i: F.get(t["texts"], i.cast("int")))
        return bind(ranked, lambda r: F.concat(r, F.filter(t["texts"], lambda x: ~F.array_contains(r, x))))

    return F.coalesce(bind(F.struct(order.alias("order"), texts.alias("texts")), place), texts)


def choose_option(c: Column, options: Column) -> Column:
    """The option named as ``option_k``; the first if there is no such one."""
    k = F.expr("try_cast(null as int)") if c is None else F.substring_index(c, "_", -1).try_cast("int")
    return F.coalesce(F.when(k >= 1, F.get(options, k - 1)), F.get(options, F.lit(0)))


def exactly(c: Column, k: int, filler: str) -> Column:
    """The first ``k`` elements, filled up with ``filler``."""
    return F.slice(F.concat(F.coalesce(c, F.array().cast("array<string>")), F.array_repeat(F.lit(filler), k)), 1, k)


def as_cell(c: Column, kind: str) -> Column:
    """A cell as text: arrays, maps and structs as JSON, all else as it prints."""
    return F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")


def valid_against(c: Column, schema: str, required: list[str]) -> Column:
    """``ok`` and ``value``: JSON text as a struct of the schema; not ok if it can't be read or a required field is null."""
    parsed = F.from_json(c, schema)
    return bind(F.struct(parsed.alias("v")), lambda s: F.struct(F.coalesce(F.try_parse_json(c).isNotNull() & F.forall(F.array(*[s["v"][r].isNotNull() for r in required] or [F.lit(True)]), lambda there: there), F.lit(False)).alias("ok"), s["v"].alias("value")))


def keyed_list(c: Column, key: str = "columns") -> Column:
    """JSON text as an object: null as an empty list under ``key``, a list as that under ``key``, an object as it is."""
    bare = F.ltrim(c)
    return F.when(c.isNull() | (F.btrim(c) == "null"), F.lit(f'{{"{key}":[]}}')).when(F.startswith(bare, F.lit("[")), F.concat(F.lit(f'{{"{key}":'), F.btrim(c), F.lit("}"))).otherwise(c)


def example_lines(lines: Column) -> Column:
    """Examples as a list for a prompt, a line for each."""
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")


def flat_scores(c: Column, criteria: list[str]) -> list[Column]:
    """``<name>_score`` and ``<name>_reason`` of each criterion, from JSON text; null where there are none."""
    return [x for n in criteria for x in (F.get_json_object(c, f"$.{n}.score").try_cast("int").alias(f"{n}_score"), F.get_json_object(c, f"$.{n}.reasoning").alias(f"{n}_reason"))]
