"""Evolution of texts over generations, and improvement by several models (co-teaching and self-teaching)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, jsonx
from ..functions.binding import bind
from ..functions.text import render
from ..operators.common import saved
from .model import ModelClient, apply_model

MUTATE = "Change this text so that it is better and still fits its context.\nTASK: mutate\nCONTEXT: {context}\nTEXT: {text}\nAnswer with a JSON object that has the key mutated_text."
RANK = "Order these texts from best to worst.\nTASK: rank\nTEXTS: {texts}\nAnswer with a JSON object that has the key ranking, a list of objects with text_index."
TEACH = "Improve this text.\nTASK: improve\nTEACHER: {teacher}\nCONTEXT: {context}\nTEXT: {text}\nAnswer with a JSON object that has the key improved_text."
SELECT = "Which of these texts is best?\nTASK: select\nOPTIONS: {options}\nAnswer with a JSON object that has the key selected_option."
SUGGEST = "Suggest {k} ways to make this text better.\nTASK: suggest\nORIGINAL: {text}\nTEXT: {improved}\nAnswer with a JSON object that has the key suggestions."
SELF = "Improve this text with the help of the suggestions.\nTASK: improve\nTEACHER: self\nSUGGESTIONS: {suggestions}\nTEXT: {text}\nAnswer with a JSON object that has the key improved_text."


@dataclass(frozen=True)
class EvolutionOptions:
    """How many candidates and generations, and how often a candidate is changed."""

    population: int = 2
    generations: int = 3
    rate: float = 0.6
    seed: int = 0


@dataclass(frozen=True)
class AlignOptions:
    """How many teachers and suggestions, and the temperatures of improving and of suggesting."""

    teachers: int = 2
    suggestions: int = 3
    teach_temperature: float = 0.7
    suggest_temperature: float = 0.5


def survivors(df: DataFrame, item: str, score: Column, order: str, k: int) -> DataFrame:
    """The ``k`` rows of each item with the highest score, ties in order."""
    rank = F.row_number().over(Window.partitionBy(item).orderBy(F.desc("__score"), order))
    return df.withColumn("__score", score).withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__score", "__rank")


def distinct_texts(texts: Column) -> Column:
    """Each text once, where it is first."""
    return F.array_distinct(texts)


def _json_text(response: Column, key: str) -> Column:
    return bind(F.get_json_object(jsonx.largest_object(response), f"$.{key}"), lambda got: F.when(got.rlike(r"\S"), got))


def mutate(df: DataFrame, client: ModelClient, gate: Callable[[Column], Column]) -> DataFrame:
    """Each of ``texts`` changed by the model where ``gate`` of its place is true; where the answer is of no use it stays."""
    context = F.coalesce("context", F.lit(""))
    prompts = F.transform("texts", lambda text, n: F.when(gate(n), render(MUTATE, {"context": context, "text": text})))
    asked = apply_model(df.withColumn("__prompt", prompts), "__prompt", "__answer", client, "nl")
    changed = F.zip_with("texts", "__answer", lambda text, answer: F.coalesce(_json_text(answer, "mutated_text"), text))
    return asked.withColumn("texts", changed).drop("__prompt", "__answer")


def evolve(items: DataFrame, client: ModelClient, options: EvolutionOptions = EvolutionOptions()) -> DataFrame:
    """``items`` (``id, text, context``) with the text that is best after all generations.

    A population starts as the original and changed copies. In each generation candidates are changed with probability
    ``rate``, join the population, and the model's ranking of all candidates of an item keeps the best. A null text stays
    null. A population is an array in the row of its item, so that nothing is shuffled and equal or null ids are items of
    their own.
    """
    o = options
    start = items.withColumn("texts", F.when(F.col("text").isNotNull(), F.array_repeat("text", o.population))).drop("text")
    people = saved(mutate(start, client, lambda n: n > 0))
    for g in range(o.generations):
        own = people.withColumn("__before", F.col("texts"))
        changed = mutate(own, client, lambda n, g=g: hashing.gate(o.rate, o.seed, f"generation {g}", F.col("id"), n + o.population))
        every = changed.withColumn("texts", F.concat("__before", "texts")).drop("__before")
        prompt = F.when(F.size(F.array_distinct("texts")) > 1, render(RANK, {"texts": F.to_json(F.col("texts"))}))
        asked = apply_model(every.withColumn("__prompt", prompt), "__prompt", "__answer", client, "judge").drop("__prompt")
        order = F.from_json(F.get_json_object(jsonx.largest_object(F.col("__answer")), "$.ranking"), "array<struct<text_index:int>>")
        ranked = jsonx.rank_texts(F.transform(order, lambda x: x["text_index"]), F.col("texts"))
        people = saved(asked.withColumn("texts", F.slice(ranked, 1, o.population)).drop("__answer"))
    return people.withColumn("text", F.get("texts", F.lit(0))).drop("texts")


def align(items: DataFrame, client: ModelClient, options: AlignOptions = AlignOptions()) -> DataFrame:
    """``items`` (``id, text, context``) with ``co_taught``, ``suggestions``, ``self_taught`` and ``final``.

    Teachers improve the text one by one; the best distinct version is selected; suggestions for it are applied; and of
    original, co-taught and self-taught text one is chosen. Answers of no use fall back to what was there before.
    """
    teachers, suggestions = options.teachers, options.suggestions
    teach, suggest = {"temperature": options.teach_temperature}, {"temperature": options.suggest_temperature}
    out = items.withColumn("versions", F.array("text"))
    for t in range(teachers):
        prompt = F.when(F.col("text").isNotNull(), render(TEACH, {"teacher": str(t), "context": F.coalesce("context", F.lit("")), "text": F.col("text")}))
        out = apply_model(out.withColumn("__prompt", prompt), "__prompt", "__answer", client, "nl", teach)
        out = out.withColumn("versions", F.array_append("versions", F.coalesce(_json_text(F.col("__answer"), "improved_text"), F.col("text")))).drop("__prompt", "__answer")
    distinct = distinct_texts(F.slice("versions", 2, teachers))
    out = saved(out.withColumn("__options", distinct))
    out = _choose(out, client, "co_taught")
    prompt = F.when(F.col("text").isNotNull(), render(SUGGEST, {"k": str(suggestions), "text": F.col("text"), "improved": F.col("co_taught")}))
    out = apply_model(out.withColumn("__prompt", prompt), "__prompt", "__answer", client, "nl", suggest)
    listed = F.from_json(F.get_json_object(jsonx.largest_object(F.col("__answer")), "$.suggestions"), "array<string>")
    out = saved(out.withColumn("suggestions", jsonx.exactly(listed, suggestions, "No suggestion")).drop("__prompt", "__answer"))
    prompt = F.when(F.col("text").isNotNull(), render(SELF, {"suggestions": F.array_join("suggestions", "; "), "text": F.col("co_taught")}))
    out = apply_model(out.withColumn("__prompt", prompt), "__prompt", "__answer", client, "nl", teach)
    out = out.withColumn("self_taught", F.coalesce(_json_text(F.col("__answer"), "improved_text"), F.col("co_taught"))).drop("__prompt", "__answer")
    return _choose(out.withColumn("__options", distinct_texts(F.array("text", "co_taught", "self_taught"))), client, "final").drop("versions")


def _choose(df: DataFrame, client: ModelClient, name: str) -> DataFrame:
    prompt = F.when(F.size("__options") > 1, render(SELECT, {"options": F.to_json(F.col("__options"))}))
    asked = apply_model(df.withColumn("__prompt", prompt), "__prompt", "__answer", client, "judge")
    option = F.get_json_object(jsonx.largest_object(F.col("__answer")), "$.selected_option")
    return asked.withColumn(name, jsonx.choose_option(option, F.col("__options"))).drop("__prompt", "__answer", "__options")


def _table(df: DataFrame, id_: str) -> tuple[DataFrame, str]:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != id_)
    items = df.select(F.col(id_).alias("id"), F.to_json(F.struct(*[f.name for f in df.schema if f.name != id_])).alias("text"), F.lit(None).cast("string").alias("context"))
    return items, schema


def evolve_table(df: DataFrame, id_: str, client: ModelClient, options: EvolutionOptions = EvolutionOptions()) -> DataFrame:
    """Rows of a table evolved as lines of JSON; a row whose line can't be read any more stays as it was."""
    items, schema = _table(df, id_)
    return _rows_back(items, evolve(items, client, options).select("id", "text"), schema, id_)


def align_table(df: DataFrame, id_: str, client: ModelClient, options: AlignOptions = AlignOptions()) -> DataFrame:
    """Rows of a table improved as lines of JSON; a row whose line can't be read any more stays as it was."""
    items, schema = _table(df, id_)
    return _rows_back(items, align(items, client, options).select("id", F.col("final").alias("text")), schema, id_)


def _rows_back(items: DataFrame, changed: DataFrame, schema: str, id_: str) -> DataFrame:
    both = items.select("id", F.col("text").alias("was")).join(changed, "id")
    line = F.when(F.try_parse_json("text").isNotNull() & F.startswith(F.ltrim("text"), F.lit("{")), F.col("text")).otherwise(F.col("was"))
    return both.select(F.col("id").alias(id_), F.from_json(line, schema).alias("r")).select(id_, "r.*")
