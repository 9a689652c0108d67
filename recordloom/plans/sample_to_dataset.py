"""From a sample table to a larger one: seed columns, their values, permutations, and rows generated for each."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..operators import sampling, tags
from ..operators.common import saved
from ..sources.readers import names_agree, objects_of_json
from .model import ModelClient, apply_model

COLUMNS = "Which columns, not in the sample, would make its rows differ?\nTASK: columns\nWORKER: {worker}\nSAMPLE:\n{sample}"
ROWS = "Write {k} rows like the sample.\nTASK: rows\nPROMPT: {prompt}\nSEEDS: {seeds}\nCOLUMNS: {columns}\nTRY: {attempt}\nSAMPLE:\n{sample}"


EXPAND = "List all values that each of these columns may have.\nTASK: expand\nSEEDS: {names}\nPROPOSED: {proposed}\nTRY: {attempt}\nAnswer with a JSON object that has the key columns, a list of objects with column_name and all_values."
DESCRIBE = "Describe this data set.\nTASK: describe\nCONTEXT: {context}\nCOLUMNS: {columns}\nSAMPLE:\n{sample}"
PROMPT = "Write a prompt that makes rows of this data set.\nTASK: prompt\nDESCRIPTION: {description}\nSEEDS: {seeds}"


@dataclass(frozen=True)
class Options:
    """How many workers propose columns, how many are kept, rows for each seed, rows in all, and tries for each seed."""

    workers: int = 3
    max_seeds: int = 3
    rows_per_seed: int = 2
    num_records: int = 20
    retries: int = 3
    max_permutations: int = 10_000
    sample_rows: int = 25
    seed: int = 0


def _sample_text(sample: DataFrame, rows: int, seed: int) -> str:
    """Some rows of the sample as lines of JSON: no more than fit into a prompt."""
    lines = sample.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sample.columns])).alias("line"))
    return "\n".join(r["line"] for r in sampling.sample_without_replacement(lines, rows, "line", seed).collect())


def propose(spark: SparkSession, sample: DataFrame, client: ModelClient, o: Options) -> dict[str, list[str]]:
    """Seed columns and their values: proposed by several workers, each name once, none of the sample's, the best ranked."""
    shown = _sample_text(sample, o.sample_rows, o.seed)
    asked = apply_model(spark.range(o.workers).withColumn("prompt", text.render(COLUMNS, {"worker": F.col("id"), "sample": shown})), "prompt", "answer", client, "nl")
    body = jsonx.tagged_json(text.extract_output(F.col("answer")))
    parsed = F.from_json(body, "struct<columns:array<struct<column_name:string,quality_rank:string,description:string,all_values:array<string>,all_examples:array<string>>>>")["columns"]
    batches = saved(asked.select(F.col("id").alias("worker"), F.posexplode(parsed).alias("pos", "c")).select("worker", "pos", "c.*"))
    have = spark.createDataFrame([(c,) for c in sample.columns], "column_name string")
    best = tags.proposals(batches.where("column_name IS NOT NULL"), have, o.max_seeds)
    values = jsonx.values_list(F.coalesce("all_values", "all_examples"))
    return {r["column_name"]: r["v"] for r in best.select("column_name", values.alias("v")).collect() if r["v"]}


def keyed_list(data: object, key: str = "columns") -> dict:
    """Parsed JSON as an object: nothing as an empty list under ``key``, a list as that under ``key``, an object as it is."""
    if isinstance(data, dict):
        return data
    return {key: data if isinstance(data, list) else []}


def _values(column: dict) -> list[str]:
    """A column's values: a text is split at commas, as is a list of one text with commas."""
    values = column["all_values"]
    if isinstance(values, list) and len(values) == 1 and isinstance(values[0], str) and "," in values[0]:
        values = values[0]
    if isinstance(values, str):
        values = [v.strip() for v in values.split(",")]
    if not isinstance(values, list):
        raise ValueError(f"no list of values: {values!r}")
    return [str(v) for v in values if str(v).strip()]


def expand(seeds: dict[str, list[str]], client: ModelClient, tries: int = 3) -> dict[str, list[str]]:
    """Seeds with the values that the model gives for each when asked for all of them; a seed that it leaves out keeps those proposed. Raises after so many tries without a usable answer."""
    if not seeds:
        return {}
    for k in range(tries):
        answer = client.generate([EXPAND.format(names=", ".join(seeds), proposed=json.dumps(seeds, ensure_ascii=False), attempt=k)], "nl", {})[0]
        try:
            columns = keyed_list(json.loads(jsonx.repair(answer) or "null"))["columns"]
            made = {str(c["column_name"]): _values(c) for c in columns}
        except (json.JSONDecodeError, KeyError, TypeError, ValueError):
            continue
        if made:
            return {name: made.get(name) or values for name, values in seeds.items()}
    raise RuntimeError(f"no values after {tries} tries")


def _ask(client: ModelClient, prompt: str, key: str, tries: int) -> str:
    """A text under ``key`` in the answer's JSON; raises after so many tries without one."""
    for k in range(tries):
        answer = client.generate([f"{prompt}\nTRY: {k}"], "nl", {})[0]
        body = re.search("<json>(.*?)<.json>", answer, re.S)
        try:
            found = json.loads(jsonx.repair(body.group(1) if body else answer) or "{}")
        except json.JSONDecodeError:
            continue
        if isinstance(found, dict) and str(found.get(key) or "").strip():
            return str(found[key])
    raise RuntimeError(f"no {key} after {tries} tries")


def generation_prompt(sample: DataFrame, seeds: dict[str, list[str]], client: ModelClient, o: Options, context: str = "") -> str:
    """A prompt template from the model, with the seeds, some rows and the columns of the sample put after it; braces of rows are doubled."""
    shown = _sample_text(sample, o.sample_rows, o.seed)
    about = _ask(client, DESCRIBE.format(context=context, columns=sample.columns, sample=shown), "dataset_description", o.retries)
    prompt = _ask(client, PROMPT.format(description=about, seeds=", ".join(seeds)), "prompt", o.retries)
    rows = re.sub("([{}])", r"\1\1", shown)
    wanted = "\n".join(f"{name.replace('_', ' ')}: {{{name}}}" for name in seeds)
    return f"{prompt}\nUse this context:\n{wanted}\nExamples of the format:\n{rows}\nThere are only these columns: {sample.columns}"


def make_rows(seeds: DataFrame, names: list[str], columns: list[str], shown: str, prompt: str, client: ModelClient, o: Options) -> tuple[DataFrame, DataFrame]:
    """Rows for each of the ``seeds`` (``id`` and ``names``), in drawn order, and the same with the seeds; ``shown`` are the lines of the sample, ``prompt`` the template.

    An answer without rows, or whose rows together have other names than ``columns``, is asked for again, as often as the
    options say; seeds without a good answer give no rows.
    """
    todo, made = seeds, None
    for attempt in range(o.retries):
        seed_text = F.to_json(F.struct(*names)) if names else F.lit("{}")
        ask = text.render(ROWS, {"k": str(o.rows_per_seed), "prompt": text.render(prompt, {n: F.col(f"`{n}`") for n in names}), "seeds": seed_text, "columns": ", ".join(columns), "attempt": str(attempt), "sample": shown})
        answers = saved(apply_model(todo.withColumn("__prompt", ask), "__prompt", "__answer", client, "nl"))
        body = answers.select("id", jsonx.tagged_json(text.extract_output(F.col("__answer"))).alias("__json"))
        objects = saved(objects_of_json(body, "__json", ["id"]))
        fine = names_agree(objects, "id", columns).where("ok").select("id")
        rows = objects.select("id", *[F.try_element_at("object", F.lit(c)).alias(c) for c in columns])
        got = rows.join(fine, "id", "left_semi")
        made = got if made is None else made.unionByName(got)
        todo = saved(todo.join(fine, "id", "left_anti"))
        if todo.isEmpty():
            break
    joined = saved(made.withColumn("__place", F.xxhash64("id", *columns)).join(seeds, "id"))
    joined = sampling.shuffle_rows(joined, "__place", o.seed)
    return joined.select(*columns), joined.select(*columns, *[F.col(f"`{n}`") for n in names])


def run(spark: SparkSession, sample: DataFrame, client: ModelClient, options: Options = Options(), prompt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The generated rows, in drawn order, and the same with the seed columns; the prompt template comes from the model if none is given. Answers without rows, or whose rows together have other names than the sample's columns, are asked for again."""
    o = options
    new = tags.scrub_names(sample.columns)
    sample = tags.zip_rename(sample, [new[c] for c in sample.columns])
    columns = sample.columns
    seeds = expand(propose(spark, sample, client, o), client, o.retries)
    names = list(seeds)
    each = sampling.seed_permutations(spark, seeds, o.max_permutations, o.seed)
    each = saved(sampling.first_seeds(each, o.num_records, o.rows_per_seed))
    shown = _sample_text(sample, o.sample_rows, o.seed)
    prompt = prompt or generation_prompt(sample, seeds, client, o)
    return make_rows(each, names, columns, shown, prompt, client, o)
