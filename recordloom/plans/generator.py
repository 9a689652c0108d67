"""The record generator: contexts, prompts, records, evolution, validation with one repair, judge, until enough are valid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, hashing, jsonx, text
from ..operators import records, sampling
from ..operators.common import saved
from ..sources.readers import read_source
from .config import DataField, DataModel
from .model import ModelClient, infer

RECORD = "{instructions}\nTASK: record\nFIELDS: {fields}\nDESCRIPTIONS:\n{descriptions}\nCONTEXT:\n{context}\nATTEMPT: {attempt}"
FIELD = "{instructions}\nTASK: field\nFIELDS: {fields}\nDESCRIPTION: {about}\nCONTEXT:\n{context}\nSO FAR:\n{so_far}\nATTEMPT: {attempt}"
EVOLVE = "Evolve this record.\nTASK: evolve\nFIELDS: {fields}\nSTRATEGY: {strategy}\nRECORD:\n{record}\nCONTEXT:\n{context}"
JUDGE = "Is this record good? Answer PASS or FAIL and why.\nTASK: judge\nJOB: {job}\nRECORD:\n{record}"
CHECK = "Is this valid {kind}? Answer VALID or FAIL and why.\nTASK: validate\nCONTENT:\n{content}"
REPAIR = "Correct this {kind}; answer with the content only.\nTASK: {task}\nERROR: {error}\nCONTENT:\n{content}"


def contexts(spark: SparkSession, job: DataModel, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """Numbered contexts (``slot``) from the data source or the tags, and their columns; empty ones without either."""
    if job.data_source:
        df = read_source(spark, job.data_source)
        return sampling.sample_with_replacement(df, job.num_examples, df.columns[0], seed), df.columns
    if job.contextual_tags and job.contextual_tags.tags:
        rows = job.contextual_tags.rows()
        return sampling.mix_tags(spark.range(job.num_examples).withColumnRenamed("id", "slot"), "slot", rows, seed), [r[0] for r in rows]
    return sampling.empty_contexts(spark, job.num_examples), []


def _fields_of(names: list[str]) -> dict[str, Column]:
    return {n: F.col(f"`{n}`") for n in names}


def _respond(df: DataFrame, prompt: Column, out: str, client: ModelClient, job: DataModel, role: str = "nl", params: dict | None = None, whole: bool = False) -> DataFrame:
    """Cleaned answers, as :func:`infer` gives them; bytes are added to those so far."""
    asked = df.withColumn("__prompt", prompt).withColumnsRenamed({"bytes_read": "__read", "bytes_written": "__written"})
    asked = infer(asked, "__prompt", out, client, job.use_reflection, whole, role=role, params=params)
    return asked.withColumns({"bytes_read": F.col("bytes_read") + F.col("__read"), "bytes_written": F.col("bytes_written") + F.col("__written")}).drop("__prompt", "__read", "__written")


def _done_with(job: DataModel, context: list[str]) -> list[str]:
    """Context columns that no later prompt needs, so that they aren't written with each answer: all, unless records are evolved."""
    return [] if job.evolution.rate and job.evolution_generations else context


def generate(df: DataFrame, job: DataModel, client: ModelClient, context: list[str]) -> DataFrame:
    """A map ``record`` for each context, from one prompt or from one for each field in turn; without the context, unless records are to be evolved."""
    shown = text.format_record(_fields_of(context))
    if job.generation_strategy == "record":
        descriptions = text.fields_description([(f.name, f.type, f.description) for f in job.fields])
        prompt = text.render(RECORD, {"instructions": job.generation_instructions, "fields": ", ".join(f.name for f in job.fields), "descriptions": descriptions, "context": shown, "attempt": F.col("attempt")})
        df = _respond(df, prompt, "__response", client, job, params={"temperature": 0.7, "max_tokens": 4096})
        return saved(df.withColumn("record", text.parse_fields(F.col("__response"))).drop("__response", *_done_with(job, context)))
    for k, f in enumerate(job.fields):
        so_far = text.format_record({g.name: F.col(f"__field_{i}") for i, g in enumerate(job.fields[:k])})
        prompt = text.render(FIELD, {"instructions": job.generation_instructions, "fields": f.name, "about": f"{f.type}: {f.description}", "context": shown, "so_far": so_far, "attempt": F.col("attempt")})
        df = _respond(df, prompt, f"__field_{k}", client, job, params={"max_tokens": 2048}, whole=f.store_full_reflection)
        df = saved(df.withColumn(f"__field_{k}", text.parse_first_field(F.col(f"__field_{k}"))))
    made = F.create_map(*[x for k, f in enumerate(job.fields) for x in (F.lit(f.name), F.col(f"__field_{k}"))])
    return df.withColumn("record", made).drop(*[f"__field_{k}" for k in range(len(job.fields))], *_done_with(job, context))


def evolve(df: DataFrame, job: DataModel, client: ModelClient, context: list[str], seed: int) -> DataFrame:
    """Some records changed by a drawn strategy, as often as the job says; a record that comes back broken stays as it was."""
    names = [f.name for f in job.fields]
    if not job.evolution.rate:
        return df
    for g in range(job.evolution_generations):
        key = [f"evolve {g}", F.col("slot"), F.col("attempt")]
        strategy = hashing.pick(F.array(*map(F.lit, job.evolution.strategies)), hashing.u01(seed, "strategy", *key))
        shown = F.array_join(F.transform(F.map_entries("record"), lambda e: F.concat(F.lit("<<FIELD: "), e["key"], F.lit(">>\n"), F.coalesce(e["value"], F.lit("None")), F.lit("\n<<END_FIELD>>"))), "\n")
        prompt = text.render(EVOLVE, {"fields": ", ".join(names), "strategy": strategy, "record": shown, "context": text.format_record(_fields_of(context))})
        df = _respond(df, F.when(hashing.gate(job.evolution.rate, seed, *key), prompt), "__response", client, job)
        new = text.parse_fields(F.col("__response"))
        df = saved(df.withColumn("record", F.when(records.well_formed(new, names), new).otherwise(F.col("record"))).drop("__response"))
    return df


def _sql(df: DataFrame, value: str, out: str, dialect: str = "ansi") -> DataFrame:
    return code.sql_errors(df.sparkSession, df, value, dialect.lower()).withColumnRenamed("error", out)


#: Validators by name: (table, column of values, column for errors, parameter...) to the table with errors, null if there are none.
#: More can be put in; a name that isn't here asks the model.
VALIDATORS: dict[str, Callable[..., DataFrame]] = {
    "json": lambda df, value, out, *_: df.withColumn(out, jsonx.json_error(F.col(value))),
    "python": lambda df, value, out, *_: df.withColumn(out, code.python_error(F.col(value))),
    "sql": _sql,
}


def asks_model(field: DataField) -> bool:
    """Whether a field's validator is none of ``VALIDATORS``."""
    name = (field.validator or "").split(":")[0]
    return bool(name) and name.lower() not in VALIDATORS


def field_error(df: DataFrame, field: DataField, value: str, out: str, client: ModelClient, job: DataModel) -> DataFrame:
    """``df`` with the validator's message for a column of values, or null. Names that aren't in ``VALIDATORS`` ask the model."""
    name, *params = (field.validator or "").split(":")
    if not name:
        return df.withColumn(out, F.lit(None).cast("string"))
    if name.lower() in VALIDATORS:
        return VALIDATORS[name.lower()](df, value, out, *params)
    prompt = F.when(F.col(value).isNotNull(), text.render(CHECK, {"kind": field.validator, "content": F.col(value)}))
    return _respond(df, prompt, "__verdict", client, job, "judge", {"temperature": 0.1}).withColumn(out, records.verdict(F.col("__verdict"))).drop("__verdict")


def validate(df: DataFrame, job: DataModel, client: ModelClient) -> DataFrame:
    """``valid`` and ``reason``: fields in order, each with one repair, stopping at the first that fails; then the judge. What it gives is kept in the shared folder."""
    names = [f.name for f in job.fields]
    df = df.withColumns({f"__v{k}": F.try_element_at("record", F.lit(n)) for k, n in enumerate(names)})
    df = df.withColumn("reason", F.coalesce(*[F.when(F.col(f"__v{k}").isNull(), F.lit(f"field {n} is missing")) for k, n in enumerate(names)], F.lit(None).cast("string")))
    for k, f in enumerate(job.fields):
        if not f.validator:
            continue
        value = f"__v{k}"
        kept = saved if asks_model(f) else (lambda checked: checked)  # only answers are worth keeping by themselves
        df = kept(field_error(df.withColumn("__try", F.when(F.col("reason").isNull(), F.col(value))), f, "__try", "__error", client, job))
        task = {"sql": "fix_sql", "python": "fix_python"}.get(f.validator.split(":")[0].lower(), "correct")
        prompt = F.when(F.col("__error").isNotNull(), text.render(REPAIR, {"kind": f.type.upper(), "task": task, "error": F.col("__error"), "content": F.col(value)}))
        df = saved(_respond(df, prompt, "__fixed", client, job, "code", {"temperature": 0.2}, whole=f.store_full_reflection))
        changed = F.col("__fixed").isNotNull() & (F.col("__fixed") != F.col(value))
        df = kept(field_error(df.withColumn("__try", F.when(changed, F.col("__fixed"))), f, "__try", "__again", client, job))
        failed = F.col("__error").isNotNull() & (~F.coalesce(changed, F.lit(False)) | F.col("__again").isNotNull())
        df = df.withColumn("reason", F.coalesce("reason", F.when(failed, F.coalesce("__again", "__error"))))
        df = df.withColumn(value, F.when(F.col("__error").isNotNull() & changed, F.col("__fixed")).otherwise(F.col(value))).drop("__try", "__error", "__fixed", "__again")
    shown = text.format_record({n: F.col(f"__v{k}") for k, n in enumerate(names)})
    prompt = F.when(F.col("reason").isNull(), text.render(JUDGE, {"job": job.generation_instructions, "record": shown}))
    df = saved(_respond(df, prompt, "__judge", client, job, "judge", {"temperature": 0.1}))
    df = df.withColumn("reason", F.coalesce("reason", F.when(~records.passes(F.col("__judge")), F.col("__judge")))).withColumn("valid", F.col("reason").isNull())
    return df.drop("__judge", "record")


@dataclass
class Result:
    """Valid records, all attempts with their verdicts, and the counts."""

    records: DataFrame
    attempts: DataFrame
    successes: int
    failures: int


def run(spark: SparkSession, job: DataModel, client: ModelClient, seed: int = 0, max_rounds: int = 10) -> Result:
    """Generate until ``num_examples`` records are valid, or for ``max_rounds``; contexts are used in turn.

    The first round makes as many attempts as records are asked for; later ones half again as many as are missing, for
    rounds cost more than attempts. Attempts after the last record that was needed are dropped. Attempts carry ``bytes_read``, ``bytes_written`` and their ratio to
    the bytes of the record.
    """
    ctx, columns = contexts(spark, job, seed)
    ctx = saved(ctx)
    n_contexts = max(1, ctx.count())
    names = [f.name for f in job.fields]
    tried: DataFrame | None = None
    successes = done = 0
    for k in range(max_rounds):
        missing = job.num_examples - successes
        if missing <= 0:
            break
        tries = missing if k == 0 else missing + missing // 2 + 4
        slots = spark.range(done, done + tries).select(F.col("id").alias("attempt"), F.pmod("id", F.lit(n_contexts)).alias("slot"))
        df = slots.join(ctx, "slot").withColumn("bytes_read", F.lit(0).cast("long")).withColumn("bytes_written", F.lit(0).cast("long"))
        made = evolve(generate(df, job, client, columns), job, client, columns, seed).drop(*columns)
        df = validate(made, job, client)
        tried = df if tried is None else tried.unionByName(df)
        valid = df.where("valid").count()
        if valid > missing:  # the attempts after the last that is needed don't count
            last = df.where("valid").select("attempt").orderBy("attempt").limit(missing).agg(F.max("attempt")).first()[0]
            tried, valid, tries = tried.where(F.col("attempt") <= last), missing, last + 1 - done
        done += tries
        successes += valid
    if tried is None:
        tried = ctx.select("slot").limit(0).withColumns({"attempt": F.lit(0).cast("long"), "bytes_read": F.lit(0).cast("long"), "bytes_written": F.lit(0).cast("long"), "valid": F.lit(True), "reason": F.lit("")} | {f"__v{k}": F.lit("") for k in range(len(names))})
    whole = tried.where("valid").select("attempt", "slot", *[f"__v{k}" for k in range(len(names))]).join(ctx.select("slot", *[F.col(f"`{c}`") for c in columns]), "slot")
    out = records.merged(whole, ["attempt", *columns], {n: F.col(f"__v{k}") for k, n in enumerate(names)})
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"__v{k}").alias(n) for k, n in enumerate(names)])))
    attempts = tried.select("attempt", "slot", "valid", "reason", "bytes_read", "bytes_written", ((F.col("bytes_read") + F.col("bytes_written")) / size).alias("overhead"))
    return Result(out, attempts, successes, done - successes)
