"""Text-to-code records: domains, topics and levels, a request, code, a rubric's scores, and checks of the code."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, hashing, jsonx, text
from ..operators import sampling
from ..operators.common import saved
from .config import AutoConfig, ManualConfig
from .model import ModelClient, apply_model
from .pipeline import PromptSuite, register_prompts

KINDS = ["question", "instruction", "scenario", "review"]
CRITERIA = {"sql": ["relevance", "correctness", "readability", "scalability", "standards"], "python": ["relevance", "correctness", "readability", "efficiency", "pythonic"]}
LIST = "List {k} {what}, as a JSON list.\nTASK: list\nFOR: {about}\nLANGUAGE: {lang}"
CONTEXT = "Write {k} tables with views for this topic.\nTASK: sql\nDOMAIN: {domain}\nTOPIC: {topic}\nLEVEL: {level}\nSLOT: {slot}"
REQUEST = "Write a {kind} in plain words that {lang} code can answer.\nTASK: text\nDOMAIN: {domain}\nTOPIC: {topic}\nLEVEL: {level}\nCONTEXT: {context}\nSLOT: {slot}"
CODE = "Write {lang} code.\nTASK: {lang}\nREQUEST: {request}\nCONTEXT: {context}"
RUBRIC = "Score this code from 0 to 4 by each criterion.\nTASK: rubric\nCRITERIA: {criteria}\nREQUEST: {request}\nCONTEXT: {context}\nCODE: {code}"

SUITE = register_prompts(PromptSuite("text-to-code", {"list": LIST, "context": CONTEXT, "request": REQUEST, "code": CODE, "rubric": RUBRIC}))


def _lists(client: ModelClient, k: int, what: str, about: str, lang: str) -> list[str]:
    answer = client.generate([LIST.format(k=k, what=what, about=about, lang=lang)], "nl", {})[0]
    try:
        values = json.loads(jsonx.repair(answer) or "[]")
    except json.JSONDecodeError:
        values = []
    return list(dict.fromkeys(str(v) for v in values))[:k]


def tag_tree(config: AutoConfig | ManualConfig, client: ModelClient) -> tuple[dict[str, list[str]], list[str]]:
    """Domains with topics, and levels: as given, and from the model what is missing."""
    if isinstance(config, AutoConfig):
        domains = {d: [] for d in _lists(client, config.num_domains, "domains", "anything", config.code_lang)}
        levels = _lists(client, config.num_complexity_levels, "levels of complexity", "code", config.code_lang)
    else:
        domains, levels = {d: list(t or []) for d, t in config.domain_and_topics.items()}, list(config.complexity_levels)
    for domain, topics in domains.items():
        if not topics:
            domains[domain] = _lists(client, config.num_topics_per_domain, "topics", domain, config.code_lang)
    return {d: t for d, t in domains.items() if t}, levels


def run(spark: SparkSession, config: AutoConfig | ManualConfig, client: ModelClient, n: int, seed: int = 0, prompts: PromptSuite = SUITE) -> DataFrame:
    """``n`` records, without those that the model left empty.

    SQL: ``uid, domain, topic, complexity, sql_context, full_prompt, nl_type, natural_language, code``, five scores with
    reasons, ``syntax_validation``. Python has ``suggested_packages`` for ``sql_context`` and ``semantic_validation`` besides.
    """
    lang = config.code_lang.lower()
    if lang not in CRITERIA:
        raise ValueError(f"unknown language: {config.code_lang}")
    tree, levels = tag_tree(config, client)
    df = sampling.hierarchical_draw(spark.range(n).withColumnRenamed("id", "slot"), "slot", tree, levels, seed)
    df = df.withColumn("uid", hashing.digest(seed, "uid", F.col("slot"))).withColumn("nl_type", hashing.pick(F.array(*map(F.lit, KINDS)), hashing.u01(seed, "kind", F.col("slot"))))
    tag = {"domain": F.col("domain"), "topic": F.col("topic"), "level": F.col("complexity"), "slot": F.col("slot")}
    if lang == "sql":
        k = hashing.integer(3, 6, hashing.u01(seed, "tables", F.col("slot")))
        df = saved(apply_model(df.withColumn("__p", prompts.fill("context", {"k": k, **tag})), "__p", "__a", client, "code", suite=True))
        df = df.withColumn("sql_context", text.extract_code(F.col("__a"))).drop("__p", "__a")
        context = F.col("sql_context")
    else:
        every = _lists(client, 20, "packages", "python", lang) or ["json"]
        k = hashing.integer(5, 8, hashing.u01(seed, "packages", F.col("slot")))
        df = df.withColumn("suggested_packages", sampling.subset(F.array(*map(F.lit, every)), k, seed, F.col("slot")))
        context = F.array_join("suggested_packages", ", ")
    df = saved(apply_model(df.withColumn("__p", prompts.fill("request", {"kind": F.col("nl_type"), "lang": lang, "context": context, **tag})), "__p", "__a", client, "nl", suite=True))
    df = df.withColumn("natural_language", text.unquote(text.strip(F.col("__a")))).drop("__p", "__a")
    df = df.withColumn("full_prompt", prompts.fill("code", {"lang": lang, "request": F.col("natural_language"), "context": context}))
    df = saved(apply_model(df, "full_prompt", "__a", client, "code", suite=True)).withColumn("code", text.extract_code(F.col("__a"))).drop("__a")
    ask = prompts.fill("rubric", {"criteria": ", ".join(CRITERIA[lang]), "request": F.col("natural_language"), "context": context, "code": F.col("code")})
    df = saved(apply_model(df.withColumn("__p", ask), "__p", "__a", client, "judge", suite=True))
    df = df.select("*", *jsonx.flat_scores(jsonx.largest_object(F.col("__a")), CRITERIA[lang]))
    df = df.drop("__p", "__a").where(F.col("code").rlike(r"\S") & F.col("natural_language").rlike(r"\S"))
    if config.syntax_validation:
        df = code.sql_errors(spark, df, "code") if lang == "sql" else df.withColumn("error", code.python_error(F.col("code")))
        df = df.withColumn("syntax_validation", F.coalesce("error", F.lit("passed"))).drop("error")
    if lang == "python":
        df = df.withColumn("semantic_validation", code.semantic_score(F.col("code")) if config.semantic_validation else F.lit(None).cast("double"))
    first = ["uid", "domain", "topic", "complexity", "sql_context" if lang == "sql" else "suggested_packages", "full_prompt", "nl_type", "natural_language", "code"]
    return df.select(*first, *[c for c in df.columns if c not in (*first, "slot")])
