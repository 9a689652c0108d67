"""Queries that exercise each operator on the test tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, hashing, jsonx, text
from ..operators import analytics, records, sampling, tags
from ..operators.common import shared_dir, spread
from ..sources import readers
from ..streaming import flows
from . import configgen, evolution, generator, sample_to_dataset, validation
from . import nl2code as nl2code_plan
from .config import AutoConfig, DataField, DataModel, DataSource, Evolution, Tag, Tags
from .model import OfflineModel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None) -> Callable:
    """Register a function of the named tables."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def U(seed: int, *keys: str) -> str:
    """SQL for hashing.u01."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0)"


_WORDS = "amber basin cedar delta ember field grove harbor island juniper kernel lantern meadow north orchard prairie".split()


def FILLED(template: str, **values: str) -> str:
    """SQL for a prompt template with SQL expressions for its placeholders."""
    parts = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(f"({values[p]})" if k % 2 else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for k, p in enumerate(parts)) + ")"


def DRAW(template: str, salt: str, n: int, **values: str) -> str:
    """SQL for the offline model's draw of 0 to ``n`` - 1 from a prompt."""
    return f"floor(('0x' || substr(md5('0|{salt}|' || {FILLED(template, **values)}), 1, 8))::BIGINT / 4294967296.0 * {n})::INT"


def PHRASE(template: str, salt: str, **values: str) -> str:
    """SQL for the offline model's phrase for a prompt."""
    prompt = FILLED(template, **values)
    return f"array_to_string([{_WORDS}[1 + floor(('0x' || substr(md5('0|{salt}' || i || '|' || {prompt}), 1, 8))::BIGINT / 4294967296.0 * 16)::INT] for i in range(6)], ' ')"


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


# Scans, projections, filters

def scan_project_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields of a Parquet export."""
    return readers.read_source(spark, DataSource(f"{sf_dir}/documents.parquet", "huggingface", ["doc_id", "lang"]))


QUERIES["scan_project_fields"], SQL["scan_project_fields"] = scan_project_fields, "SELECT doc_id, lang FROM documents"


@query("required_fields_valid", "documents", "labels", sql="""
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 'text' WHEN l.quality IS NULL THEN 'quality' WHEN l.toxic IS NULL THEN 'toxic' END AS missing
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def required_fields_valid(documents, labels):
    return documents.join(labels, "doc_id", "left").select("doc_id", records.missing_field(["text", "quality", "toxic"]).alias("missing"))


@query("context_record_merge", "orders", "customer", sql="""
SELECT o_orderkey AS id, c_mktsegment AS segment, o_orderpriority AS priority, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS size
FROM orders JOIN customer ON o_custkey = c_custkey""")
def context_record_merge(orders, customer):
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit("?").alias("size"), "o_orderpriority", "o_totalprice")
    return records.merged(both, ["id", "segment", "size"], {"priority": F.col("o_orderpriority"), "size": F.when(F.col("o_totalprice") > 100000, "large").otherwise("small")})


@query("judge_gate", "labels", sql="""
SELECT doc_id, response, NOT contains(response, 'FAIL') AS passed, CASE WHEN contains(response, 'FAIL') THEN trim(response) END AS error
FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN ' FAIL: toxic ' WHEN quality = 0 THEN 'fail but in small letters' ELSE 'PASS' END AS response FROM labels)""")
def judge_gate(labels):
    response = F.when(F.col("toxic") == 1, " FAIL: toxic ").when(F.col("quality") == 0, "fail but in small letters").otherwise("PASS")
    judged = labels.select("doc_id", response.alias("response"))
    return judged.select("*", records.passes(F.col("response")).alias("passed"), records.verdict(F.col("response")).alias("error"))


@query("flag_filters", "labels", sql="SELECT doc_id, (quality = 1 AND toxic = 0) AS clean FROM labels WHERE quality IS NOT NULL AND (quality = 1 AND toxic = 0) IS NOT NULL AND NOT (quality = 0 AND toxic = 1)")
def flag_filters(labels):
    kept = records.flagged(labels.where("quality IS NOT NULL"), (F.col("quality") == 1) & (F.col("toxic") == 0), ~((F.col("quality") == 0) & (F.col("toxic") == 1)))
    return kept.select("doc_id", F.col("flag").alias("clean"))


@query("coalesce_dialects", "documents", sql="""
SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN source = 'src0' THEN 'hot' END, CASE WHEN n_chars > 2000 THEN 'long' END, 'other') AS verdict FROM documents""")
def coalesce_dialects(documents):
    return documents.select("doc_id", records.first_verdict((F.col("lang") == "en", "english"), (F.col("source") == "src0", "hot"), (F.col("n_chars") > 2000, "long"), default="other").alias("verdict"))


# Generators and samplers

_MIX = [("complexity", ["low", "medium", "high"], [0.5, None, 0.25]), ("topic", ["math", "music", "law", "sport"], [None] * 4)]


def _case(seed: int, name: str, values: list[str], weights: list[float | None], key: str) -> str:
    full = [1.0 if w is None else w for w in weights]
    total, running, out = sum(full), 0.0, "CASE "
    for v, w in zip(values[:-1], full[:-1], strict=True):
        running += w
        out += f"WHEN {U(seed, repr(name), key)} * {total} < {running} THEN '{v}' "
    return out + f"ELSE '{values[-1]}' END AS {name}"


@query("weighted_tag_mix", "orders", sql=f"SELECT o_orderkey, {', '.join(_case(7, *t, 'o_orderkey') for t in _MIX)} FROM orders")
def weighted_tag_mix(orders):
    return sampling.mix_tags(orders.select("o_orderkey"), "o_orderkey", _MIX, seed=7)


@query("sample_with_replacement", "documents", sql=f"""
WITH d AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT slot, doc_id, lang FROM (SELECT range AS slot, floor({U(11, "'row'", 'range')} * (SELECT count(*) FROM documents))::BIGINT AS i FROM range(0, (SELECT count(*) FROM documents))) s JOIN d USING (i)""")
def sample_with_replacement(documents):
    return sampling.sample_with_replacement(documents.select("doc_id", "lang"), 1 << 40, "doc_id", seed=11)


@query("sample_without_replacement", "documents", sql="SELECT doc_id, lang FROM documents ORDER BY md5(concat_ws('|', '5', doc_id)), doc_id LIMIT 25")
def sample_without_replacement(documents):
    return sampling.sample_without_replacement(documents.select("doc_id", "lang"), 25, "doc_id", seed=5)


@query("hierarchical_draw", "customer", sql=f"""
WITH d AS (SELECT c_custkey, ['sql', 'web'][1 + floor({U(3, "'domain'", 'c_custkey')} * 2)::INT] AS domain FROM customer)
SELECT c_custkey, domain, CASE domain WHEN 'sql' THEN ['joins', 'windows', 'sets'][1 + floor({U(3, "'topic'", 'c_custkey')} * 3)::INT] ELSE ['css', 'http'][1 + floor({U(3, "'topic'", 'c_custkey')} * 2)::INT] END AS topic,
  ['easy', 'hard'][1 + floor({U(3, "'complexity'", 'c_custkey')} * 2)::INT] AS complexity FROM d""")
def hierarchical_draw(customer):
    return sampling.hierarchical_draw(customer.select("c_custkey"), "c_custkey", {"sql": ["joins", "windows", "sets"], "web": ["css", "http"]}, ["easy", "hard"], seed=3)


_A, _B, _C = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(15)], [f"c{i}" for i in range(11)]
QUERIES["seed_permutations"] = lambda spark, sf_dir: sampling.seed_permutations(spark, {"a": _A, "b": _B, "c": _C}, 500, seed=2)
_ROUND = "('0x' || substr(md5(concat_ws('|', '2', '{k}', {other})), 1, 15))::BIGINT"
SQL["seed_permutations"] = f"""
WITH r0 AS (SELECT range AS id, range // 165 AS l, range % 165 AS r FROM range(0, 500)),
r1 AS (SELECT id, (l + {_ROUND.format(k=0, other='r')}) % 12 AS l, r FROM r0),
r2 AS (SELECT id, l, (r + {_ROUND.format(k=1, other='l')}) % 165 AS r FROM r1),
r3 AS (SELECT id, (l + {_ROUND.format(k=2, other='r')}) % 12 AS l, r FROM r2),
r4 AS (SELECT id, l, (r + {_ROUND.format(k=3, other='l')}) % 165 AS r FROM r3)
SELECT id, 'a' || l AS a, 'b' || (r // 11) AS b, 'c' || (r % 11) AS c FROM r4"""


@query("round_robin_contexts", "events", "nation", sql="""
SELECT event_id, n_name FROM events JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation) ON event_id % n = i""")
def round_robin_contexts(events, nation):
    return sampling.round_robin(events.select("event_id"), "event_id", nation.select("n_nationkey", "n_name"), "n_nationkey").drop("n_nationkey")


@query("bernoulli_gate_and_integers", "orders", sql=f"SELECT o_orderkey, {U(9, chr(39) + 'evolve' + chr(39), 'o_orderkey')} < 0.3 AS evolve, 3 + floor({U(9, chr(39) + 'k' + chr(39), 'o_orderkey')} * 3)::INT AS k FROM orders")
def bernoulli_gate_and_integers(orders):
    key = F.col("o_orderkey")
    return orders.select("o_orderkey", hashing.gate(0.3, 9, "evolve", key).alias("evolve"), hashing.integer(3, 6, hashing.u01(9, "k", key)).alias("k"))


@query("diversity_product", "part", sql="""
SELECT round(product(n::DOUBLE)) AS diversity FROM (SELECT count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT count(DISTINCT p_type) FROM part UNION ALL SELECT count(DISTINCT p_size) FROM part)""")
def diversity_product(part):
    long = part.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in ("p_brand", "p_type", "p_size")])).alias("t")).select("t.*")
    return tags.diversity(long)


# Text

@query("parse_delimited_record", "conversations", sql=rf"""
SELECT conv_id, turn, trim(coalesce(role, 'None')) AS role, {STRIP.format('text')} AS body FROM conversations""")
def parse_delimited_record(conversations):
    response = F.concat(F.lit("preface\n"), text.format_record({"body": F.lit("overwritten"), "role": F.col("role")}), F.lit("\n"), text.format_record({"body": F.col("text")}))
    parsed = conversations.select("conv_id", "turn", text.parse_fields(response).alias("m"))
    return parsed.select("conv_id", "turn", F.col("m")["role"].alias("role"), F.col("m")["body"].alias("body"))


@query("parse_first_field", "documents", sql=rf"SELECT doc_id, {STRIP.format('text')} AS body FROM documents")
def parse_first_field(documents):
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x <<FIELD: any>>\n"), F.col("text"), F.lit("\n<<END_FIELD>> y"))).otherwise(F.col("text"))
    return documents.select("doc_id", text.parse_first_field(wrapped).alias("body"))


@query("format_record", "labels", sql="""
SELECT doc_id, concat('<<FIELD: quality>>', chr(10), coalesce(quality::VARCHAR, 'None'), chr(10), '<<END_FIELD>>', chr(10), '<<FIELD: toxic>>', chr(10), coalesce(nullif(toxic, 0)::VARCHAR, 'None'), chr(10), '<<END_FIELD>>') AS record FROM labels""")
def format_record(labels):
    return labels.select("doc_id", text.format_record({"quality": F.col("quality"), "toxic": F.nullif("toxic", F.lit(0))}).alias("record"))


@query("reflection_split", "conversations", sql=rf"""
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '<thinking>' || {STRIP.format('text')} || '</thinking>' ELSE '' END AS thinking, {STRIP.format('text')} AS output FROM conversations""")
def reflection_split(conversations):
    wrapped = F.when(F.col("role") == "assistant", F.concat(F.lit("a <thinking>"), text.strip(F.col("text")), F.lit("</thinking> b <output>\n"), F.col("text"), F.lit("</output>"))).otherwise(F.concat(F.lit("<output>"), F.col("text")))
    parts = conversations.select("conv_id", "turn", text.split_reflection(wrapped).alias("s"))
    return parts.select("conv_id", "turn", "s.thinking", "s.output")


@query("strip_thinking", "conversations", sql=r"""
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(wrapped, '(?is)<thinking>.*?</thinking>', '', 'g'), '(?is)<thinking>.*', ''), '^\s+|\s+$', '', 'g'), '\n{2,}', chr(10), 'g') AS clean
FROM (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN '<Thinking>one' || chr(10) || 'two</THINKING>' || text || '<thinking>x</thinking>' WHEN 'user' THEN text || '<thinking>open' || text ELSE text END AS wrapped FROM conversations)""")
def strip_thinking(conversations):
    wrapped = F.when(F.col("role") == "assistant", F.concat(F.lit("<Thinking>one\ntwo</THINKING>"), F.col("text"), F.lit("<thinking>x</thinking>"))).when(F.col("role") == "user", F.concat(F.col("text"), F.lit("<thinking>open"), F.col("text"))).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", text.remove_thinking(wrapped).alias("clean"))


@query("extract_output_fallbacks", "conversations", sql=rf"""
SELECT conv_id, turn, CASE role WHEN 'assistant' THEN {STRIP.format('text')} WHEN 'user' THEN {STRIP.format("text")} ELSE 'No output content found' END AS output,
  CASE role WHEN 'assistant' THEN 'why' WHEN 'user' THEN 'how' ELSE 'No thinking content found' END AS thinking FROM conversations""")
def extract_output_fallbacks(conversations):
    body = F.col("text")
    wrapped = F.when(F.col("role") == "assistant", F.concat(F.lit("<thinking>why</thinking> so <output> </output><output>"), body, F.lit("</output> end"))).when(F.col("role") == "user", F.concat(F.lit("<thinking>how</thinking>\n"), body)).otherwise(body)
    return conversations.select("conv_id", "turn", text.extract_output(wrapped).alias("output"), text.extract_thinking(wrapped).alias("thinking"))


@query("extract_code_block", "documents", sql=rf"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {STRIP.format('text')} WHEN 1 THEN '' ELSE text END AS code FROM documents")
def extract_code_block(documents):
    k = F.col("doc_id") % 3
    wrapped = F.when(k == 0, F.concat(F.lit("Here:\n```sql\n"), F.col("text"), F.lit("\n```\nbye"))).when(k == 1, F.concat(F.lit("```"), F.col("text"))).otherwise(F.col("text"))
    return documents.select("doc_id", text.extract_code(wrapped).alias("code"))


@query("fenced_blocks", "documents", sql=rf"SELECT doc_id, {STRIP.format('text')} AS js, {STRIP.format('text')} AS ym, 'see ' || {STRIP.format('text')} || ' end' AS plain FROM documents")
def fenced_blocks(documents):
    c = F.col("text")
    return documents.select(
        "doc_id", text.json_block(F.concat(F.lit("a ```json\n"), c, F.lit("\n``` b"))).alias("js"), text.yaml_block(F.concat(F.lit("```yaml\n"), c, F.lit("```"))).alias("ym"),
        text.unwrap_code(F.concat(F.lit("see ```python\n"), c, F.lit("\n``` end"))).alias("plain"),
    )


@query("safe_names", "part", sql=r"""
SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-zA-Z0-9_]', '_', 'g'), '_') AS safe,
  CASE WHEN regexp_matches(p_brand, '^[0-9]') THEN 'db_' ELSE '' END || lower(translate(p_brand, ' -', '__')) AS db FROM part""")
def safe_names(part):
    return part.select("p_partkey", text.safe_name(F.col("p_name")).alias("safe"), text.database_name(F.col("p_brand")).alias("db"))


@query("split_statements", "part", sql="SELECT p_partkey, len(list_filter(list_transform(string_split('SELECT ' || p_name || '; ;DROP ' || p_brand, ';'), lambda x: trim(x)), lambda x: x <> '')) AS n, 'DROP ' || trim(p_brand) || ';' AS last FROM part")
def split_statements(part):
    statements = text.split_statements(F.concat(F.lit("SELECT "), F.col("p_name"), F.lit("; ;DROP "), F.col("p_brand")))
    return part.select("p_partkey", F.size(statements).cast("long").alias("n"), F.element_at(statements, -1).alias("last"))


@query("qualify_tables", "nation", sql="""
SELECT n_nationkey, 'SELECT EXTRACT(YEAR FROM d) FROM ds.t_' || n_nationkey || ' JOIN ds.u ON 1 = 1' AS q, 'CREATE TABLE `ds.t` (a INT); INSERT INTO `ds.t` VALUES (' || n_nationkey || ')' AS ddl FROM nation""")
def qualify_tables(nation):
    key = F.col("n_nationkey").cast("string")
    q = F.concat(F.lit("SELECT EXTRACT(YEAR FROM d) FROM t_"), key, F.lit(" JOIN u ON 1 = 1"))
    return nation.select("n_nationkey", text.qualify_query(q, "ds").alias("q"), text.qualify_ddl(text.repair_ddl_newlines(F.concat(F.lit("CREATE\nTABLE t (a INT); INSERT\nINTO t VALUES ("), key, F.lit(")"))), "ds").alias("ddl"))


@query("render_template", "orders", sql="SELECT o_orderkey, 'Order {' || o_orderkey || '} is ' || o_orderstatus || ' / ' || o_orderpriority AS prompt FROM orders")
def render_template(orders):
    return orders.select("o_orderkey", text.render("Order {{{k}}} is {s} / {p}", {"k": F.col("o_orderkey"), "s": F.col("o_orderstatus"), "p": F.col("o_orderpriority")}).alias("prompt"))


@query("fill_seed_templates", "part", sql="SELECT p_partkey, 'about ' || p_brand || ' of size ' || p_size || ', ' || p_brand AS prompt FROM part")
def fill_seed_templates(part):
    return part.select("p_partkey", text.fill_seeds(F.lit("about {the_brand} of size {size}, {the_brand}"), {"the brand": F.col("p_brand"), "size": F.col("p_size")}).alias("prompt"))


@query("chat_flatten", "conversations", sql="""
SELECT conv_id, CASE WHEN count(*) = 1 THEN any_value(text) ELSE string_agg(upper(role) || ':' || chr(10) || text || chr(10) || '---', chr(10) || chr(10) ORDER BY turn) END AS joined FROM conversations GROUP BY conv_id""")
def chat_flatten(conversations):
    return text.chat_parts(conversations, "conv_id", "turn", "role", "text")


@query("byte_accounting", "conversations", sql="""
SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN strlen(text) ELSE 0 END)::BIGINT AS bytes_read, sum(CASE WHEN role = 'assistant' THEN strlen(text) ELSE 0 END)::BIGINT AS bytes_written, sum(strlen(role))::BIGINT AS bytes_out,
  sum(strlen(text)) / sum(strlen(role)) AS overhead FROM conversations GROUP BY conv_id""")
def byte_accounting(conversations):
    answer = F.col("role") == "assistant"
    return analytics.byte_counts(conversations, "conv_id", [F.when(~answer, F.col("text"))], [F.when(answer, F.col("text"))], F.col("role"))


@query("text_utilities", "part", sql="""
SELECT p_partkey, p_brand AS unquoted, len(string_split(p_name || ', ' || p_type, ',')) AS n_parts, CASE WHEN p_size % 2 = 0 THEN 'maker' END AS provider, '{{' || p_size || '}}' AS escaped, (p_size % 2 = 0) AS no_scale, (p_size % 3 = 0) AS incomplete FROM part""")
def text_utilities(part):
    even, third = F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    size = F.col("p_size").cast("string")
    return part.select(
        "p_partkey", text.unquote(F.concat(F.lit('"'), F.col("p_brand"), F.lit('"'))).alias("unquoted"), F.size(text.split_list(F.concat_ws(", ", "p_name", "p_type"))).cast("long").alias("n_parts"),
        text.model_provider(F.when(even, F.lit("maker/model/x")).otherwise("model")).alias("provider"), text.escape_braces(F.concat(F.lit("{"), size, F.lit("}"))).alias("escaped"),
        text.decimal_without_scale(F.when(even, F.lit("a DECIMAL(10)")).otherwise("a DECIMAL(10,2), b decimal(3)")).alias("no_scale"),
        text.incomplete_code(F.when(third, F.lit("x = 1\n# ... rest")).otherwise("x = 1 # done")).alias("incomplete"),
    )


# JSON, arrays, maps

@query("json_valid_props", "events", sql="SELECT event_id, CASE WHEN event_id % 3 = 0 THEN false ELSE true END AS ok FROM events")
def json_valid_props(events):
    broken = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return events.select("event_id", jsonx.json_error(broken).isNull().alias("ok"))


@query("json_repair_props", "events", sql="SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_repair_props(events):
    broken = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<json>"), F.replace("props", F.lit('"'), F.lit("'")), F.lit("</json>"))).otherwise(F.replace("props", F.lit("}"), F.lit(",")))
    return events.select("event_id", F.get_json_object(jsonx.tagged_json(broken), "$.k").cast("long").alias("k"))


@query("json_candidates_largest", "events", sql="""SELECT event_id, 2::BIGINT AS n, '{"k": 1, "name": "' || event_type || '"}' AS largest FROM events""")
def json_candidates_largest(events):
    response = F.concat(F.lit('first {"a": 1} then {bad json} and {"k": 1, "name": "'), F.col("event_type"), F.lit('"} TERMINATE'))
    return events.select("event_id", F.size(jsonx.objects_in(response)).cast("long").alias("n"), jsonx.largest_object(response).alias("largest"))


@query("jsonl_roundtrip", "nation", sql="SELECT n_regionkey, count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation GROUP BY n_regionkey")
def jsonl_roundtrip(nation):
    lines = analytics.joined_text(nation.withColumn("line", F.to_json(F.struct("n_nationkey", "n_name"))), "n_regionkey", "n_nationkey", F.col("line"), "\n")
    rows = readers.lines_of_json(lines, "joined", "n_nationkey bigint, n_name string", ["n_regionkey"])
    return rows.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("total"))


@query("normalise_values_list", "part", sql="SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_brand, p_type] ELSE [p_brand, p_name, 'x, y'] END AS vals FROM part")
def normalise_values_list(part):
    raw = F.when(F.col("p_size") % 2 == 0, F.array(F.concat_ws(", ", "p_brand", "p_type"))).otherwise(F.array("p_brand", "p_name", F.lit("x, y")))
    return part.select("p_partkey", jsonx.values_list(raw).alias("vals"))


@query("ranking_merge", "benchmark", sql="SELECT item_id, ['c', 'a', 'b', 'd'] AS ranked, CASE WHEN item_id % 2 = 0 THEN 'b' ELSE 'a' END AS chosen, ['a', 'b', '-'] AS padded FROM benchmark")
def ranking_merge(benchmark):
    four = F.array(*map(F.lit, "abcd"))
    option = F.when(F.col("item_id") % 2 == 0, "option_2").otherwise("option_99")
    return benchmark.select("item_id", jsonx.rank_texts(F.array(*map(F.lit, (2, 0, 9, 2))), four).alias("ranked"), jsonx.choose_option(option, four).alias("chosen"), jsonx.exactly(F.array(F.lit("a"), F.lit("b")), 3, "-").alias("padded"))


@query("ordered_set_functions", "customer", sql="""
SELECT c_custkey, list_sort(['x', c_mktsegment]) AS sym, c_mktsegment = 'BUILDING' AS has FROM customer""")
def ordered_set_functions(customer):
    a, b = F.array(F.lit("x"), F.lit("both")), F.array(F.lit("both"), F.col("c_mktsegment"))
    return customer.select("c_custkey", F.array_sort(tags.symmetric_difference(a, b)).alias("sym"), (F.size(F.array_intersect(F.array(F.lit("BUILDING")), b)) == 1).alias("has"))


@query("coerce_complex_to_string", "events", sql="""SELECT event_id, '["' || event_type || '","x"]' AS arr, user_id::VARCHAR AS num FROM events""")
def coerce_complex_to_string(events):
    return events.select("event_id", jsonx.as_cell(F.array("event_type", F.lit("x")), "array<string>").alias("arr"), jsonx.as_cell(F.col("user_id"), "bigint").alias("num"))


# Tags, seeds, joins, sets

@query("tag_union_ci", "part", sql="""
SELECT name, value, added FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(name), lower(value) ORDER BY added, pos) AS k FROM (
    SELECT p_brand AS name, p_type AS value, p_partkey AS pos, false AS added FROM part WHERE p_size <= 25
    UNION ALL SELECT lower(p_brand), upper(p_type), p_partkey, true FROM part WHERE p_size > 20))
WHERE NOT added OR k = 1""")
def tag_union_ci(part):
    old = part.where("p_size <= 25").select(F.col("p_brand").alias("name"), F.col("p_type").alias("value"), F.lit(None).cast("double").alias("weight"), F.col("p_partkey").alias("pos"))
    new = part.where("p_size > 20").select(F.lower("p_brand").alias("name"), F.upper("p_type").alias("value"), F.lit(0.5).alias("weight"), F.col("p_partkey").alias("pos"))
    return tags.add_values(old, new).select("name", "value", "added")


@query("dedupe_keep_first", "part", sql="SELECT p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) = 1")
def dedupe_keep_first(part):
    return tags.keep_first(part.select("p_type", "p_partkey"), "p_type", "p_partkey")


@query("crowd_proposals", "part", "nation", sql="""
WITH once AS (SELECT p_brand AS column_name, p_size % 4 AS worker, p_partkey AS pos, CASE WHEN p_partkey % 5 = 0 THEN 'high' ELSE (p_partkey % 3)::VARCHAR END AS quality_rank FROM part
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 4, p_partkey) = 1)
SELECT column_name, worker, pos FROM once WHERE column_name NOT IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_type LIKE 'S%') ORDER BY coalesce(try_cast(quality_rank AS INT), 0) DESC, worker, pos LIMIT 10""")
def crowd_proposals(part, nation):
    batches = part.select(F.col("p_brand").alias("column_name"), (F.col("p_size") % 4).alias("worker"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 5 == 0, "high").otherwise((F.col("p_partkey") % 3).cast("string")).alias("quality_rank"))
    return tags.proposals(batches, part.where("p_size = 50 AND p_type LIKE 'S%'").select(F.col("p_brand").alias("column_name")), 10).select("column_name", "worker", "pos")


@query("seed_anti_join", "customer", "nation", sql="SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9600 AND c_mktsegment = 'BUILDING' AND c_nationkey IS NOT NULL)")
def seed_anti_join(customer, nation):
    have = customer.where("c_acctbal > 9600 AND c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("n_nationkey"))
    return tags.new_columns(nation.select("n_nationkey", "n_name"), have, "n_nationkey")


@query("model_tag_semi_join", "customer", sql="SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def model_tag_semi_join(customer):
    models = customer.select("c_custkey", F.array(F.col("c_mktsegment"), F.when(F.col("c_acctbal") > 0, "solvent").otherwise("debtor")).alias("tags"))
    return tags.with_tags(models, ["BUILDING", "solvent"]).select("c_custkey")


@query("generated_join_seeds", "lineitem", "part", sql="SELECT l_orderkey, l_linenumber, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey")
def generated_join_seeds(lineitem, part):
    generated = lineitem.select(F.col("l_partkey").alias("id"), "l_orderkey", "l_linenumber")
    return records.with_seeds(generated, part.select(F.col("p_partkey").alias("id"), "p_brand", "p_type"))


@query("dialect_lookup", "documents", sql="SELECT doc_id, CASE lang WHEN 'en' THEN 'ansi' WHEN 'de' THEN 'postgres' ELSE 'generic' END AS dialect FROM documents")
def dialect_lookup(documents):
    return documents.select("doc_id", records.lookup(F.col("lang"), {"en": "ansi", "de": "postgres"}, "generic").alias("dialect"))


@query("zip_rename", "region", sql="SELECT r_regionkey AS id, r_name AS label FROM region")
def zip_rename(region):
    return tags.zip_rename(region.select("r_regionkey", "r_name"), ["id", "label"])


@query("union_by_name", "customer", "supplier", sql="SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_by_name(customer, supplier):
    a = customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return readers.unioned([a, supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))])


@query("best_of_generation", "part", sql="SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 2")
def best_of_generation(part):
    from ..plans.evolution import survivors

    return survivors(part.select("p_brand", "p_partkey", "p_retailprice"), "p_brand", F.col("p_retailprice"), "p_partkey", 2).select("p_brand", "p_partkey")


# Analytics

@query("quality_value_counts", "documents", sql="SELECT lang, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def quality_value_counts(documents):
    return analytics.value_counts(documents, "lang")


@query("quality_value_counts_normalized", "documents", sql="SELECT source, count(*) / sum(count(*)) OVER () AS share FROM documents WHERE source IS NOT NULL GROUP BY source")
def quality_value_counts_normalized(documents):
    return analytics.value_counts(documents, "source", normalise=True)


@query("group_mean", "documents", sql="SELECT lang, avg(n_chars) AS mean FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def group_mean(documents):
    return analytics.group_mean(documents, "lang", "n_chars")


@query("crosstab", "labels", sql="SELECT quality, count(*) FILTER (toxic = 0) AS n_0, count(*) FILTER (toxic = 1) AS n_1 FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality")
def crosstab(labels):
    return analytics.crosstab(labels, "quality", "toxic", [0, 1])


@query("non_null_counts", "documents", "labels", sql="SELECT count(doc_id) AS doc_id, count(quality) AS quality, count(toxic) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def non_null_counts(documents, labels):
    return analytics.non_null_counts(documents.join(labels, "doc_id", "left").select("doc_id", "quality", "toxic"))


@query("error_categories", "events", sql="SELECT category, count(*) AS count FROM (SELECT CASE WHEN contains(lower(event_type), 'err') THEN 'ERR' WHEN contains(lower(event_type), 'click') THEN 'click' WHEN contains(lower(event_type), 'i') THEN 'i' END AS category FROM events) WHERE category IS NOT NULL GROUP BY category")
def error_categories(events):
    return analytics.value_counts(events.select(analytics.first_category(F.col("event_type"), ["ERR", "click", "i"]).alias("category")), "category")


@query("severity_of_masks", "part", sql="SELECT p_brand, CASE WHEN m & 1 > 0 THEN 'fatal' WHEN m & 2 > 0 THEN 'error' WHEN m & 4 > 0 THEN 'warning' WHEN m & 8 > 0 THEN 'convention' WHEN m & 16 > 0 THEN 'refactor' END AS worst FROM (SELECT p_brand, bit_or(p_size & 28) AS m FROM part GROUP BY p_brand)")
def severity_of_masks(part):
    return part.groupBy("p_brand").agg(F.bit_or(F.col("p_size").bitwiseAND(F.lit(28))).alias("m")).select("p_brand", analytics.severity(F.col("m")).alias("worst"))


@query("running_success_counts", "events", sql="""
SELECT event_id, count(*) FILTER (event_type <> 'error') OVER w AS successes, count(*) FILTER (event_type = 'error') OVER w AS failures FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def running_success_counts(events):
    return analytics.running_counts(events.select("event_id", "user_id", "event_type"), "event_id", F.col("event_type") != "error", "user_id").select("event_id", "successes", "failures")


@query("success_counters", "labels", sql="SELECT count(*) FILTER (quality = 1) AS successes, count(*) FILTER (quality <> 1 OR quality IS NULL) AS failures FROM labels")
def success_counters(labels):
    return records.counters(labels, F.col("quality") == 1)


@query("lint_code_sets", "events", sql="SELECT user_id, list_sort(list(DISTINCT event_type)) AS codes FROM events GROUP BY user_id")
def lint_code_sets(events):
    return analytics.code_sets(events, "user_id", "event_type")


# Code checks

@query("decimal_scale_lint", "part", sql="SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'DECIMAL types have no scale' END AS error FROM part")
def decimal_scale_lint(part):
    sql = F.when(F.col("p_size") % 2 == 0, "SELECT CAST(1 AS DECIMAL(10))").otherwise("SELECT CAST(1 AS DECIMAL(10,2))")
    return code.sql_errors(part.sparkSession, part.select("p_partkey", sql.alias("q")), "q").select("p_partkey", "error")


@query("sql_syntax", "nation", sql="SELECT n_nationkey, n_nationkey % 3 <> 1 AS valid FROM nation")
def sql_syntax(nation):
    k = F.col("n_nationkey")
    sql = F.when(k % 3 == 0, F.concat(F.lit("SELECT a FROM t WHERE k = "), k)).when(k % 3 == 1, F.concat(F.lit("SELEC a FRM t "), k)).otherwise(F.concat(F.lit("SELECT ';' AS x; SELECT "), k))
    return code.sql_errors(nation.sparkSession, nation.select("n_nationkey", sql.alias("q")), "q").select("n_nationkey", F.col("error").isNull().alias("valid"))


@query("sql_syntax_part", "part", sql="SELECT p_partkey, p_partkey % 3 <> 1 AS valid FROM part")
def sql_syntax_part(part):
    """As sql_syntax, with a statement of its own for each part."""
    return sql_syntax(part.withColumnRenamed("p_partkey", "n_nationkey")).withColumnRenamed("n_nationkey", "p_partkey")


@query("sql_syntax_orders", "orders", sql="SELECT o_orderkey, o_orderkey % 3 <> 1 AS valid FROM orders")
def sql_syntax_orders(orders):
    """A statement of its own for each order, in a dialect that the executors parse."""
    k = F.col("o_orderkey")
    sql = F.when(k % 3 == 1, F.concat(F.lit("SELECT FROM WHERE "), k)).otherwise(F.concat(F.lit("SELECT o_custkey FROM orders WHERE o_orderkey = "), k))
    return code.sql_errors(orders.sparkSession, orders.select("o_orderkey", sql.alias("q")), "q", "postgres").select("o_orderkey", F.col("error").isNull().alias("valid"))


@query("sql_dialects", "nation", sql="SELECT n_nationkey, n_nationkey % 3 <> 1 AS postgres, n_nationkey % 3 <> 1 AS sqlite, n_nationkey % 3 <> 1 AS sparksql FROM nation")
def sql_dialects(nation):
    """The same statements by each of the three parsers."""
    k = F.col("n_nationkey")
    df = nation.select("n_nationkey", F.when(k % 3 == 1, F.concat(F.lit("SELEC a FRM t "), k)).otherwise(F.concat(F.lit("SELECT a FROM t WHERE b = "), k)).alias("q"))
    for dialect in ("postgres", "sqlite", "sparksql"):
        df = code.sql_errors(nation.sparkSession, df, "q", dialect).withColumn(dialect, F.col("error").isNull()).drop("error")
    return df.drop("q")


@query("query_and_schema_pairs", "nation", sql="SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '***Schema error: bad' ELSE '' END || CASE WHEN n_nationkey % 3 = 0 THEN '***Query error: worse' ELSE '' END AS error FROM nation")
def query_and_schema_pairs(nation):
    k = F.col("n_nationkey")
    return nation.select("n_nationkey", code.pair_error(F.when(k % 2 == 0, "bad"), F.when(k % 3 == 0, "worse")).alias("error"))


@query("python_syntax", "part", sql="SELECT p_partkey, p_size % 2 = 0 AS valid, CASE WHEN p_size % 2 = 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS n_messages FROM part")
def python_syntax(part):
    good = F.concat(F.lit('"""Doc."""\nx = '), F.col("p_partkey"))
    source = F.when(F.col("p_size") % 2 == 0, good).otherwise(F.concat(F.lit("def (x:\n  "), F.col("p_partkey")))
    return spread(part.select("p_partkey", "p_size")).select("p_partkey", code.python_error(source).isNull().alias("valid"), code.semantic_score(source).alias("score"), F.coalesce(F.regexp_count(code.lint(source), F.lit("error")), F.lit(0)).cast("int").alias("n_messages"))


@query("sqlite_execution", "part", sql="SELECT p_partkey, p_size % 3 <> 0 AS ok FROM part")
def sqlite_execution(part):
    schema = F.concat(F.lit("CREATE TABLE t (k INT); INSERT INTO t VALUES ("), F.col("p_partkey"), F.lit(");"))
    asked = F.when(F.col("p_size") % 3 == 0, "SELECT missing FROM t").otherwise("SELECT k FROM t WHERE k > 0")
    return spread(part.select("p_partkey", "p_size")).select("p_partkey", code.run_in_sqlite(schema, asked)["ok"].alias("ok"))


@query("schema_validation", "events", sql="SELECT event_id, event_id % 2 = 0 AS ok FROM events")
def schema_validation(events):
    made = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"column_name": "a", "quality_rank": 1, "x": '), "props", F.lit("}"))).otherwise('{"quality_rank": 1}')
    return events.select("event_id", jsonx.valid_against(made, "struct<column_name:string,quality_rank:string>", ["column_name"])["ok"].alias("ok"))


@query("python_methods", "part", sql="SELECT p_partkey, p_size % 2 = 0 AS is_valid_python_with_ast, p_size % 4 = 0 AS is_valid_python_with_names, p_size % 4 = 0 AS is_valid_python_with_policy FROM part")
def python_methods(part):
    k = F.col("p_size") % 4
    source = F.when(k == 0, "x = 1").when(k == 2, "x = surely_undefined").otherwise("def (")
    checked = validation.python_checks(part.select("p_partkey", source.alias("code")), "code")
    return checked.select("p_partkey", *[f"is_valid_python_with_{m}" for m in ("ast", "names", "policy")])


@query("sql_methods", "nation", sql="SELECT n_nationkey, n_nationkey % 2 = 0 AS is_valid_sql_with_parser, n_nationkey % 2 = 0 AS is_valid_sql_with_sqlite FROM nation")
def sql_methods(nation):
    asked = F.when(F.col("n_nationkey") % 2 == 0, "SELECT a FROM t").otherwise("SELEC a FROM t")
    df = nation.select("n_nationkey", F.lit("CREATE TABLE t (a INT)").alias("schema"), asked.alias("query"))
    return validation.sql_checks(df, "schema", "query").select("n_nationkey", "is_valid_sql_with_parser", "is_valid_sql_with_sqlite")


@query("sql_methods_part", "part", sql="SELECT p_partkey, p_partkey % 2 = 0 AS is_valid_sql_with_parser, p_partkey % 2 = 0 AS is_valid_sql_with_sqlite FROM part")
def sql_methods_part(part):
    """As sql_methods, with a statement of its own for each part."""
    asked = F.concat(F.when(F.col("p_partkey") % 2 == 0, "SELECT a FROM t WHERE a = ").otherwise("SELEC a FROM t WHERE a = "), F.col("p_partkey"))
    df = part.select("p_partkey", F.lit("CREATE TABLE t (a INT)").alias("schema"), asked.alias("query"))
    return validation.sql_checks(df, "schema", "query").select("p_partkey", "is_valid_sql_with_parser", "is_valid_sql_with_sqlite")


# Streams

@query("tumbling_windows", "events", sql="SELECT time_bucket(INTERVAL '1 hour', ts::TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(events):
    return flows.windowed(events, "ts", "event_type", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("first_seen_users", "events", sql="SELECT DISTINCT user_id FROM events")
def first_seen_users(events):
    return flows.first_seen(events.select("user_id", "ts"), "ts", ["user_id"]).select("user_id")


def _stream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, for the table may be a file or a folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that aren't errors, through a stream that ends when all have come."""
    out = _folder(spark, "stream")
    flows.valid_records(_stream_of(spark, sf_dir).select("event_id", "event_type"), F.col("event_type") != "error", f"{out}/rows", f"{out}/progress").awaitTermination()
    return spark.read.schema("event_id long, event_type string").json(f"{out}/rows")


def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each batch of a stream, added up."""
    out = _folder(spark, "batches")
    counts = flows.each_batch(_stream_of(spark, sf_dir), lambda df, n: df.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/rows/batch={n}"), f"{out}/progress")
    counts.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.sum("n").alias("n"))


QUERIES["stream_valid_records"], SQL["stream_valid_records"] = stream_valid_records, "SELECT event_id, event_type FROM events WHERE event_type <> 'error'"
QUERIES["stream_batches"], SQL["stream_batches"] = stream_batches, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"


# Pipelines, with the offline model

RECORD_JOB = "Write a question about the text, and its answer."


def record_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each document, with a repairable field and a judge that fails some."""
    path = f"{sf_dir}/documents.parquet"
    job = DataModel(
        fields=[DataField("question", description="what is asked"), DataField("answer", description="Python code", validator="python")], generation_instructions=RECORD_JOB,
        data_source=DataSource(path, "huggingface", ["doc_id", "lang", "source"]), num_examples=spark.read.parquet(path).count(), evolution=Evolution(rate=0.1),
    )
    return generator.run(spark, job, OfflineModel(fail_rate=0.1, missing_rate=0.05)).records


def tag_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order, from tags, field by field."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    job = DataModel(fields=[DataField("title"), DataField("body", validator="prose")], contextual_tags=Tags([Tag("level", ["low", "high"], [0.3, None]), Tag("topic", ["a", "b", "c"], [None] * 3)]), num_examples=n, generation_strategy="field")
    return generator.run(spark, job, OfflineModel(fail_rate=0.1)).records


def nl2code(lang: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        config = AutoConfig(code_lang=lang, num_domains=3, num_topics_per_domain=3, semantic_validation=True)
        return nl2code_plan.run(spark, config, OfflineModel(), spark.read.parquet(f"{sf_dir}/supplier.parquet").count())

    return run


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("context"))


QUERIES["record_pipeline"] = record_pipeline
QUERIES["tag_pipeline"] = tag_pipeline
QUERIES["nl2code_sql"], QUERIES["nl2code_python"] = nl2code("sql"), nl2code("python")
QUERIES["sample_to_dataset"] = lambda spark, sf_dir: sample_to_dataset.run(spark, spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("Title"), F.col("c_mktsegment").alias("body")), OfflineModel())[1]
QUERIES["evolution_generations"] = lambda spark, sf_dir: evolution.evolve(_texts(spark, sf_dir), OfflineModel())
QUERIES["aaa_pipeline"] = lambda spark, sf_dir: evolution.align(_texts(spark, sf_dir), OfflineModel())
SQL["evolution_generations"] = f"SELECT doc_id AS id, NULL::VARCHAR AS context, {PHRASE(evolution.MUTATE, 'nl', context=chr(39) * 2, text='text')} AS text FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL"
SQL["aaa_pipeline"] = f"""
WITH taught AS (SELECT doc_id AS id, text, {PHRASE(evolution.TEACH, 'nl', teacher="'0'", context="''", text='text')} AS t0, {PHRASE(evolution.TEACH, 'nl', teacher="'1'", context="''", text='text')} AS t1 FROM documents WHERE text IS NOT NULL),
co AS (SELECT *, CASE WHEN t0 = t1 THEN t0 ELSE [t0, t1][1 + {DRAW(evolution.SELECT, 'o', 2, options="'[\"' || t0 || '\",\"' || t1 || '\"]'")}] END AS co_taught FROM taught),
told AS (SELECT *, [{PHRASE(evolution.SUGGEST, 'nl', k="'3'", text='text', improved='co_taught')}, {PHRASE(evolution.SUGGEST, '2', k="'3'", text='text', improved='co_taught')}, 'No suggestion'] AS suggestions FROM co),
own AS (SELECT *, {PHRASE(evolution.SELF, 'nl', suggestions="array_to_string(suggestions, '; ')", text='co_taught')} AS self_taught FROM told)
SELECT id, text, NULL::VARCHAR AS context, co_taught, suggestions, self_taught, list_distinct_in_order[1 + {DRAW(evolution.SELECT, 'o', 2, options="to_json(list_distinct_in_order)::VARCHAR")}] AS final
FROM (SELECT *, CASE WHEN co_taught = self_taught THEN [text, co_taught] ELSE [text, co_taught, self_taught] END AS list_distinct_in_order FROM own)"""
QUERIES["config_generator"] = lambda spark, sf_dir: spark.createDataFrame([(t.name, t.values) for t in configgen.expand_tags("questions about gardens", OfflineModel(), 1000).tags], "name string, vals array<string>")


from . import catalog_more  # noqa: E402, F401 - registers further queries
