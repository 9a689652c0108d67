"""Further queries: sources and sinks, functions for prompts and answers, models, and parts of the pipelines that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, hashing, jsonx, text
from ..operators import analytics, records, sampling, tags
from ..operators.common import with_row_index
from ..sources import readers, sinks
from ..streaming import flows
from . import generator, nl2code, sample_to_dataset, validation
from .catalog import DRAW, FILLED, PHRASE, QUERIES, RECORD_JOB, SQL, STRIP, U, _case, _folder, _stream_of, query
from .config import DEFAULT_EVOLUTION, AutoConfig, DataField, DataModel, DataSource, Tag, Tags
from .model import REFLECTION, SYSTEM, OfflineModel, infer
from .pipeline import Pipeline

# Sources and sinks


@query("csv_source", "customer", sql="SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_source(customer):
    """Written with a header, and read back in part."""
    path = _folder(customer.sparkSession, "csv")
    sinks.write_csv(customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return readers.read_source(customer.sparkSession, DataSource(path, "csv", ["c_custkey", "c_name", "c_mktsegment"]), "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@query("jsonl_source", "part", sql="SELECT p_partkey, p_name, p_size FROM part")
def jsonl_source(part):
    path = sinks.write_jsonl(part.select("p_partkey", "p_name", "p_brand", "p_size"), _folder(part.sparkSession, "lines"))
    size = part.schema["p_size"].dataType.simpleString()
    return readers.read_source(part.sparkSession, DataSource(path, "jsonl", ["p_partkey", "p_name", "p_size"]), f"p_partkey bigint, p_name string, p_brand string, p_size {size}")


@query("unused_names", "region", sql="SELECT unnest(['/out.jsonl', '/out_1.jsonl', '/out_2.jsonl']) AS name, (SELECT count(*) FROM region) AS n")
def unused_names(region):
    """Three results under one name, each written to a path of its own."""
    spark, base = region.sparkSession, _folder(region.sparkSession, "names")
    paths = [sinks.write_jsonl(region, f"{base}/out.jsonl") for _ in range(3)]
    return readers.unioned([spark.read.json(p).agg(F.count("*").alias("n")).select(F.lit(p.removeprefix(base)).alias("name"), "n") for p in paths])


@query("saved_artifacts", "supplier", sql="SELECT s_suppkey, s_name, 2 AS runs, 'suppliers' AS about FROM supplier")
def saved_artifacts(supplier):
    path = _folder(supplier.sparkSession, "artefact")
    sinks.save_artifacts(supplier.select("s_suppkey", "s_name"), path, {"runs": 2}, {"about": "suppliers"})
    df, config, notes = sinks.load_artifacts(supplier.sparkSession, path)
    return df.select("s_suppkey", "s_name", F.lit(config["runs"]).alias("runs"), F.lit(notes["about"]).alias("about"))


@query("growing_artifact", "nation", sql="SELECT n_nationkey, n_name, (n_nationkey % 3)::INT AS batch FROM nation")
def growing_artifact(nation):
    """Batches written one by one, one of them twice."""
    path = _folder(nation.sparkSession, "growing")
    for k in (0, 1, 2, 1):
        sinks.append_batch(nation.where(F.col("n_nationkey") % 3 == k).select("n_nationkey", "n_name"), path, k)
    return sinks.read_batches(nation.sparkSession, path, f"n_nationkey {nation.schema['n_nationkey'].dataType.simpleString()}, n_name string")


@query("text_of_lines", "nation", sql="""SELECT string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', chr(10) ORDER BY n_nationkey) AS jsonl FROM nation""")
def text_of_lines(nation):
    return sinks.to_jsonl_text(nation.select("n_nationkey", "n_name"), "n_nationkey")


@query("rows_of_json_text", "part", sql="""
SELECT p_partkey, p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS size, CASE WHEN p_size % 2 = 1 THEN '["a",1]' END AS extra FROM part WHERE p_size % 5 <> 0
UNION ALL SELECT p_partkey, 'second', NULL, NULL FROM part WHERE p_size % 2 = 0 AND p_size % 5 <> 0""")
def rows_of_json_text(part):
    """Arrays, single objects in other quotes, and texts without any, with the names that come up."""
    array = F.concat(F.lit('[{"brand": "'), F.col("p_brand"), F.lit('", "size": '), F.col("p_size"), F.lit('}, {"brand": "second"}]'))
    one = F.concat(F.lit("{'brand': '"), F.col("p_brand"), F.lit("', 'extra': [\"a\", 1]"))
    answer = F.when(F.col("p_size") % 5 == 0, "no rows at all").when(F.col("p_size") % 2 == 0, array).otherwise(one)
    return readers.rows_of_json(part.select("p_partkey", answer.alias("answer")), "answer", None, ["p_partkey"])


@query("names_agree", "part", sql="SELECT p_partkey, p_size % 3 = 0 AS ok FROM part")
def names_agree(part):
    """Answers whose rows together have just the names asked for; others have one too many or too few."""
    answer = F.when(F.col("p_size") % 3 == 0, '[{"a": 1}, {"b": 2, "a": 3}]').when(F.col("p_size") % 3 == 1, '{"a": 1, "b": 2, "c": 3}').otherwise('[{"a": 1}]')
    return readers.names_agree(readers.objects_of_json(part.select("p_partkey", answer.alias("t")), "t", ["p_partkey"]), "p_partkey", ["a", "b"])


@query("shown_rows", "nation", sql="SELECT n_nationkey, 'N Nationkey : ' || n_nationkey || chr(10) || 'Name        : -' AS shown FROM nation")
def shown_rows(nation):
    df = nation.select("n_nationkey", F.lit(None).cast("string").alias("name"))
    return df.select("n_nationkey", sinks.rendered(df, "n_nationkey", "name", width=12).alias("shown"))


# Order, samples, slices


@query("few_shot_lines", "nation", sql="""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS line FROM nation ORDER BY md5(concat_ws('|', '4', n_nationkey)), n_nationkey LIMIT 6""")
def few_shot_lines(nation):
    return sampling.few_shot(nation.select("n_nationkey", "n_name"), 6, "n_nationkey", seed=4)


@query("drawn_row", "customer", sql="SELECT 'drawn' AS how, c_custkey FROM (SELECT c_custkey FROM customer ORDER BY md5(concat_ws('|', '8', c_custkey)), c_custkey LIMIT 1) UNION ALL SELECT 'named', 7")
def drawn_row(customer):
    df = customer.select("c_custkey")
    return readers.unioned([sampling.row_at(df, "c_custkey", None, 8).select(F.lit("drawn").alias("how"), "c_custkey"), sampling.row_at(df, "c_custkey", 7).select(F.lit("named").alias("how"), "c_custkey")])


@query("random_subsets", "part", sql="""
SELECT p_partkey, list_transform(list_sort(list_transform(['json', 'csv', 'math', 'random', 'string', 're'], lambda v: {'h': md5(concat_ws('|', '6', p_partkey, v)), 'v': v}))[1:3], lambda x: x.v) AS picked FROM part""")
def random_subsets(part):
    return part.select("p_partkey", sampling.subset(F.array(*map(F.lit, ["json", "csv", "math", "random", "string", "re"])), 3, 6, F.col("p_partkey")).alias("picked"))


@query("kind_picks", "orders", sql=f"SELECT o_orderkey, ['question', 'instruction', 'scenario', 'review'][1 + floor({U(1, chr(39) + 'kind' + chr(39), 'o_orderkey')} * 4)::INT] AS kind FROM orders")
def kind_picks(orders):
    kinds = F.array(*map(F.lit, ["question", "instruction", "scenario", "review"]))
    return orders.select("o_orderkey", hashing.pick(kinds, hashing.u01(1, "kind", F.col("o_orderkey"))).alias("kind"))


@query("empty_contexts", "supplier", sql="SELECT range AS slot FROM range(0, (SELECT count(*) FROM supplier))")
def empty_contexts(supplier):
    return sampling.empty_contexts(supplier.sparkSession, supplier.count())


@query("seeds_for_rows", "region", sql="SELECT range AS id FROM range(0, 7)")
def seeds_for_rows(region):
    """Twenty rows at three a seed take seven seeds."""
    seeds = sampling.seed_permutations(region.sparkSession, {"a": [f"a{i}" for i in range(100)], "b": [f"b{i}" for i in range(1000)]})
    return sampling.first_seeds(seeds, 20, 3).select("id")


@query("huge_permutations", "region", sql="SELECT 2000 AS n, 2000 AS different, 100 AS values_met")
def huge_permutations(region):
    """Distinct tuples out of 10 to the 24th."""
    seeds = {f"s{k:02d}": [f"v{i}" for i in range(100)] for k in range(12)}
    got = sampling.seed_permutations(region.sparkSession, seeds, 2000, seed=1)
    return got.agg(F.count("*").cast("int").alias("n"), F.count_distinct(F.struct(*seeds)).cast("int").alias("different"), F.count_distinct("s07").cast("int").alias("values_met"))


@query("slices_of_rows", "orders", sql="""
SELECT 'first' AS part, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL SELECT 'last', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5)
UNION ALL SELECT 'middle', o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i BETWEEN 100 AND 109""")
def slices_of_rows(orders):
    df = orders.select("o_orderkey")
    parts = {"first": readers.first_rows(df, "o_orderkey", 5), "last": analytics.last_rows(df, "o_orderkey", 5), "middle": analytics.rows_between(df, "o_orderkey", 100, 110)}
    return readers.unioned([p.select(F.lit(name).alias("part"), "o_orderkey") for name, p in parts.items()])


@query("running_totals", "events", sql="SELECT event_id, count(*) FILTER (event_type <> 'error') OVER w AS successes, count(*) FILTER (event_type = 'error') OVER w AS failures FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_totals(events):
    """Over all events in their order, not in one task."""
    return analytics.running_counts(events.select("event_id", "event_type"), "event_id", F.col("event_type") != "error").select("event_id", "successes", "failures")


@query("session_windows", "events", sql="""
WITH marked AS (SELECT user_id, ts::TIMESTAMP AS t, CASE WHEN ts::TIMESTAMP - lag(ts::TIMESTAMP) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM marked)
SELECT user_id, min(t) AS start, max(t) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM numbered GROUP BY user_id, k""")
def session_windows(events):
    return flows.sessions(events, "ts", "user_id").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


@query("recent_events", "events", sql="SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def recent_events(events):
    return flows.recent(events.select("event_id", "event_type"), "event_id")


# Records and names


@query("well_formed_records", "part", sql="SELECT p_partkey, p_size % 3 = 0 AS ok FROM part")
def well_formed_records(part):
    """Maps with all names and no blank value; others lack one, or have a blank."""
    record = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.lit("x"))).when(F.col("p_size") % 3 == 1, F.create_map(F.lit("a"), F.col("p_brand"))).otherwise(F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.lit(" \n")))
    return part.select("p_partkey", records.well_formed(record, ["a", "b"]).alias("ok"))


@query("overwritten_flags", "documents", "labels", sql="SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE lang END AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def overwritten_flags(documents, labels):
    both = documents.select("doc_id", "lang").join(labels, "doc_id", "left")
    return both.select("doc_id", records.overwritten(F.col("lang"), (F.col("toxic") == 1, F.lit("toxic")), (F.col("quality") == 0, F.lit("poor"))).alias("lang"))


@query("checks_of_one_dialect", "part", sql="SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size > 10 END AS ok FROM part")
def checks_of_one_dialect(part):
    dialect = F.when(F.col("p_size") % 2 == 0, "Post gres").otherwise("mysql")
    return part.select("p_partkey", validation.only(dialect, "postgres", F.col("p_size") > 10).alias("ok"))


@query("scrubbed_columns", "customer", sql="SELECT c_custkey AS cust_key, c_name AS cust_key_2, c_acctbal AS col_2nd_balance, c_mktsegment AS column FROM customer")
def scrubbed_columns(customer):
    raw = customer.select(F.col("c_custkey").alias("Cust Key"), F.col("c_name").alias("cust-key"), F.col("c_acctbal").alias("2nd balance"), F.col("c_mktsegment").alias("!!"))
    return tags.zip_rename(raw, list(tags.scrub_names(raw.columns).values()))


@query("restored_columns", "region", sql='SELECT r_regionkey AS "Region Key", r_name AS "Its Name", 1 AS more FROM region')
def restored_columns(region):
    """There and back again; a column that came later keeps its name."""
    names = ["Region Key", "Its Name"]
    scrubbed = tags.zip_rename(region.select("r_regionkey", "r_name"), [tags.name_maps(names)[0][n] for n in names])
    return tags.restored(scrubbed.withColumn("more", F.lit(1)), names)


@query("tag_names_ci", "part", sql="""
SELECT name, added FROM (SELECT DISTINCT p_brand AS name, false AS added FROM part WHERE p_size <= 5 UNION ALL
  SELECT first(name ORDER BY pos), true FROM (SELECT lower(p_type) AS k, p_type AS name, p_partkey AS pos FROM part UNION ALL SELECT lower(p_brand), upper(p_brand), p_partkey FROM part)
  WHERE k NOT IN (SELECT lower(p_brand) FROM part WHERE p_size <= 5) GROUP BY k)""")
def tag_names_ci(part):
    old = part.where("p_size <= 5").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("pos"))
    new = readers.unioned([part.select(F.col("p_type").alias("name"), F.col("p_partkey").alias("pos")), part.select(F.upper("p_brand").alias("name"), F.col("p_partkey").alias("pos"))])
    return tags.add_tags(old, new).select("name", "added")


@query("truncated_tags", "part", sql="SELECT p_partkey, [p_brand, p_type] AS kept FROM part")
def truncated_tags(part):
    return part.select("p_partkey", tags.truncated(F.array("p_brand", "p_type", "p_name"), 2).alias("kept"))


@query("ranked_seeds", "part", sql="SELECT p_brand, p_partkey FROM part ORDER BY coalesce(try_cast(CASE WHEN p_size % 4 = 0 THEN 'high' ELSE p_size::VARCHAR END AS INT), 0) DESC, p_partkey LIMIT 12")
def ranked_seeds(part):
    ranked = part.select("p_brand", "p_partkey", F.when(F.col("p_size") % 4 == 0, "high").otherwise(F.col("p_size").cast("string")).alias("quality_rank"))
    return tags.rank_top(ranked, 12, "quality_rank", "p_partkey").select("p_brand", "p_partkey")


@query("longest_names", "nation", sql="SELECT n_nationkey, greatest(4, length(n_name))::INT AS widest FROM nation")
def longest_names(nation):
    return nation.select("n_nationkey", analytics.longest_name(F.create_map(F.lit("name"), F.lit(1), F.col("n_name"), F.lit(2))).alias("widest"))


@query("messages_by_severity", "part", sql="SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['fatal', 'error', 'warning', 'warning'] ELSE ['error', 'warning', 'warning', 'refactor'] END AS kinds, [2, 1, 3] AS places FROM part")
def messages_by_severity(part):
    """The gravest first; equal ones in their order."""
    m = lambda kind, at: F.struct(F.lit(kind).alias("type"), F.lit(at).alias("at")) if isinstance(kind, str) else F.struct(kind.alias("type"), F.lit(at).alias("at"))
    last = F.when(F.col("p_size") % 2 == 0, "fatal").otherwise("refactor")
    ordered = analytics.by_severity(F.array(m("warning", 1), m("error", 2), m("warning", 3), m(last, 4)))
    return part.select("p_partkey", F.transform(ordered, lambda x: x["type"]).alias("kinds"), F.transform(F.filter(ordered, lambda x: x["at"] < 4), lambda x: x["at"]).alias("places"))


@query("distinct_in_order", "part", sql="SELECT p_partkey, CASE WHEN p_brand = p_type THEN [p_brand] ELSE [p_brand, p_type] END AS versions FROM part")
def distinct_in_order(part):
    from .evolution import distinct_texts

    return part.select("p_partkey", distinct_texts(F.array("p_brand", "p_type", "p_brand", "p_type")).alias("versions"))


# Prompts and answers


@query("assembled_prompts", "documents", sql="SELECT doc_id, 'System: Be brief.' || chr(10) || chr(10) || 'Human: ' || text || chr(10) || chr(10) || 'Assistant:' AS prompt FROM documents")
def assembled_prompts(documents):
    return documents.select("doc_id", text.assembled("Be brief.", F.col("text")).alias("prompt"))


@query("request_prefixes", "orders", sql="SELECT o_orderkey, substr(md5(concat_ws('|', '5', o_orderkey)), 1, 10) AS prefix FROM orders")
def request_prefixes(orders):
    return orders.select("o_orderkey", sampling.request_prefix(5, F.col("o_orderkey")).alias("prefix"))


@query("titles", "nation", sql="SELECT n_nationkey, rpad(list_aggregate(list_transform(string_split(replace(lower(n_name), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' '), greatest(12, length(n_name))::INT, ' ') AS shown FROM nation")
def titles(nation):
    return nation.select("n_nationkey", text.title(F.lower("n_name"), 12).alias("shown"))


@query("error_prefixes", "documents", sql="SELECT doc_id, 'Exception during SQL parsing: ' || left(text, 512) || '...' AS error FROM documents")
def error_prefixes(documents):
    """What a message is cut to, by definition, for prompts of repair."""
    return documents.select("doc_id", text.error_prefix(F.col("text")).alias("error"))


@query("field_descriptions", "region", sql="""
SELECT r_regionkey, concat(r_name, ': ', chr(10), 'Field name: `q`', chr(10), '  - Type: str', chr(10), '  - Description: what is asked', chr(10), chr(10), 'Field name: `a`', chr(10), '  - Type: code', chr(10), '  - Description: Python', chr(10)) AS prompt FROM region""")
def field_descriptions(region):
    about = text.fields_description([("q", "str", "what is asked"), ("a", "code", "Python")])
    return region.select("r_regionkey", text.render("{name}: \n{about}", {"name": F.col("r_name"), "about": about}).alias("prompt"))


@query("fenced_json_answers", "events", sql="SELECT event_id, CASE WHEN event_id % 3 < 2 THEN user_id END AS user_id, event_id % 3 < 2 AS parsed FROM events")
def fenced_json_answers(events):
    k, user = F.col("event_id") % 3, F.col("user_id")
    answer = F.when(k == 0, F.concat(F.lit('```json\n{"u": '), user, F.lit("}\n```"))).when(k == 1, F.concat(F.lit("{'u': "), user, F.lit(","))).otherwise("nothing of the kind")
    body = jsonx.fenced_json(answer)
    return events.select("event_id", F.get_json_object(body, "$.u").cast("long").alias("user_id"), body.isNotNull().alias("parsed"))


@query("holds_objects", "events", sql="SELECT event_id, event_id % 2 = 0 AS ok FROM events")
def holds_objects(events):
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("rows:\n"), F.col("props"), F.lit("\nand {broken"))).otherwise(F.concat(F.lit("{not json} "), F.col("event_type")))
    return events.select("event_id", jsonx.is_jsonl(answer).alias("ok"))


@query("keyed_lists", "part", sql="""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '{"columns":[]}' WHEN 1 THEN '{"columns":["' || p_brand || '"]}' ELSE '{"other":1}' END AS keyed FROM part""")
def keyed_lists(part):
    k = F.col("p_size") % 3
    given = F.when(k == 1, F.concat(F.lit(' ["'), F.col("p_brand"), F.lit('"]'))).when(k == 2, '{"other":1}')
    return part.select("p_partkey", jsonx.keyed_list(given).alias("keyed"))


@query("example_lists", "nation", sql="SELECT n_nationkey, '- ' || n_name || chr(10) || '- and so on' AS lines FROM nation")
def example_lists(nation):
    return nation.select("n_nationkey", jsonx.example_lines(F.array("n_name", F.lit("and so on"))).alias("lines"))


@query("flat_scores", "part", sql="SELECT p_partkey, p_size AS clear_score, p_brand AS clear_reason, NULL::INT AS right_score, 'none' AS right_reason FROM part")
def flat_scores(part):
    answer = F.concat(F.lit('{"clear": {"score": '), F.col("p_size"), F.lit(', "reasoning": "'), F.col("p_brand"), F.lit('"}, "right": {"score": "high", "reasoning": "none"}}'))
    return part.select("p_partkey", *jsonx.flat_scores(answer, ["clear", "right"]))


@query("escaped_json_strings", "conversations", sql=rf"SELECT conv_id, turn, {STRIP.format('text')} AS body FROM conversations")
def escaped_json_strings(conversations):
    """Whole texts through JSON and back."""
    back = F.get_json_object(jsonx.tagged_json(F.concat(F.lit("<json>"), F.to_json(F.struct(text.strip(F.col("text")).alias("t"))), F.lit("</json>"))), "$.t")
    return conversations.select("conv_id", "turn", back.alias("body"))


# Models


_SAY = "Say something about {what}."
_FULL = "System: {system}\n\nHuman: " + _SAY + "\n\nAssistant:"


def _told(system: str) -> str:
    return "'" + system.replace("'", "''") + "'"


@query("offline_inference", "part", sql=f"""
SELECT *, strlen('Say something about ' || what || '.') AS bytes_read, strlen(answer) AS bytes_written FROM (
  SELECT p_partkey, p_brand AS what, {PHRASE(_FULL, 'nl', system=_told(SYSTEM), what='p_brand')} AS answer, {PHRASE(_FULL, 'nl', system=_told(REFLECTION), what='p_brand')} AS thought FROM part)""")
def offline_inference(part):
    """Prompts behind the usual system message and behind the one for thinking, answers cleaned, bytes counted."""
    df = part.select("p_partkey", F.col("p_brand").alias("what")).withColumn("prompt", text.render(_SAY, {"what": F.col("what")}))
    df = infer(df, "prompt", "thought", OfflineModel(), use_reflection=True, system="not used").drop("bytes_read", "bytes_written")
    return infer(df, "prompt", "answer", OfflineModel()).drop("prompt")


@query("usage_by_role", "conversations", sql="SELECT role, count(*) AS calls, count(*) FILTER (text = '') AS empty, sum(strlen(role))::BIGINT AS prompt_bytes, sum(strlen(text))::BIGINT AS answer_bytes FROM conversations WHERE role IS NOT NULL GROUP BY role")
def usage_by_role(conversations):
    return analytics.usage(conversations.withColumn("asked", F.col("role")), "role", "asked", "text")


@query("model_settings", "region", sql="SELECT r_regionkey, ['temperature=0.7', 'top_p=0.9'] AS params FROM region")
def model_settings(region):
    """A configured model's settings without those that name it and its server."""
    from .model import call_params, find_by_tags, registry

    config = [{"model_name": "one", "params": {"model": "x", "api_base": "http://x", "temperature": 0.7, "top_p": 0.9}, "tags": ["nl", "small"]}, {"model_name": "two", "params": {"model": "y"}, "tags": ["nl"]}]
    first = find_by_tags(registry(config), ["nl", "small"])[0]
    return region.select("r_regionkey", F.array(*[F.lit(f"{k}={v}") for k, v in sorted(call_params(first).items())]).alias("params"))


@query("prompt_sizes", "region", sql="SELECT r_regionkey, strlen('Write.') + strlen('q') + strlen('str') + strlen('wæs') + strlen('Improve.') AS bytes FROM region")
def prompt_sizes(region):
    from .config import Evolution

    job = DataModel(fields=[DataField("q", description="wæs")], generation_instructions="Write.", evolution=Evolution(strategies=["Improve."]))
    return region.select("r_regionkey", F.lit(job.prompt_bytes()).cast("long").alias("bytes"))


@query("named_pipeline", "orders", sql="SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey")
def named_pipeline(orders):
    """Steps put together by name, one of them kept in the shared folder, one replaced."""
    steps = Pipeline("orders by customer").then("filter", lambda df: df.where("o_totalprice > 99999999"), kept=True).then("count", lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("n")))
    return steps.replaced("filter", lambda df: df.where("o_totalprice > 1000")).run(orders)


# Samples


_SAMPLE = """WITH lines AS (SELECT '{"title":"' || c_name || '","body":"' || c_mktsegment || '"}' AS line FROM customer),
picked AS (SELECT line, md5(concat_ws('|', '0', line)) AS h FROM lines ORDER BY h, line LIMIT 25), sample AS (SELECT string_agg(line, chr(10) ORDER BY h, line) AS sample FROM picked)"""


@query("seed_proposals", "customer", sql=f"""
{_SAMPLE}, asked AS (SELECT range AS worker, string_split({PHRASE(sample_to_dataset.COLUMNS, 'nl', worker='range::VARCHAR', sample='sample')}, ' ') AS said FROM range(0, 3), sample),
cols AS (SELECT worker, i AS pos, said[i + 1] || '_' || said[i + 2] AS column_name, said AS vals FROM asked, (SELECT range::INT AS i FROM range(0, 4))),
once AS (SELECT * FROM cols QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY worker, pos) = 1) SELECT column_name, vals FROM once ORDER BY pos DESC, worker LIMIT 3""")
def seed_proposals(customer):
    """What three workers propose for a sample of customers: the best three columns, and their values."""
    sample = customer.select(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body"))
    seeds = sample_to_dataset.propose(customer.sparkSession, sample, OfflineModel(), sample_to_dataset.Options())
    return customer.sparkSession.createDataFrame(list(seeds.items()), "column_name string, vals array<string>")


_ROWS = {"k": "'2'", "prompt": "'about ' || n_name", "seeds": """'{"n_name":"' || n_name || '"}'""", "columns": "'title, body'", "attempt": "'0'", "sample": """'{"title":"t"}'"""}


@query("rows_for_seeds", "nation", sql=f"""
SELECT {PHRASE(sample_to_dataset.ROWS, 'nl', **_ROWS)} AS title, {PHRASE(sample_to_dataset.ROWS, 'r0', **_ROWS)} AS body, n_name FROM nation
UNION ALL SELECT {PHRASE(sample_to_dataset.ROWS, 'nl', **_ROWS)}, {PHRASE(sample_to_dataset.ROWS, 'r1', **_ROWS)}, n_name FROM nation""")
def rows_for_seeds(nation):
    """Two rows for each nation as a seed, checked for their columns, with the seed beside them."""
    seeds = nation.select(F.col("n_nationkey").alias("id"), "n_name")
    return sample_to_dataset.make_rows(seeds, ["n_name"], ["title", "body"], '{"title":"t"}', "about {n_name}", OfflineModel(), sample_to_dataset.Options())[1]


# Settings


@query("tags_in_yaml", "part", sql="SELECT p_brand AS value, CASE WHEN count(*) % 2 = 0 THEN count(*)::DOUBLE END AS weight, (SELECT count(DISTINCT p_brand) FROM part)::BIGINT AS diversity FROM part GROUP BY p_brand")
def tags_in_yaml(part):
    """A tag of all brands, some with weights, written as YAML and read again."""
    import yaml

    counts = part.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy("p_brand").collect()  # a tag's values, as many as brands
    tag = Tag("brand", [r["p_brand"] for r in counts], [float(r["n"]) if r["n"] % 2 == 0 else None for r in counts])
    again = Tags.read(yaml.safe_load(Tags([tag]).to_yaml())["contextual_tags"])
    rows = [(v, w, again.diversity()) for v, w in zip(again.tags[0].values, again.tags[0].weights, strict=True)]
    return part.sparkSession.createDataFrame(rows, "value string, weight double, diversity bigint")


@query("job_in_yaml", "nation", sql="SELECT n_name AS field, 'str' AS type, 'about ' || n_name AS description, 'json' AS validator, 3 AS num_examples FROM nation")
def job_in_yaml(nation):
    """A job with a field for each nation, written as YAML and read again."""
    names = [r["n_name"] for r in nation.select("n_name").collect()]  # a job's fields: 25
    job = DataModel(fields=[DataField(n, description=f"about {n}", validator="json") for n in names], num_examples=3)
    again = DataModel.from_yaml(job.to_yaml())
    return nation.sparkSession.createDataFrame([(f.name, f.type, f.description, f.validator, again.num_examples) for f in again.fields], "field string, type string, description string, validator string, num_examples int")


@query("code_job_settings", "region", sql="SELECT r_regionkey, 'ManualConfig' AS kind, r_name AS domain, ['joins', 'windows'] AS topics FROM region")
def code_job_settings(region):
    """Domains and topics in YAML; the kind of settings is told by what they have."""
    import yaml

    from .config import load_code_config

    keys = {r["r_name"]: r["r_regionkey"] for r in region.collect()}
    config = load_code_config(yaml.safe_dump({"code_lang": "sql", "complexity_levels": ["easy"], "domain_and_topics": {n: ["joins", "windows"] for n in keys}}))
    tree, _ = nl2code.tag_tree(config, OfflineModel())
    return region.sparkSession.createDataFrame([(keys[d], type(config).__name__, d, t) for d, t in tree.items()], "r_regionkey int, kind string, domain string, topics array<string>")


@query("shuffled_rows", "nation", sql="SELECT n_nationkey, row_number() OVER (ORDER BY md5(concat_ws('|', '3', n_nationkey)), n_nationkey) - 1 AS place FROM nation")
def shuffled_rows(nation):
    """All rows in drawn order, with their places."""
    shuffled = sampling.shuffle_rows(nation.select("n_nationkey"), "n_nationkey", seed=3)
    return with_row_index(shuffled.withColumn("h", hashing.digest(3, F.col("n_nationkey"))), "h", "n_nationkey", name="place").select("n_nationkey", "place")


# Jobs

_JOB = DataModel(
    fields=[DataField("question", description="what is asked"), DataField("answer", description="what is true")], generation_instructions="Write a question and its answer.",
    contextual_tags=Tags([Tag("level", ["low", "high"], [0.3, None]), Tag("topic", ["a", "b", "c"], [None] * 3)]), use_reflection=False,
)
_CONTEXT = "'<<FIELD: level>>' || chr(10) || level || chr(10) || '<<END_FIELD>>' || chr(10) || '<<FIELD: topic>>' || chr(10) || topic || chr(10) || '<<END_FIELD>>'"
_RECORD = "'<<FIELD: question>>' || chr(10) || question || chr(10) || '<<END_FIELD>>' || chr(10) || '<<FIELD: answer>>' || chr(10) || answer || chr(10) || '<<END_FIELD>>'"
_MADE = "System: {system}\n\nHuman: " + generator.RECORD + "\n\nAssistant:"
_JUDGED = "System: {system}\n\nHuman: " + generator.JUDGE + "\n\nAssistant:"
_FAIL = 0.25


def _job_sql() -> str:
    about = text.fields_description([(f.name, f.type, f.description) for f in _JOB.fields])
    lit = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    told = {"system": _told(SYSTEM), "instructions": lit(_JOB.generation_instructions), "fields": "'question, answer'", "descriptions": lit(about), "context": "context", "attempt": "slot::VARCHAR"}
    judged = {"system": _told(SYSTEM), "job": lit(_JOB.generation_instructions), "record": "record"}
    tags_ = ", ".join(_case(0, t.name, t.values, t.weights, "slot") for t in _JOB.contextual_tags.tags)
    return f"""
WITH slots AS (SELECT range AS slot FROM range(0, (SELECT count(*) FROM supplier))), mixed AS (SELECT slot, {tags_} FROM slots), shown AS (SELECT *, {_CONTEXT} AS context FROM mixed),
made AS (SELECT *, {PHRASE(_MADE, 'question', **told)} AS question, {PHRASE(_MADE, 'answer', **told)} AS answer FROM shown), whole AS (SELECT *, {_RECORD} AS record FROM made),
judged AS (SELECT *, {DRAW(_JUDGED, 'judge', 1_000_000, **judged)} >= {int(_FAIL * 1_000_000)} AS valid, {PHRASE(_JUDGED, 'judge', **judged)} AS why FROM whole)
SELECT slot AS attempt, slot, valid, CASE WHEN NOT valid THEN 'FAIL: ' || why END AS reason FROM judged"""


def job_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of a job by tags: contexts drawn, prompts filled, records parsed and judged, with a verdict for each attempt."""
    from dataclasses import replace

    job = replace(_JOB, num_examples=spark.read.parquet(f"{sf_dir}/supplier.parquet").count())
    return generator.run(spark, job, OfflineModel(fail_rate=_FAIL), max_rounds=1).attempts.select("attempt", "slot", "valid", "reason")


QUERIES["job_attempts"], SQL["job_attempts"] = job_attempts, _job_sql()


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_lit, values)) + "]"


_PYTHON = 'def answer():\n    """Give a phrase."""\n    return "{}"'


def _nl2code_sql(lang: str) -> str:
    """The records of the query ``nl2code_<lang>``, with the offline model's answers."""
    config = AutoConfig(code_lang=lang, num_domains=3, num_topics_per_domain=3, semantic_validation=True)
    tree, levels = nl2code.tag_tree(config, OfflineModel())
    topics = "CASE domain " + " ".join(f"WHEN {_lit(d)} THEN {_list(t)}" for d, t in tree.items()) + " END"
    pick = lambda values, name: f"{values}[1 + floor({U(0, _lit(name), 'slot')} * len({values}))::INT]"
    tag = {"domain": "domain", "topic": "topic", "level": "complexity", "slot": "slot::VARCHAR"}
    if lang == "sql":
        answer = PHRASE(nl2code.CONTEXT, "code", k=f"(3 + floor({U(0, _lit('tables'), 'slot')} * 3)::INT)::VARCHAR", **tag)
        made, context, code_, last = f"'SELECT ''' || {answer} || ''' AS answer;' AS sql_context", "sql_context", "'SELECT ''' || said || ''' AS answer;'", ""
    else:
        every = _list(nl2code._lists(OfflineModel(), 20, "packages", "python", "python") or ["json"])
        made = f"list_transform(list_sort(list_transform({every}, lambda v: {{'h': md5(concat_ws('|', '0', slot, v)), 'v': v}}))[1:5 + floor({U(0, _lit('packages'), 'slot')} * 3)::INT], lambda x: x.v) AS suggested_packages"
        before, after = _PYTHON.split("{}")
        context, code_, last = "array_to_string(suggested_packages, ', ')", f"{_lit(before)} || said || {_lit(after)}", f", {code.score_of(_PYTHON)!r}::DOUBLE AS semantic_validation"
    ask = {"criteria": _lit(", ".join(nl2code.CRITERIA[lang])), "request": "natural_language", "context": context, "code": "code"}
    scores = ", ".join(f"{DRAW(nl2code.RUBRIC, c, 5, **ask)} AS {c}_score, reason AS {c}_reason" for c in nl2code.CRITERIA[lang])
    return f"""
WITH slots AS (SELECT range AS slot FROM range(0, (SELECT count(*) FROM supplier))), d AS (SELECT slot, {pick(_list(list(tree)), "domain")} AS domain FROM slots),
t AS (SELECT *, {topics} AS topics FROM d), tagged AS (SELECT slot, domain, {pick("topics", "topic")} AS topic, {pick(_list(levels), "complexity")} AS complexity, {pick(_list(nl2code.KINDS), "kind")} AS nl_type FROM t),
c AS (SELECT *, {made} FROM tagged), r AS (SELECT *, {PHRASE(nl2code.REQUEST, "nl", kind="nl_type", lang=_lit(lang), context=context, **tag)} AS natural_language FROM c),
p AS (SELECT *, {FILLED(nl2code.CODE, lang=_lit(lang), request="natural_language", context=context)} AS full_prompt FROM r), said AS (SELECT *, {PHRASE("{p}", "code", p="full_prompt")} AS said FROM p),
coded AS (SELECT *, {code_} AS code FROM said), judged AS (SELECT *, {PHRASE(nl2code.RUBRIC, "judge", **ask)} AS reason FROM coded)
SELECT md5(concat_ws('|', '0', 'uid', slot)) AS uid, domain, topic, complexity, {"sql_context" if lang == "sql" else "suggested_packages"}, full_prompt, nl_type, natural_language, code, {scores}, 'passed' AS syntax_validation{last} FROM judged"""


SQL["nl2code_sql"], SQL["nl2code_python"] = _nl2code_sql("sql"), _nl2code_sql("python")


def _ask(template: str) -> str:
    return "System: {system}\n\nHuman: " + template + "\n\nAssistant:"


def _below(rate: float, template: str, salt: str, values: dict[str, str]) -> str:
    return f"{DRAW(template, salt, 1_000_000, **values)} < {int(rate * 1_000_000)}"


def _tag_pipeline_sql() -> str:
    """The records of the query ``tag_pipeline``: of twice as many attempts as are asked for, the first that are valid."""
    told = {"system": _told(REFLECTION), "instructions": "''", "context": "context", "attempt": "attempt::VARCHAR"}
    mixed = ", ".join(_case(0, name, values, weights, "slot") for name, values, weights in (("level", ["low", "high"], [0.3, None]), ("topic", ["a", "b", "c"], [None] * 3)))
    title = PHRASE(_ask(generator.FIELD), "title", fields="'title'", about="'str: '", so_far="''", **told)
    body = PHRASE(_ask(generator.FIELD), "body", fields="'body'", about="'str: '", so_far="'<<FIELD: title>>' || chr(10) || title || chr(10) || '<<END_FIELD>>'", **told)
    check = lambda value: (_ask(generator.CHECK), {"system": _told(REFLECTION), "kind": "'prose'", "content": value})
    (one, v1), (two, v2) = check("body"), check("fixed")
    repair = {"system": _told(REFLECTION), "kind": "'STR'", "task": "'correct'", "error": "error", "content": "body"}
    record = "'<<FIELD: title>>' || chr(10) || title || chr(10) || '<<END_FIELD>>' || chr(10) || '<<FIELD: body>>' || chr(10) || final || chr(10) || '<<END_FIELD>>'"
    judge = {"system": _told(REFLECTION), "job": "''", "record": record}
    return f"""
WITH n AS (SELECT count(*) AS n FROM orders), tried AS (SELECT range AS attempt, range % n AS slot FROM range(0, 2 * (SELECT n FROM n)), n), mixed AS (SELECT attempt, slot, {mixed} FROM tried), shown AS (SELECT *, {_CONTEXT} AS context FROM mixed),
titled AS (SELECT *, {title} AS title FROM shown), bodied AS (SELECT *, {body} AS body FROM titled),
checked AS (SELECT *, CASE WHEN {_below(0.1, one, "validate", v1)} THEN 'FAIL: ' || {PHRASE(one, "judge", **v1)} END AS error FROM bodied),
fixed AS (SELECT *, CASE WHEN error IS NOT NULL THEN {PHRASE(_ask(generator.REPAIR), "code", **repair)} END AS fixed FROM checked),
ended AS (SELECT *, coalesce(fixed, body) AS final, fixed IS NOT NULL AND {_below(0.1, two, "validate", v2)} AS broken FROM fixed),
judged AS (SELECT *, NOT broken AND NOT {_below(0.1, _ask(generator.JUDGE), "judge", judge)} AS valid FROM ended)
SELECT attempt, level, topic, title, final AS body FROM judged WHERE valid ORDER BY attempt LIMIT (SELECT n FROM n)"""


SQL["tag_pipeline"] = _tag_pipeline_sql()


def _shown(names: list[str], values: list[str]) -> str:
    """SQL for the fields of a record as they are put into prompts."""
    return " || chr(10) || ".join(f"'<<FIELD: {n}>>' || chr(10) || {v} || chr(10) || '<<END_FIELD>>'" for n, v in zip(names, values, strict=True))


def _record_pipeline_sql() -> str:
    """The records of the query ``record_pipeline``: contexts drawn from documents, records made, some evolved, answers repaired, judged; of twice as many attempts as are asked for, the first that are valid."""
    names, told = ["question", "answer"], {"system": _told(REFLECTION), "fields": "'question, answer'", "context": "context"}
    about = text.fields_description([("question", "str", "what is asked"), ("answer", "str", "Python code")])
    make = {**told, "instructions": _lit(RECORD_JOB), "descriptions": _lit(about), "attempt": "attempt::VARCHAR"}
    evolve = {**told, "strategy": "strategy", "record": f"CASE WHEN q1 IS NULL THEN {_shown(['answer'], ['a1'])} ELSE {_shown(names, ['q1', 'a1'])} END"}
    repair = {"system": _told(REFLECTION), "kind": "'STR'", "task": "'fix_python'", "error": _lit(code.parse_error("two words") or ""), "content": "a"}
    judge = {"system": _told(REFLECTION), "job": _lit(RECORD_JOB), "record": _shown(names, ["q", "answer"])}
    made, changed = _ask(generator.RECORD), _ask(generator.EVOLVE)
    strategies = _list(DEFAULT_EVOLUTION)
    return f"""
WITH d AS (SELECT doc_id, lang, source, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), n AS (SELECT count(*) AS n FROM documents),
slots AS (SELECT range AS slot, floor({U(0, "'row'", 'range')} * n)::BIGINT AS i FROM range(0, (SELECT n FROM n)), n), ctx AS (SELECT slot, doc_id, lang, source, {_shown(['doc_id', 'lang', 'source'], ['doc_id', "coalesce(lang, 'None')", "coalesce(source, 'None')"])} AS context FROM slots JOIN d USING (i)),
tried AS (SELECT range AS attempt, range % n AS slot FROM range(0, 2 * (SELECT n FROM n)), n), t AS (SELECT * FROM tried JOIN ctx USING (slot)),
r1 AS (SELECT *, CASE WHEN NOT {_below(0.05, made, "missing", make)} THEN {PHRASE(made, "question", **make)} END AS q1, {PHRASE(made, "answer", **make)} AS a1,
  {U(0, "'evolve 0'", 'slot', 'attempt')} < 0.1 AS gate, {strategies}[1 + floor({U(0, "'strategy'", "'evolve 0'", 'slot', 'attempt')} * {len(DEFAULT_EVOLUTION)})::INT] AS strategy FROM t),
r2 AS (SELECT *, gate AND NOT {_below(0.05, changed, "missing", evolve)} AS new, {PHRASE(changed, "question", **evolve)} AS q2, {PHRASE(changed, "answer", **evolve)} AS a2 FROM r1),
r3 AS (SELECT *, CASE WHEN new THEN q2 ELSE q1 END AS q, CASE WHEN new THEN a2 ELSE a1 END AS a FROM r2), r4 AS (SELECT *, 'answer = "' || {PHRASE(_ask(generator.REPAIR), "code", **repair)} || '"' AS answer FROM r3 WHERE q IS NOT NULL),
judged AS (SELECT *, NOT {_below(0.1, _ask(generator.JUDGE), "judge", judge)} AS valid FROM r4)
SELECT attempt, doc_id, lang, source, q AS question, answer FROM judged WHERE valid ORDER BY attempt LIMIT (SELECT n FROM n)"""


SQL["record_pipeline"] = _record_pipeline_sql()


def stopped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is waited for, with an event that would stop it; the counts of its rows."""
    import threading

    out = _folder(spark, "stopped")
    query_ = flows.each_batch(_stream_of(spark, sf_dir), lambda df, n: sinks.append_batch(df.groupBy("event_type").agg(F.count("*").alias("n")), f"{out}/rows", n), f"{out}/progress")
    flows.run_until(query_, threading.Event())
    return sinks.read_batches(spark, f"{out}/rows", "event_type string, n bigint").groupBy("event_type").agg(F.sum("n").alias("n"))


QUERIES["stopped_stream"], SQL["stopped_stream"] = stopped_stream, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"
