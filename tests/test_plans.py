import pytest
from pyspark.sql import functions as F

from recordloom.plans import configgen, evolution, generator, nl2code, sample_to_dataset
from recordloom.plans.config import AutoConfig, DataField, DataModel, Evolution, ManualConfig, Tag, Tags
from recordloom.plans.model import OfflineModel, apply_model
from recordloom.streaming import flows

TAGS = Tags([Tag("level", ["low", "high"], [0.3, None])])


def test_generator_makes_as_many_valid_records_as_asked(spark):
    job = DataModel(fields=[DataField("q"), DataField("a", validator="python")], contextual_tags=TAGS, num_examples=20, evolution=Evolution(rate=0.5))
    got = generator.run(spark, job, OfflineModel(fail_rate=0.3, missing_rate=0.2))
    assert got.records.count() == got.successes == 20
    assert got.failures > 0
    assert got.attempts.count() == 20 + got.failures
    assert {r.level for r in got.records.collect()} <= {"low", "high"}
    assert got.records.where("a NOT LIKE 'answer =%'").count() == 0


def test_generator_stops_when_nothing_is_valid(spark):
    job = DataModel(fields=[DataField("q")], contextual_tags=TAGS, num_examples=3)
    got = generator.run(spark, job, OfflineModel(fail_rate=1.0), max_rounds=2)
    assert got.successes == 0 and got.failures == 3 + 8 and got.records.count() == 0


def test_field_by_field(spark):
    job = DataModel(fields=[DataField("q"), DataField("a", validator="json")], num_examples=4, generation_strategy="field", use_reflection=False)
    got = generator.run(spark, job, OfflineModel(), max_rounds=1)
    assert got.attempts.where("reason IS NOT NULL").count() == 4 - got.successes
    assert generator.run(spark, DataModel(fields=[DataField("q")], num_examples=0), OfflineModel()).records.count() == 0


def test_null_prompts_cost_no_call(spark):
    class Counting:
        def generate(self, prompts, role, params):
            assert all(p is not None for p in prompts)
            return ["ok"] * len(prompts)

    df = spark.range(6).withColumn("p", F.when(F.col("id") % 2 == 0, F.lit("x")))
    assert [r.o for r in apply_model(df, "p", "o", Counting()).orderBy("id").collect()] == ["ok", None] * 3


def test_evolution_and_alignment(spark):
    items = spark.createDataFrame([(1, "first text", "c"), (2, None, None)], "id long, text string, context string")
    best = {r.id: r.text for r in evolution.evolve(items, OfflineModel()).collect()}
    assert best[2] is None and best[1]
    same = {r.id: r.text for r in evolution.evolve(items, OfflineModel(bad_json_rate=1.0)).collect()}
    assert same[1] == "first text"
    got = {r.id: r for r in evolution.align(items, OfflineModel()).collect()}
    assert len(got[1].suggestions) == 3 and got[1].final in ("first text", got[1].co_taught, got[1].self_taught)
    broken = {r.id: r for r in evolution.align(items, OfflineModel(bad_json_rate=1.0)).collect()}
    assert broken[1].final == "first text" and broken[1].suggestions == ["No suggestion"] * 3


@pytest.mark.parametrize("lang", ["sql", "python"])
def test_code_records(spark, lang):
    config = ManualConfig(["easy"], {"a": ["b", "c"], "d": []}, code_lang=lang, semantic_validation=True)
    got = nl2code.run(spark, config, OfflineModel(), 12)
    assert got.count() == 12
    assert {r.syntax_validation for r in got.collect()} == {"passed"}
    assert all(f"{c}_score" in got.columns for c in nl2code.CRITERIA[lang])
    with pytest.raises(ValueError):
        nl2code.run(spark, AutoConfig(code_lang="cobol"), OfflineModel(), 1)


def test_sample_to_dataset(spark):
    sample = spark.createDataFrame([("t1", "b1"), ("t2", "b2")], ["Title", "Body"])
    rows, seeded = sample_to_dataset.run(spark, sample, OfflineModel(), sample_to_dataset.Options(num_records=6))
    assert rows.columns == ["title", "body"] and rows.count() == 6 and len(seeded.columns) > 2


def test_settings_from_a_task():
    text = configgen.generate_config("questions about gardens", OfflineModel(), 50)
    job = DataModel.from_yaml(text)
    assert job.contextual_tags.diversity() >= 50 and job.fields
    with pytest.raises(ValueError):
        configgen.ConfigGenerator(OfflineModel()).generate_tags()
    assert configgen.expand_tags("x", OfflineModel(bad_json_rate=1.0)).tags == []


def test_streams_give_what_batches_give(spark, tmp_path):
    schema = "k int, ok boolean, ts timestamp"
    df = spark.range(50).select(F.col("id").cast("int").alias("k"), (F.col("id") % 3 > 0).alias("ok"), F.timestamp_seconds(F.col("id") * 600).alias("ts"))
    df.repartition(4).write.json(str(tmp_path / "in"))
    stream = flows.stream_jsonl(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    flows.valid_records(stream, F.col("ok"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.schema(schema).json(str(tmp_path / "out")).count() == df.where("ok").count()
    seen = []
    flows.each_batch(stream, lambda b, n: seen.append(b.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(seen) == 50 and len(seen) > 1
    query = flows.running_counts(stream, F.col("ok")).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert tuple(spark.table("totals").first()) == (33, 17)
    assert flows.windowed(df, "ts", "ok", "1 hour").agg(F.sum("n")).first()[0] == 50
    assert flows.sessions(df, "ts", "ok", "5 minutes").count() == 50
    assert flows.recent(df, "k", 3).count() == 3


def test_tables_through_evolution_and_alignment(spark):
    table = spark.createDataFrame([(1, "a", 2), (2, None, 3)], "k long, v string, n int")
    for f in (evolution.evolve_table, evolution.align_table):
        got = f(table, "k", OfflineModel())
        assert got.columns == ["k", "v", "n"] and sorted(map(tuple, got.collect())) == [(1, "a", 2), (2, None, 3)]


def test_generation_prompts(spark):
    sample = spark.createDataFrame([("t1", "b1")], ["title", "body"])
    prompt = sample_to_dataset.generation_prompt(sample, {"my_seed": ["x"]}, OfflineModel(), sample_to_dataset.Options())
    assert "my seed: {my_seed}" in prompt and '{{"title":"t1","body":"b1"}}' in prompt
    with pytest.raises(RuntimeError):
        sample_to_dataset.generation_prompt(sample, {}, OfflineModel(bad_json_rate=1.0), sample_to_dataset.Options())


def test_validation_columns(spark):
    from recordloom.plans import validation

    df = spark.createDataFrame([("CREATE TABLE t (a INT)", "SELECT a FROM t"), ("CREATE TABLE t (a INT)", "SELECT b FROM t"), ("CREATE nothing", "SELECT 1")], "s string, q string")
    got = {(r.s[-1], r.q): r for r in validation.sql_checks(df, "s", "q").collect()}
    fine, missing, broken = (got[k] for k in ((")", "SELECT a FROM t"), (")", "SELECT b FROM t"), ("g", "SELECT 1")))
    assert fine.is_valid_sql_with_sqlite and fine.error_msgs_sqlite == ""
    assert missing.is_valid_sql_with_parser and not missing.is_valid_query_with_sqlite and "***Query error" in missing.error_msgs_sqlite
    assert not broken.is_valid_schema_with_parser and broken.is_valid_query_with_sqlite is None and "***Schema error" in broken.error_msgs_parser
    assert validation.seconds(df) > 0
    assert df.select(validation.only(F.lit("Post gres"), "postgres", F.lit(1)).alias("x")).first().x == 1


def test_chat_service_and_json_answers(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from recordloom.plans.model import HttpModel, ask_json, flatten_messages

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = f"<thinking>why</thinking><output><json>{{'asked': '{body['messages'][1]['content']}', 't': {body.get('temperature', 0)}, 'x': {int('other' in body)}}}</json></output>"
            out = json.dumps({"choices": [{"message": {"content": text}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = HttpModel(f"http://127.0.0.1:{server.server_port}/", "m")
    assert "'x': 0" in client.generate(["p"], "nl", {"temperature": 1, "other": 2})[0]
    got = ask_json(spark.createDataFrame([("q",)], "p string"), "p", client).first()
    server.shutdown()
    assert got.thinking == "why" and json.loads(got.json)["asked"] == "q"
    assert HttpModel("http://127.0.0.1:9/", "m", tries=1, timeout=1).generate(["p"], "nl", {}) == [""]
    assert flatten_messages([{"role": "user", "content": "a"}]) == "a"
    assert flatten_messages([{"role": "user", "content": "a"}, {"role": "system", "content": "b"}]) == "USER:\na\n---\n\nSYSTEM:\nb\n---"


def test_validators_by_name(spark):
    from recordloom.plans.config import read_model

    job = DataModel(fields=[DataField("q")])
    df = spark.createDataFrame([("SELECT 1",), ("SELEC",)], "v string")
    for name, errors in (("sql", 1), ("sql:sqlite", 1), ("json", 2), ("json:x", 2), ("", 0)):
        got = generator.field_error(df, DataField("q", validator=name), "v", "e", OfflineModel(), job)
        assert got.where("e IS NOT NULL").count() == errors, name
    with pytest.raises(ValueError):
        generator.field_error(df, DataField("q", validator="sql:cobol"), "v", "e", OfflineModel(), job)
    assert read_model("a: [") is None and read_model("fields: []") is None and read_model("fields: [{name: a}]").fields[0].name == "a"


def test_pipelines_cover_their_tables(spark, tmp_path):
    from recordloom.plans import catalog

    for name, n in (("orders", 9), ("supplier", 2)):
        spark.range(n).write.parquet(str(tmp_path / f"{name}.parquet"))
    long = "word " * 20_000
    spark.createDataFrame([(i, long if i == 2 else f"text {i}") for i in range(4)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert catalog.QUERIES["tag_pipeline"](spark, str(tmp_path)).count() == 9
    for name in ("evolution_generations", "aaa_pipeline"):
        assert {r.id for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} == {0, 1, 2, 3}


def test_populations_stay_in_the_rows_of_their_items(spark):
    """Equal and null ids are items of their own, and nothing but the answers' files is shuffled."""
    items = spark.createDataFrame([(1, "one", "c"), (1, "two", "c"), (None, "three", None), (4, None, "d")], "id long, text string, context string")
    got = evolution.evolve(items, OfflineModel(), evolution.EvolutionOptions(population=3))
    alone = {t: evolution.evolve(items.where(F.col("text") == t), OfflineModel(), evolution.EvolutionOptions(population=3)).first().text for t in ("one", "two", "three")}
    assert sorted((r.id or 0, r.text or "") for r in got.collect()) == sorted([(1, alone["one"]), (1, alone["two"]), (0, alone["three"]), (4, "")])
    assert got.columns == ["id", "context", "text"] and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_arrays_of_prompts(spark):
    asked = apply_model(spark.sql("SELECT array('TASK: text', NULL) AS p UNION ALL SELECT NULL UNION ALL SELECT array()"), "p", "o", OfflineModel())
    one = OfflineModel().answer("TASK: text", "nl")
    assert sorted((r.o for r in asked.collect()), key=repr) == sorted([[one, None], None, []], key=repr)


def test_small_tables_are_spread_over_all_slots(spark, tmp_path):
    """One file with one group of rows is one task, however many rows it has."""
    from recordloom.operators.common import spread

    spark.range(100_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).withColumn("p", F.lit("TASK: text"))
    assert df.rdd.getNumPartitions() < 4 and spread(df).rdd.getNumPartitions() >= 4
    rows = apply_model(df, "p", "o", OfflineModel()).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(rows) >= 4 and max(r["count"] for r in rows) < 50_000 and sum(r["count"] for r in rows) == 100_000
    assert spread(df.repartition(1)).rdd.getNumPartitions() == 1 and spread(df.limit(0)).count() == 0


def _busy_tasks(df):
    """The most rows that one task has, and how many tasks have any."""
    counts = [r["count"] for r in df.withColumn("__part", F.spark_partition_id()).groupBy("__part").count().collect()]
    return max(counts), len(counts)


def test_calls_for_a_small_file_run_in_all_slots(spark, tmp_path):
    from recordloom.plans import catalog

    spark.range(40_000).selectExpr("id AS p_partkey", "concat('Brand#', id % 5) AS p_brand", "uuid() AS p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    most, tasks = _busy_tasks(catalog.QUERIES["offline_inference"](spark, str(tmp_path)))
    assert tasks >= 4 and most < 20_000


@pytest.mark.parametrize("name", ["sqlite_execution", "python_syntax", "sql_methods_part"])
def test_checks_of_a_small_file_run_in_all_slots(spark, tmp_path, name):
    from recordloom.plans import catalog

    spark.range(40_000).selectExpr("id AS p_partkey", "cast(id % 7 AS int) AS p_size", "uuid() AS p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    most, tasks = _busy_tasks(catalog.QUERIES[name](spark, str(tmp_path)))
    assert tasks >= 4 and most < 20_000
