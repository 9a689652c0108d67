import json
import sqlite3
import threading
import time

import pytest
from pyspark.sql import functions as F

from recordloom.functions import code, text
from recordloom.operators import analytics, common, sampling, tags
from recordloom.plans import evolution, generator, nl2code, pipeline, sample_to_dataset
from recordloom.plans.config import AutoConfig, DataField, DataModel
from recordloom.plans.model import DEFAULTS, REFLECTION, ROLES, SYSTEM, HttpModel, ModelEntry, OfflineModel, Router, apply_model, create_router, infer, list_models
from recordloom.sources import readers, sinks
from recordloom.streaming import flows


class Recorder(OfflineModel):
    """Answers as the offline model and writes what it is asked to a file."""

    path = ""

    def generate(self, prompts, role, params):
        with open(self.path, "a") as out:
            for p in prompts:
                out.write(json.dumps({"prompt": p, "role": role, "params": params}) + "\n")
        return super().generate(prompts, role, params)


@pytest.fixture
def recorder(tmp_path):
    client = Recorder()
    client.path = str(tmp_path / "asked.jsonl")
    return client, lambda: [json.loads(line) for line in open(client.path)]


def test_callers_settings_win_but_in_the_suite(spark, recorder):
    client, asked = recorder
    df = spark.createDataFrame([("p",)], "p string")
    apply_model(df, "p", "o", client, "nl", {"temperature": 0.1}).collect()
    apply_model(df, "p", "o", client, "nl", {"temperature": 0.1}, suite=True).collect()
    assert [a["params"] for a in asked()] == [DEFAULTS | {"temperature": 0.1}, ROLES["nl"]]


def test_prompts_of_a_job_are_assembled(spark, recorder):
    client, asked = recorder
    job = DataModel(fields=[DataField("q")], num_examples=2)
    got = generator.run(spark, job, client, max_rounds=1).attempts.collect()
    made = [a for a in asked() if "TASK: record" in a["prompt"]]
    assert len(made) == 2
    assert all(a["prompt"].startswith(f"System: {REFLECTION}\n\nHuman: ") and a["prompt"].endswith("\n\nAssistant:") for a in asked())
    assert all(a["params"] == {"temperature": 0.7, "max_tokens": 4096, "top_p": 0.92} for a in made)
    assert {a["params"]["temperature"] for a in asked() if "TASK: judge" in a["prompt"]} == {0.1}
    bare = sum(len(a["prompt"].encode()) - len(f"System: {REFLECTION}\n\nHuman: \n\nAssistant:".encode()) for a in asked())
    assert sum(r.bytes_read for r in got) == bare


def test_reflections_are_kept_or_taken_away(spark):
    class Thinks:
        def generate(self, prompts, role, params):
            return ["<thinking>why</thinking>\n\n\n<output>it is</output>"] * len(prompts)

    df = spark.createDataFrame([("p",), (None,)], "p string")
    one = lambda **kw: [(r.o, r.bytes_read, r.bytes_written) for r in infer(df, "p", "o", Thinks(), **kw).orderBy("p").collect()]
    assert one(use_reflection=True) == [(None, 0, 0), ("it is", 1, 5)]
    assert one(use_reflection=True, keep_thinking=True)[1][0] == "<output>it is</output>"
    assert one()[1][0] == "<thinking>why</thinking>\n<output>it is</output>"
    assert SYSTEM != REFLECTION


def test_nested_thinking_goes_whole(spark):
    deep = "a" + "<thinking>" * 9 + "x" + "</thinking>" * 9 + "b<Reflection>y</reflection>c"
    got = spark.createDataFrame([(deep,), ("",), (None,)], "t string").select(text.remove_thinking(F.col("t")).alias("o")).collect()
    assert [r.o for r in got] == ["a" + "</thinking>" * 8 + "bc", "", None]
    made = "<thin<thinking>1</thinking>king>2<thi<thinking>3</thinking>nking>4</thinking>5</thinking>6"
    assert spark.createDataFrame([(made,)], "t string").select(text.remove_thinking(F.col("t")).alias("o")).first().o == "5</thinking>6"


def test_temperatures_of_alignment(spark, recorder):
    client, asked = recorder
    evolution.align(spark.createDataFrame([(1, "t", None)], "id long, text string, context string"), client, evolution.AlignOptions(teachers=1)).collect()
    by_task = {a["prompt"].split("TASK: ")[1].split("\n")[0]: a["params"]["temperature"] for a in asked()}
    assert by_task["improve"] == 0.7
    assert by_task["suggest"] == 0.5


def test_routers_take_turns_and_stand_in():
    class One:
        def __init__(self, name, broken=False):
            self.name, self.broken, self.calls = name, broken, 0

        def generate(self, prompts, role, params):
            self.calls += len(prompts)
            if self.broken:
                raise ConnectionError
            return [f"{self.name}:{p}" for p in prompts]

    a, b, bad = One("a"), One("b"), One("c", broken=True)
    assert Router({"m": [a, b]}, "m").generate(["1", "2", "3"], "nl", {}) == ["a:1", "b:2", "a:3"]
    assert Router({"m": [bad, b]}, "m").generate(["1", "2"], "nl", {}) == ["b:1", "b:2"]
    assert Router({"m": [bad]}, "m").generate(["1"], "nl", {}) == [""]
    entries = [ModelEntry("m", {"api_base": "http://x/", "api_key": "k"}), ModelEntry("n", {"api_base": "http://y/"}), ModelEntry("m", {"api_base": "http://z/"})]
    router = create_router(entries)
    assert [c.url for c in router.clients["m"]] == ["http://x/", "http://z/"]
    assert router.clients["m"][0].headers == {"Authorization": "Bearer k"}
    assert router.of("n").clients["n"][0].url == "http://y/"
    assert list_models(entries) == ["m", "n"]
    with pytest.raises(KeyError):
        router.of("other")
    with pytest.raises(ValueError):
        create_router([])
    assert HttpModel("http://x/", "m").generate([], "nl", {}) == []


def test_values_of_seeds_are_expanded():
    class Says:
        def __init__(self, *answers):
            self.answers = list(answers)

        def generate(self, prompts, role, params):
            return [self.answers.pop(0)]

    assert sample_to_dataset.expand({"a": ["x"], "b": ["y"]}, Says('{"columns": [{"column_name": "a", "all_values": "p, q"}]}')) == {"a": ["p", "q"], "b": ["y"]}
    assert sample_to_dataset.expand({"a": ["x"]}, Says("none", '[{"column_name": "a"}]', '[{"column_name": "a", "all_values": ["p, q"]}]')) == {"a": ["p", "q"]}
    assert sample_to_dataset.expand({}, Says()) == {}
    with pytest.raises(RuntimeError):
        sample_to_dataset.expand({"a": ["x"]}, Says("none", "none", '{"columns": [{"column_name": "a", "all_values": 3}]}'))
    assert sample_to_dataset.keyed_list(None, "k") == {"k": []}
    assert sample_to_dataset.keyed_list([1], "k") == {"k": [1]}
    assert sample_to_dataset.keyed_list({"z": 1}, "k") == {"z": 1}


def test_rows_with_other_columns_are_asked_for_again(spark):
    class Extra(OfflineModel):
        def answer(self, prompt, role):
            if "TASK: rows" not in prompt or "TRY: 2" in prompt:
                return super().answer(prompt, role)
            more = {"more": "m"} if "TRY: 0" in prompt else {}
            return "<output><json>" + json.dumps([{"title": "t", **more}]) + "</json></output>"

    sample = spark.createDataFrame([("t1", "b1")], ["title", "body"])
    rows, _ = sample_to_dataset.run(spark, sample, Extra(), sample_to_dataset.Options(num_records=4))
    assert rows.count() == 4
    assert rows.where("title = 't'").count() == 0
    none, _ = sample_to_dataset.run(spark, sample, Extra(), sample_to_dataset.Options(num_records=4, retries=2), prompt="x")
    assert none.count() == 0


def test_pipelines_and_prompts_of_ones_own(spark):
    double = pipeline.Pipeline("double").then("twice", lambda df: df.union(df)).then("again", lambda df: df.union(df), kept=True)
    pipeline.register_pipeline(double)
    df = spark.range(3)
    assert pipeline.PIPELINES["double"].run(df).count() == 12
    assert double.run(df, until="twice").count() == 6
    for broken in (lambda: double.then("twice", lambda df: df), lambda: double.replaced("x", lambda df: df), lambda: double.run(df, "x")):
        with pytest.raises((KeyError, ValueError)):
            broken()
    suite = pipeline.register_prompts(nl2code.SUITE.changed("short", request="TASK: text\nBriefly: {topic} {slot}"))
    got = nl2code.run(spark, AutoConfig(code_lang="sql", num_domains=1, num_topics_per_domain=1), OfflineModel(), 3, prompts=suite)
    assert got.count() == 3
    with pytest.raises(ValueError):
        suite.changed("wrong", request="{nothing_of_the_kind}")
    assert pipeline.PROMPTS["short"]["code"] == nl2code.CODE


def test_servers_of_ones_own(spark):
    check = code.run_on_server(lambda: sqlite3.connect(":memory:"))
    df = spark.createDataFrame([("CREATE TABLE t (a INT)", "SELECT a FROM t"), ("CREATE TABLE t (a INT)", "SELECT b FROM t"), (None, "SELECT 1"), ("CREATE nothing", None)], "s string, q string")
    got = df.select("s", "q", check(F.col("s"), F.col("q")).alias("r")).collect()
    assert [r.r.ok for r in got] == [True, False, True, False]
    assert "no such column" in got[1].r.error


def test_statements_by_dialect(spark):
    df = spark.createDataFrame([("SELECT a FROM missing",), ("SELEC 1 FRM x",), (None,), ("",)], "q string")
    for dialect in ("postgres", "sqlite", "sparksql"):
        assert [r.q for r in code.sql_errors(spark, df, "q", dialect).where("error IS NOT NULL").collect()] == ["SELEC 1 FRM x"]
    with pytest.raises(ValueError):
        code.sql_errors(spark, df, "q", "cobol")


def test_names_are_looked_for_in_their_scopes(spark):
    for source, bad in (("def f():\n    y = 1\n    return y\nprint(y)", "y"), ("x = [i for i in range(3)]\nprint(i)", "i"), ("def f(a):\n    return a + g()\ndef g():\n    return 1", None), ("class A:\n    b = 1\n    def c(self):\n        return self.b", None), ("def f():\n    global z\n    z = 1\nprint(z)", None)):
        messages = spark.createDataFrame([(source,)], "c string").select(code.lint(F.col("c")).alias("m")).first().m
        assert (messages is None) if bad is None else f"undefined name {bad} " in messages, source


def test_streams_stop_on_an_event(spark, tmp_path):
    spark.range(4).write.json(str(tmp_path / "in"))
    stream = flows.stream_jsonl(spark, str(tmp_path / "in"), "id long")
    stop = threading.Event()
    running = flows.each_batch(stream, lambda df, n: None, str(tmp_path / "c"), once=False)
    threading.Timer(1, stop.set).start()
    assert flows.run_until(running, stop) is False
    assert not running.isActive
    assert flows.run_until(flows.each_batch(stream, lambda df, n: None, str(tmp_path / "d")), threading.Event()) is True


def test_two_writers_never_share_a_name(spark, tmp_path):
    paths, df = [], spark.range(3)
    writers = [threading.Thread(target=lambda: paths.append(sinks.write_jsonl(df, str(tmp_path / "out.jsonl")))) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(set(paths)) == 4
    assert all(spark.read.json(p).count() == 3 for p in paths)
    assert not list(tmp_path.glob(".*.claim"))


def test_training_split_only(spark, tmp_path):
    from recordloom.plans.config import DataSource

    spark.range(3).write.parquet(str(tmp_path / "train-00000"))
    spark.range(9).write.parquet(str(tmp_path / "test-00000"))
    assert readers.read_source(spark, DataSource(str(tmp_path), "huggingface")).count() == 3


def test_permutations_at_all_sizes(spark):
    for sizes in ((1,), (2, 3), (7, 1, 5), (4, 4, 4, 4)):
        seeds = {f"s{i}": [f"v{j}" for j in range(n)] for i, n in enumerate(sizes)}
        got = sampling.seed_permutations(spark, seeds, 10**6, seed=3).collect()
        assert len(got) == len({tuple(r[n] for n in seeds) for r in got}) == __import__("math").prod(sizes)
    with pytest.raises(ValueError):
        sampling.seed_permutations(spark, {f"s{i}": ["a"] * 1 + [str(j) for j in range(9999)] for i in range(10)}, 5)


def test_running_counts_without_a_partition(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k")).repartition(7)
    got = analytics.running_counts(df, "k", F.col("k") % 3 == 0).orderBy("k").collect()
    assert [(r.successes, r.failures) for r in got] == [(k // 3 + 1, k - k // 3) for k in range(500)]
    assert analytics.running_counts(df.limit(0), "k", F.col("k") > 0).count() == 0


def test_first_rows_of_keys(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), (None, 5, "n"), (None, 4, "m"), ("b", 1, "y")], "k string, o int, v string")
    assert sorted(map(tuple, tags.keep_first(df, "k", "o").collect()), key=repr) == [("a", 1, "x"), ("b", 1, "y"), (None, 4, "m")]


def test_a_cluster_must_name_the_shared_folder():
    class Session:
        def __init__(self, master, named=None):
            self.conf, self.sparkContext, self.set_to = self, self, None
            self.master, self.named = master, named

        def get(self, key, default):
            return self.named

        def getCheckpointDir(self):
            return self.set_to

        def setCheckpointDir(self, where):
            self.set_to = where

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            common.shared_dir(Session(master))
        assert common.shared_dir(Session(master, "hdfs:///shared")) == "hdfs:///shared"
    alone = Session("local[4]")
    assert common.shared_dir(alone) == alone.set_to


def test_joins_are_broadcast_by_bytes(spark):
    plan = lambda most: spark.range(10).join(common.small(spark.range(5).withColumn("t", F.repeat(F.lit("x"), 1000)), most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(10_000)
    assert "strategy=broadcast" not in plan(1_000)


def test_prompts_of_a_batch_are_under_way_together():
    class Slow(HttpModel):
        def _one(self, prompt, params):
            time.sleep(0.2)
            return prompt

    began = time.perf_counter()
    assert Slow("http://x/", "m", parallel=8).generate([str(i) for i in range(8)], "nl", {}) == [str(i) for i in range(8)]
    assert time.perf_counter() - began < 1
