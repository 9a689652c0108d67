import warnings

import pytest
from pyspark.sql import functions as F

from recordloom.functions import hashing
from recordloom.operators import analytics, common, records, sampling, tags
from recordloom.plans.config import AutoConfig, DataField, DataModel, ManualConfig, Tag, Tags, load_code_config
from recordloom.plans.model import find_by_tags, registry
from recordloom.sources import readers, sinks


def test_row_index_is_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert [(r.k, r.row_index) for r in common.with_row_index(df, "k").orderBy("k").collect()] == [(i, i) for i in range(1000)]
    assert common.with_row_index(df.limit(0), "k").count() == 0


def test_weighted_draws_follow_the_weights(spark):
    mixed = sampling.mix_tags(spark.range(20_000), "id", [("t", ["a", "b", "c"], [3, None, 0])], seed=1)
    counts = {r.t: r["count"] for r in mixed.groupBy("t").count().collect()}
    assert set(counts) == {"a", "b"}
    assert abs(counts["a"] / 20_000 - 0.75) < 0.02
    assert sampling.mix_tags(spark.range(10), "id", [("t", ["x", "y"], [None, None])], 5).collect() == sampling.mix_tags(spark.range(10), "id", [("t", ["x", "y"], [None, None])], 5).collect()
    with pytest.raises(ValueError):
        hashing.weighted_pick([], [], F.lit(0.5))


def test_samples(spark):
    df = spark.range(30).withColumnRenamed("id", "k")
    drawn = sampling.sample_with_replacement(df, 100, "k", 1)
    assert drawn.count() == 30 and drawn.select("k").distinct().count() < 30
    assert sampling.sample_without_replacement(df, 100, "k").count() == 30
    assert sampling.sample_without_replacement(spark.range(80).withColumnRenamed("id", "k"), 70, "k").count() == 50
    assert [r.k for r in sampling.round_robin(spark.range(7), "id", df.limit(3), "k").orderBy("id").collect()] == [0, 1, 2, 0, 1, 2, 0]
    assert len(sampling.few_shot(df, 4, "k").collect()) == 4
    assert sampling.shuffle_rows(df, "k").count() == 30 and sampling.row_at(df, "k", 3).count() == 1
    assert sampling.empty_contexts(spark, 3).count() == 3


@pytest.mark.parametrize("cap", [5, 12, 100])
def test_permutations_are_distinct(spark, cap):
    got = sampling.seed_permutations(spark, {"a": ["x", "y", "x", "z"], "b": ["p", "q", "r", "s"]}, cap).collect()
    assert len({(r.a, r.b) for r in got}) == len(got) == min(cap, 12)
    assert [r.id for r in got] == list(range(len(got)))
    assert sampling.seed_permutations(spark, {}, cap).count() == 0


def test_tag_algebra(spark):
    tag = Tag("foo", ["bar"], [None])
    assert [tag.add(v, w) for v, w in (("bar", None), ("Bar", None), ("bar", 0.4), ("baz", 0.6), (["baz", "bar"], None), (["one", "two"], 0.5))] == [0, 0, 0, 1, 0, 2]
    assert tag.weights == [None, 0.6, 0.5, 0.5]
    every = Tags([tag])
    assert [every.add(Tag(n, ["v"], [None])) for n in ("FOO", "baz", "baz")] == [0, 1, 0]
    assert every.diversity() == 4 and Tags().diversity() == 0
    with pytest.raises(ValueError):
        Tag("none", [], [])
    old = spark.createDataFrame([("foo", "bar", None, 0), ("foo", "Bar", None, 1)], "name string, value string, weight double, pos int")
    new = spark.createDataFrame([("FOO", "BAR", 1.0, 0), ("foo", "new", 0.5, 1), ("foo", "NEW", 0.7, 2)], old.schema)
    assert sorted((r.value, r.weight) for r in tags.add_values(old, new).where("added").collect()) == [("new", 0.5)]
    assert tags.diversity(old.limit(0)).first().diversity == 0


def test_seed_columns(spark):
    batches = spark.createDataFrame([(0, 0, "a", "1"), (0, 1, "b", "high"), (1, 0, "a", "3"), (1, 1, "c", "2.7"), (1, 2, "have", "9")], "worker int, pos int, column_name string, quality_rank string")
    have = spark.createDataFrame([("have",)], "column_name string")
    assert [r.column_name for r in tags.proposals(batches, have, 2).collect()] in (["a", "b"], ["c", "a"])
    assert tags.scrub_names(["First Name", "first-name", "2nd", "!!"]) == {"First Name": "first_name", "first-name": "first_name_2", "2nd": "col_2nd", "!!": "column"}


def test_analytics(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), (None, 3, True), ("b", None, None)], "k string, v int, f boolean")
    assert {r.k: r["count"] for r in analytics.value_counts(df, "k").collect()} == {"a": 2, "b": 1}
    assert {r.k: round(r.share, 3) for r in analytics.value_counts(df, "k", True).collect()} == {"a": 0.667, "b": 0.333}
    assert {r.k: r["mean"] for r in analytics.group_mean(df, "k", "v").collect()} == {"a": 1.5, "b": None}
    assert {r.k: (r.n_True, r.n_False) for r in analytics.crosstab(df, "k", "f", [True, False]).collect()} == {"a": (1, 1)}
    assert analytics.non_null_counts(df).first().asDict() == {"k": 3, "v": 3, "f": 3}
    run = analytics.running_counts(df, "v", F.col("f")).orderBy("v").collect()
    assert [(r.successes, r.failures) for r in run] == [(0, 1), (1, 1), (1, 2), (2, 2)]
    got = df.select(analytics.severity(F.lit(20)).alias("s"), analytics.first_category(F.lit("An ERROR"), ["err", "an"]).alias("c")).first()
    assert (got.s, got.c) == ("warning", "err")


def test_record_checks(spark):
    df = spark.createDataFrame([({"a": "x", "b": " "},), ({"a": "x"},), ({"a": "x", "b": "y"},)], "m map<string,string>")
    assert [r.ok for r in df.select(records.well_formed(F.col("m"), ["a", "b"]).alias("ok")).collect()] == [False, False, True]


def test_job_settings_round_trip():
    job = DataModel(fields=[DataField("q", validator="json", store_full_reflection=True)], contextual_tags=Tags([Tag("t", ["a", "b"], [0.3, None])]), num_examples=3)
    again = DataModel.from_yaml(job.to_yaml())
    assert again == job
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        DataModel.from_yaml("fields: [{name: a, colour: red}]\nunknown: 1")
    assert len(seen) == 2
    for bad in ("fields: []", "fields: [{name: a}]\ngeneration_strategy: x", "fields: [{name: a}]\ndata_source: {uri: x, format: xml}", "fields: [{name: a}]\ndata_source: {uri: x}\ncontextual_tags: [{name: t, values: [v]}]"):
        with pytest.raises(ValueError):
            DataModel.from_yaml(bad)
    with pytest.raises(TypeError):
        DataModel()
    assert isinstance(load_code_config("num_domains: 2\ncode_lang: sql"), AutoConfig)
    assert isinstance(load_code_config({"domain_and_topics": {"a": ["b"]}, "complexity_levels": ["x"]}), ManualConfig)


def test_models(monkeypatch):
    monkeypatch.setenv("A_KEY", "secret")
    config = [{"model_name": "one", "params": {"model": "x", "api_key": "os.environ/A_KEY"}, "tags": ["a", "b"]}, {"model_name": "two", "params": {"api_key": "os.environ/NOT_SET_AT_ALL"}, "tags": ["a"]}]
    with pytest.raises(KeyError):
        registry(config)
    models = registry(config, fail_on_error=False)
    assert models[0].params["api_key"] == "secret"
    assert [m.name for m in find_by_tags(models, ["a", "b"])] == ["one"] and find_by_tags(models, ["z"]) == []


def test_sources_and_sinks(spark, tmp_path):
    from recordloom.plans.config import DataSource

    csv = tmp_path / "a.csv"
    csv.write_text('id,name\n1,"x, ""y""\nz"\n2,w\n')
    assert [r.name for r in readers.read_source(spark, DataSource(str(csv), "csv", ["name"])).collect()] == ['x, "y"\nz', "w"]
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.read_source(spark, DataSource(str(lines), "jsonl")).count() == 2
    lines.write_text('{"a": 1}\n{bad\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_source(spark, DataSource(str(lines), "jsonl")).collect()
    with pytest.raises(ValueError):
        readers.read_source(spark, None)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    base = str(tmp_path / "out.jsonl")
    paths = [sinks.write_jsonl(df, base) for _ in range(3)]
    assert [p.removeprefix(str(tmp_path)) for p in paths] == ["/out.jsonl", "/out_1.jsonl", "/out_2.jsonl"]
    sinks.save_artifacts(df, str(tmp_path / "art"), AutoConfig(), {"n": 2})
    back, config, notes = sinks.load_artifacts(spark, str(tmp_path / "art"))
    assert back.count() == 2 and config["num_domains"] == 10 and notes == {"n": 2}
    assert sinks.to_jsonl_text(df, "k").first().jsonl == '{"k":1,"v":"a"}\n{"k":2,"v":"b"}'
    assert list(sinks.records(df)) == [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}]
    texts = spark.createDataFrame([('[{"a": 1, "b": [2]}, {"a": "x"}]',), ("{'a': 3}",), ("none",)], "t string")
    assert sorted(map(tuple, readers.rows_of_json(texts, "t", ["a", "b"]).collect()), key=repr) == [("1", "[2]"), ("3", None), ("x", None)]
    assert readers.unioned([df, df.select("v")]).count() == 4
