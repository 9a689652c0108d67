import pytest
from pyspark.sql import functions as F

from recordloom.functions import code, jsonx, text
from recordloom.functions.sqlsplit import statements


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.fixture(autouse=True)
def column(spark):
    """A column can only be made once there is a session."""
    global X
    X = F.col("x")


def test_delimited_fields(spark):
    response = "before <<FIELD: a>>\n one\ntwo \n<<END_FIELD>> <<FIELD:b>><<END_FIELD>> <<FIELD: a>>last<<END_FIELD>> <<FIELD: two words>>no<<END_FIELD>> <<FIELD: c>>open"
    assert one(spark, text.parse_fields(X), response) == {"a": "last", "b": ""}
    assert one(spark, text.parse_fields(X), "nothing") == {}
    assert one(spark, text.parse_first_field(X), "x <<FIELD: q>> v <<y=1>> w <<END_FIELD>>") == "v <<y=1>> w"
    assert one(spark, text.parse_first_field(X), " plain ") == "plain"
    made = text.format_record({"a": X, "b": F.lit(None)})
    assert one(spark, made, "v") == "<<FIELD: a>>\nv\n<<END_FIELD>>\n<<FIELD: b>>\nNone\n<<END_FIELD>>"
    assert one(spark, text.parse_fields(text.format_record({"a": X})), "v w") == {"a": "v w"}


def test_reflections(spark):
    split = text.split_reflection(X)
    assert one(spark, split, "a<thinking> t </thinking>b<output> o </output>c") == ("<thinking> t </thinking>", "o")
    assert one(spark, split, "<output>open end ")["output"] == "open end"
    assert one(spark, split, "<output> </output>")["output"] == "<output> </output>"
    assert one(spark, text.remove_thinking(X), "a<THINKING>x</thinking>b<reflection>y</reflection>\n\n\nc<thinking>open") == "ab\nc"
    assert one(spark, text.remove_thinking(X), "one\\ntwo") == "one\ntwo"
    assert one(spark, text.extract_thinking(X), "<thinking>a</thinking> x <output>b") == "a"
    assert one(spark, text.extract_thinking(X), "<thinking>a<output>b") == "a"
    assert one(spark, text.extract_thinking(X), "pre <json>1</json> mid <json>2") == "pre <json>1</json> mid"
    assert one(spark, text.extract_thinking(X), "none") == "No thinking content found"
    assert one(spark, text.extract_output(X), "<output> </output><output>b") == "b"
    assert one(spark, text.extract_output(X), "<thinking>a</thinking> rest") == "rest"
    assert one(spark, text.extract_output(X), "a <json>1</json> <json>2") == "<json>2"
    assert one(spark, text.extract_output(X), "none") == "No output content found"


def test_fences(spark):
    assert one(spark, text.extract_code(X), "no fence") == "no fence"
    assert one(spark, text.extract_code(X), "a ```sql\nSELECT 1\n``` b") == "SELECT 1"
    assert one(spark, text.extract_code(X), "```only one") == ""
    assert one(spark, text.extract_code(X), "```a``` x ```b```") == "a``` x ```b"
    assert one(spark, text.json_block(X), "x ```json\n{}\n```") == "{}"
    assert one(spark, text.yaml_block(X), "```yaml\na: 1\n```") == "a: 1"
    assert one(spark, text.unwrap_code(X), "a ```python\nx\n``` b ```cobol\ny\n```") == "a x b cobol\ny"


def test_names_and_scripts(spark):
    assert one(spark, text.safe_name(X), " A b-c! ") == "a_b_c"
    assert one(spark, text.database_name(X), "1 Data-base") == "db_1_data_base"
    assert one(spark, text.split_statements(X), " a; ;b ") == ["a;", "b;"]
    assert one(spark, text.qualify_query(X, "d"), "SELECT EXTRACT(YEAR FROM x) FROM t JOIN u") == "SELECT EXTRACT(YEAR FROM x) FROM d.t JOIN d.u"
    assert one(spark, text.qualify_ddl(X, "d"), "CREATE VIEW v AS SELECT 1; INSERT INTO t VALUES (1)") == "CREATE VIEW `d.v` AS SELECT 1; INSERT INTO `d.t` VALUES (1)"
    assert one(spark, text.render("{{{a}}} {b}", {"a": X, "b": "c"}), None) == "{None} c"
    assert statements("a; 'b;c'; -- d;\n e /* ; */;") == ["a", "'b;c'", "-- d;\n e /* ; */"]


def test_json(spark):
    assert one(spark, jsonx.json_error(X), '{"a": 1}') is None
    assert "Extra data" in one(spark, jsonx.json_error(X), '{"a": 1} x')
    assert one(spark, jsonx.json_error(X), None) is None
    for broken, whole in [("{'a': 1,}", '{"a": 1}'), ('{"a": [1, 2', '{"a": [1, 2]}'), ("{a: True, b: None}", '{"a": true, "b": null}'), ("x {\"k\": \"v\"} y", '{"k": "v"}'), ("nothing", ""), ('{"a":1}\n{"a":2}', '[{"a": 1}, {"a": 2}]')]:
        assert jsonx.repair(broken) == whole
    assert "error" in one(spark, jsonx.tagged_json(X), "<json> </json>")
    assert one(spark, jsonx.largest_object(X), '{"a": 1} {"b": {"c": 22}} TERMINATE') == '{"b": {"c": 22}}'
    assert one(spark, jsonx.largest_object(X), "{bad}") == "{}"
    assert one(spark, jsonx.is_jsonl(X), '{"a": 1}\nx')
    assert one(spark, jsonx.values_list(X), ["a, b"], "array<string>") == ["a", "b"]
    assert one(spark, jsonx.exactly(X, 3, "-"), None, "array<string>") == ["-", "-", "-"]
    four = F.array(*map(F.lit, "abcd"))
    assert one(spark, jsonx.rank_texts(X, four), [3, 3, 9, 0], "array<int>") == ["d", "a", "b", "c"]
    assert one(spark, jsonx.rank_texts(X, four), None, "array<int>") == ["a", "b", "c", "d"]
    assert [one(spark, jsonx.choose_option(X, four), v) for v in ("option_2", "option_9", "x", None)] == ["b", "a", "a", "a"]


def test_code_checks(spark):
    assert one(spark, code.python_error(X), "") is None
    assert one(spark, code.python_error(X), "def (") is not None
    assert one(spark, code.semantic_score(X), '"""D."""\nx = 1') == 10.0
    assert one(spark, code.semantic_score(X), "import surely_not_there") < 10
    assert "undefined name y" in one(spark, code.lint(X), "x = y")
    assert one(spark, code.lint(X), "from os import *\nx = y").startswith("warning")
    assert "left out" in one(spark, code.lint(X), "# ... rest")
    ran = code.run_in_sqlite(F.lit("CREATE TABLE t (a INT);"), X)
    assert one(spark, ran, "SELECT a FROM t") == (True, None)
    assert one(spark, ran, "SELECT b FROM t")["ok"] is False
    df = spark.createDataFrame([("SELECT 1",), ("SELEC 1",), ("SELECT CAST(a AS DECIMAL(10)) FROM t",), ("SELECT 1; SELECT 2;",), (None,)], "q string")
    errors = {r.q: r.error for r in code.sql_errors(spark, df, "q").collect()}
    assert errors["SELECT 1"] is None and errors["SELECT 1; SELECT 2;"] is None and errors[None] is None
    assert errors["SELEC 1"] and "DECIMAL" in errors["SELECT CAST(a AS DECIMAL(10)) FROM t"]


def test_any_number_of_statements_is_parsed(spark):
    df = spark.range(10_050).select("id", F.concat(F.when(F.col("id") % 50 == 0, "SELEC ").otherwise("SELECT "), F.col("id")).alias("q"))
    got = code.sql_errors(spark, df, "q", chunk=7)
    assert got.columns == ["id", "q", "error"] and got.count() == 10_050
    assert sorted(r.id for r in got.where("error IS NOT NULL").collect()) == list(range(0, 10_050, 50))
