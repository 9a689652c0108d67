"""Checks of SQL and Python code."""

from __future__ import annotations

import ast
import contextlib
import hashlib
import importlib.util
import re
import sqlite3
import uuid
from collections.abc import Callable
from typing import Any

import pandas as pd
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ..operators.common import saved, shared_dir, small, spread
from .text import decimal_without_scale

#: Dialects that are parsed by Spark's own parser, which lives on the driver; SQLite's by SQLite; all others by the parser of
#: DuckDB, of the PostgreSQL family, in the executors (by Spark's where that package isn't installed).
SPARK_DIALECTS = ("sparksql", "databricks", "hive")
DIALECTS = "sqlite sparksql snowflake redshift postgres oracle mysql materialize hive greenplum exasol duckdb db2 databricks clickhouse bigquery athena ansi".split()


def parse_error(code: str | None) -> str | None:
    """:func:`python_error` of one text."""
    if code is None:
        return None
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return str(error)
    return None


@F.pandas_udf(StringType())
def python_error(code: pd.Series) -> pd.Series:
    """The parser's message for code that isn't Python, else null."""
    return code.map(parse_error).astype(object)


def score_of(code: str | None) -> float | None:
    """:func:`semantic_score` of one text."""
    if code is None:
        return None
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return 0.0
    statements = sum(isinstance(x, ast.stmt) for x in ast.walk(tree))
    if not statements:
        return 0.0
    issues = int(ast.get_docstring(tree) is None)
    for x in ast.walk(tree):
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            issues += ast.get_docstring(x) is None
        names = [a.name for a in x.names] if isinstance(x, ast.Import) else [x.module] if isinstance(x, ast.ImportFrom) and x.module and not x.level else []
        for name in names:
            try:
                issues += importlib.util.find_spec(name.split(".")[0]) is None
            except (ImportError, ValueError):
                issues += 1
    issues += sum(1 for line in code.splitlines() if line.strip() and (len(line) - len(line.lstrip(" "))) % 4)
    return max(0.0, 10.0 - 10.0 * issues / statements)


@F.pandas_udf(DoubleType())
def semantic_score(code: pd.Series) -> pd.Series:
    """0 to 10: 10 less 10 issues a statement, of missing docstrings, odd indents and imports that can't be found; 0 for what isn't Python."""
    return code.map(score_of).astype(float)


def _names(code: str | None) -> str | None:
    """Undefined and unused names of a module, as messages; those that a star import may define are warnings."""
    if code is None:
        return None
    import builtins
    import symtable

    try:
        tree, table = ast.parse(code), symtable.symtable(code, "<code>", "exec")
    except (SyntaxError, ValueError, RecursionError) as error:
        return f"error: {error}"
    used, imported, star = {}, {}, False
    always = set(dir(builtins)) | {"__name__", "__file__", "__doc__"}
    module = {x.get_name() for x in table.get_symbols() if x.is_assigned() or x.is_imported()}

    def walk(scope: symtable.SymbolTable) -> None:
        # A name that its scope, or one around it, doesn't bind is looked for in the module.
        for x in scope.get_symbols():
            if x.is_global() and x.is_assigned():
                module.add(x.get_name())
        for inner in scope.get_children():
            walk(inner)

    def unbound(scope: symtable.SymbolTable, out: set[str]) -> set[str]:
        here = scope.get_type() == "module"
        out |= {x.get_name() for x in scope.get_symbols() if x.is_referenced() and (x.is_global() or here and not x.is_local()) and x.get_name() not in module}
        for inner in scope.get_children():
            unbound(inner, out)
        return out

    walk(table)
    for x in ast.walk(tree):
        if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load):
            used.setdefault(x.id, x.lineno)
        elif isinstance(x, (ast.Import, ast.ImportFrom)):
            for a in x.names:
                star |= a.name == "*"
                if not (isinstance(x, ast.ImportFrom) and x.module == "__future__"):
                    imported[(a.asname or a.name).split(".")[0]] = x.lineno
    missing = unbound(table, set()) - always
    level = "warning" if star else "error"
    out = [f"{level}: undefined name {n} (line {line})" for n, line in sorted(used.items()) if n in missing]
    out += [f"warning: {n} imported but unused (line {line})" for n, line in sorted(imported.items()) if n not in used and n != "*"]
    if "# ..." in code:
        out.append("error: code is left out")
    return "\n".join(out) or None


@F.pandas_udf(StringType())
def lint(code: pd.Series) -> pd.Series:
    """Messages about names and left-out code, one a line, else null. Undefined names are errors, or warnings beside a star import."""
    return code.map(_names).astype(object)


_RAN = StructType([StructField("ok", BooleanType()), StructField("error", StringType())])


def _run(schema: str | None, query: str | None) -> tuple[bool, str | None]:
    from .sqlsplit import statements

    try:
        with sqlite3.connect(":memory:") as db:
            steps = 0

            def stop() -> int:
                nonlocal steps
                steps += 1
                return steps > 200

            db.set_progress_handler(stop, 100_000)
            for part in statements(schema or "") + statements(query or ""):
                for _ in db.execute(part):
                    pass
        db.close()
    except (sqlite3.Error, sqlite3.Warning, ValueError) as error:
        return False, str(error)
    return True, None


@F.pandas_udf(_RAN)
def run_in_sqlite(schema: pd.Series, query: pd.Series) -> pd.DataFrame:
    """Whether a schema and then a query run in an empty in-memory database, and the error; endless ones are stopped."""
    return pd.DataFrame([_run(s, q) for s, q in zip(schema, query, strict=True)], columns=["ok", "error"])


#: Messages and bytes of statements that the driver holds at once.
PARSE_ROWS, PARSE_CHARS = 10_000, 1 << 23


def _sql_message(parser: JavaObject, text: str) -> str | None:
    from .sqlsplit import statements

    for part in statements(text):
        try:
            parser.parsePlan(part)
        except Exception as error:  # noqa: BLE001 - the JVM's parse error, of several classes
            return str(error).strip().splitlines()[0][:512]
    return None


def _sql_verdicts(spark: SparkSession, texts: DataFrame, chunk: int) -> DataFrame:
    """``__key`` (SHA-256 of the statement) and ``__message`` of each of the distinct statements ``text`` that can't be parsed."""
    texts = saved(texts)
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if (parts := chars // PARSE_CHARS + 1) > texts.rdd.getNumPartitions():
        texts = texts.repartition(parts)  # the driver gets one at a time
    folder, schema = f"{shared_dir(spark).rstrip('/')}/verdicts-{uuid.uuid4().hex}", "__key string, __message string"
    spark.createDataFrame([], schema).write.parquet(folder)
    parser = spark._jsparkSession.sessionState().sqlParser()
    found: list[tuple[str, str]] = []

    def write() -> None:
        spark.createDataFrame(found, schema).coalesce(1).write.mode("append").parquet(folder)
        found.clear()

    for (text,) in texts.toLocalIterator():
        if (message := _sql_message(parser, text)) is not None:
            found.append((hashlib.sha256(text.encode()).hexdigest(), message))
            if len(found) >= chunk:
                write()
    if found:
        write()
    return spark.read.schema(schema).parquet(folder)


def _duckdb_error(text: str | None) -> str | None:
    import duckdb

    if text is None:
        return None
    try:
        duckdb.extract_statements(text)
    except duckdb.Error as error:
        return str(error).strip().splitlines()[0][:512]
    return None


def _sqlite_error(text: str | None) -> str | None:
    """The message of SQLite's parser for each statement's plan in an empty database; what names a missing table has been parsed."""
    from .sqlsplit import statements

    if text is None:
        return None
    with contextlib.closing(sqlite3.connect(":memory:")) as db:
        for part in statements(text):
            try:
                db.execute(f"EXPLAIN {part}")
            except (sqlite3.Error, sqlite3.Warning, ValueError) as error:
                if not isinstance(error, sqlite3.OperationalError) or re.search("syntax error|unrecognized token|incomplete input", str(error)):
                    return str(error)[:512]
    return None


@F.pandas_udf(StringType())
def duckdb_error(texts: pd.Series) -> pd.Series:
    """The message of DuckDB's parser for what isn't SQL, else null."""
    return texts.map(_duckdb_error).astype(object)


@F.pandas_udf(StringType())
def sqlite_error(texts: pd.Series) -> pd.Series:
    """The message of SQLite's parser for what isn't SQL, else null."""
    return texts.map(_sqlite_error).astype(object)


def sql_errors(spark: SparkSession, df: DataFrame, column: str, dialect: str = "ansi", chunk: int = PARSE_ROWS) -> DataFrame:
    """``df`` with ``error``: the message of the dialect's parser for ``column``, or null; and a note on decimals without a scale.

    In the dialects of Spark distinct statements are parsed on the driver, for the parser lives there, one after the other,
    however many there are: they reach it in bounded parts, and at most ``chunk`` messages are held until they are written
    to the shared folder. All other dialects are parsed in the executors.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect: {dialect}")
    scale = F.when(decimal_without_scale(F.col(column)), "DECIMAL types have no scale")
    if dialect == "sqlite" or dialect not in SPARK_DIALECTS:
        df = spread(df)
    both = lambda message: F.nullif(F.concat_ws("\n", message, scale), F.lit(""))
    if dialect == "sqlite":
        return df.withColumn("error", both(sqlite_error(F.col(column))))
    if dialect not in SPARK_DIALECTS and importlib.util.find_spec("duckdb"):
        return df.withColumn("error", both(duckdb_error(F.col(column))))
    texts = df.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct()
    verdicts = small(_sql_verdicts(spark, texts, chunk))
    joined = df.join(verdicts, F.sha2(F.col(column), 256) == F.col("__key"), "left")
    return joined.withColumn("error", both(F.col("__message"))).drop("__key", "__message")


def run_on_server(connect: Callable[[], Any], prepare: str = "", clean: str = "") -> Callable[[Column, Column], Column]:
    """A check like :func:`run_in_sqlite` on any server with a Python driver: ``ok`` and ``error`` of a schema and then a query.

    ``connect`` gives a connection (of the usual interface: cursor, execute, rollback, close) and is called in the
    executors, once for each batch. Each pair runs in a transaction that is rolled back. Servers whose definitions don't
    roll back get statements to be run before and after each pair, with ``{name}`` for a name of its own.
    """

    def each(cursor: Any, script: str) -> None:
        from .sqlsplit import statements

        for part in statements(script):
            cursor.execute(part)

    def one(db: Any, schema: str | None, query: str | None) -> tuple[bool, str | None]:
        name, cursor = f"check_{uuid.uuid4().hex[:12]}", db.cursor()
        try:
            each(cursor, prepare.format(name=name))
            each(cursor, f"{schema or ''};\n{query or ''}")
        except Exception as error:  # noqa: BLE001 - each driver has its own classes
            return False, str(error)
        finally:
            db.rollback()
            each(cursor, clean.format(name=name))
        return True, None

    def run(schemas: pd.Series, queries: pd.Series) -> pd.DataFrame:
        with contextlib.closing(connect()) as db:
            return pd.DataFrame([one(db, s, q) for s, q in zip(schemas, queries, strict=True)], columns=["ok", "error"])

    run.__annotations__ = {"schemas": pd.Series, "queries": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, _RAN)


def pair_error(schema_error: Column, query_error: Column) -> Column:
    """The errors of a schema and a query, with what each is of; empty if both are fine."""
    parts = [F.concat(F.lit("***Schema error: "), schema_error), F.concat(F.lit("***Query error: "), query_error)]
    return F.concat_ws("", *parts)
