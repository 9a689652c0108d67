"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, licenses, linededup, packing, pii, quality, simhash, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator, over its whole table."""
    return {
        "op1_best_fit_packing": _on("documents", packing.pack),
        "op2_pii": _on("documents", pii.personal_data),
        "op3_chat_formatting": _on("conversations", lambda turns: chat.render_log(chat.log_of_turns(turns))),
        "op4_warc": _on("pages", warc.warc_round_trip),
        "op5_decontamination": lambda spark, sf_dir: decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")),
        "op6_license_scan": _on("documents", licenses.license_scan),
        "op7_url_filter": _on("pages", urls.score_urls),
        "op8_line_dedup": _on("documents", linededup.line_dedup),
        "op9_quality_rules": _on("documents", quality.quality_rules),
        "op10_simhash_near_dedup": _on("documents", simhash.near_duplicates),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that it can express on whole tables."""
    return {
        "op3_chat_formatting": chat.SQL,
        "op4_warc": warc.SQL,
        "op8_line_dedup": linededup.SQL.format(docs="documents"),
        "op9_quality_rules": quality.SQL.format(docs="documents"),
    }
