"""Queries of the training-data operators: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import (
    op1_line_dedup,
    op2_decontaminate,
    op3_quality,
    op4_mixing,
    op5_pii,
    op6_language_id,
    op7_jaccard_join,
    op8_license_scan,
    op9_token_counts,
    op10_imatch,
)
from weftline.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup_(spark: SparkSession, sf: str) -> DataFrame:
    return op1_line_dedup.digest(table(spark, sf, "documents"))


def op2_decontaminate_(spark: SparkSession, sf: str) -> DataFrame:
    return op2_decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op3_quality_(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    grades = op3_quality.graded(table(spark, sf, "labels")).where(~op3_quality.held_out())
    model = op3_quality.fit_quality(docs, grades, 3)
    return op3_quality.score_quality(docs, model).withColumn("held_out", op3_quality.held_out())


def op4_mixing_(spark: SparkSession, sf: str) -> DataFrame:
    return op4_mixing.mix(table(spark, sf, "documents"), weight=op4_mixing.digits())


def op5_pii_(spark: SparkSession, sf: str) -> DataFrame:
    return op5_pii.digest(table(spark, sf, "documents"))


def op6_language_id_(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = op6_language_id.prototypes(op6_language_id.training_rows(docs))
    held = docs.select("doc_id", "text", op6_language_id.held_out().alias("held_out"))
    told = op6_language_id.identify(held, model)
    return told.select("doc_id", "held_out", told["language"]["lang"].alias("lang_pred"), told["language"]["score"].alias("score"))


def op7_jaccard_join_(spark: SparkSession, sf: str) -> DataFrame:
    return op7_jaccard_join.components(table(spark, sf, "documents"))


def op8_license_scan_(spark: SparkSession, sf: str) -> DataFrame:
    return op8_license_scan.license_scan(table(spark, sf, "documents"))


def op9_token_counts_(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return op9_token_counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_imatch_(spark: SparkSession, sf: str) -> DataFrame:
    return op10_imatch.digest(table(spark, sf, "documents"))


CATALOG: dict[str, tuple[Query, str | None]] = {
    "op1_line_dedup": (op1_line_dedup_, op1_line_dedup.SQL),
    "op3_quality": (op3_quality_, None),
    "op4_mixing": (op4_mixing_, op4_mixing.SQL),
    "op6_language_id": (op6_language_id_, None),
    "op9_token_counts": (op9_token_counts_, None),
    "op2_decontaminate": (op2_decontaminate_, None),
    "op5_pii": (op5_pii_, None),
    "op7_jaccard_join": (op7_jaccard_join_, None),
    "op8_license_scan": (op8_license_scan_, None),
    "op10_imatch": (op10_imatch_, None),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
