"""Corpus pipeline: language ID, line dedup, near duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``docs``, whatever further ones they hold; internal columns start with ``__``.

A document is a row.  Decisions are about its id and text together (``row_key``), so rows of one id with
different texts are decided apart.  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import op1_line_dedup, op2_decontaminate, op4_mixing, op6_language_id, op7_jaccard_join
from weftline.llm.store import materialize, table

#: Cosine under which a text resembles no language at all.
MIN_LANGUAGE = 0.01


def text_key() -> Column:
    return F.xxhash64("text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no likeness to any learned language.

    Null, empty and letterless texts go, also where there is no language to learn from (then all go);
    repeated rows share their fate, whole long texts decide, ties go to the first language by code point.
    """
    model = op6_language_id.prototypes(op6_language_id.training_rows(docs))
    told = op6_language_id.identify(docs, model, out="__language")
    answer = told[told.columns[-1]]
    return told.where((answer["lang"] != "und") & (answer["score"] >= MIN_LANGUAGE)).select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts cross-site boilerplate lines out of the texts; keeps every document.

    Null texts stay null, long texts are taken whole, repeated rows lose the same lines, and a text that
    consists of such lines becomes empty; the rows of the lowest id keep theirs.
    """
    out = op1_line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out.select(*_columns(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every class of near duplicates: of the smallest id, and of its texts that of the smallest hash.

    Exact repeats of the kept row are one document too (that of the smallest hash of all columns stays).
    Null, empty and white-space texts are near nothing and all stay, repeated or not.
    """
    rows = materialize(op7_jaccard_join.classes(docs, text_key()).where("class is not null").groupBy("class", "id", "key").agg(F.count(F.lit(1)).alias("copies")), "pipeline-classes")
    several = materialize(rows.groupBy("class").agg(F.min(F.struct("id", "key")).alias("kept"), F.sum("copies").alias("c")).where("c > 1").select("class", "kept"), "pipeline-kept")
    members = rows.join(_small(several), "class")
    kept = F.struct("id", "key") == F.col("kept")
    gone = _small(materialize(members.where(~kept).select(F.col("id").alias("__id"), F.col("key").alias("__key")), "pipeline-gone"))
    keyed = docs.withColumns({"__d": F.col("doc_id"), "__t": text_key()})
    same = F.col("__d").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__key"))
    left = keyed.join(gone, same, "left_anti")
    repeated = materialize(members.where(kept & (F.col("copies") > 1)).select(F.col("id").alias("__id"), F.col("key").alias("__key")), "pipeline-repeated")
    if repeated.isEmpty():
        return left.select(*_columns(docs))
    w = Window.partitionBy("__d", "__t").orderBy(F.xxhash64(*_columns(docs)))
    once = left.join(repeated, same, "left_semi").withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return left.join(repeated, same, "left_anti").select(*_columns(docs)).unionByName(once.select(*_columns(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none and stay; whole long texts are read; repeated rows share their fate;
    there are no ties.
    """
    keyed = docs.withColumn("__row", F.struct(F.col("doc_id").alias("d"), text_key().alias("t")))
    found = op2_decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="__row")
    gone = _small(materialize(found.select(F.col("doc_id").alias("__gone")).distinct(), "pipeline-contaminated"))
    return keyed.join(gone, F.col("__row") == F.col("__gone"), "left_anti").select(*_columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every remaining document; ``op4_mixing`` states nulls, ties and repeated rows."""
    return op4_mixing.mix(docs, weight=op4_mixing.digits())


def _small(keys: DataFrame, most: int = op7_jaccard_join.BROADCAST_ROWS) -> DataFrame:
    """A written table of keys, broadcast up to ``most`` rows (counted), so texts need not move to meet it."""
    return F.broadcast(keys) if keys.count() <= most else keys


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
