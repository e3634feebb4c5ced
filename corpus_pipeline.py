"""A corpus in five stages, each over all that the one before kept, written as Parquet in between.

1. ``quality``: documents that the rule ensemble rejects go.
2. ``near_duplicates``: of copies and near copies (five-word shingles, similarity 0.8) one document stays.
3. ``decontamination``: documents that hold a window of ten benchmark words (or a whole shorter item) go.
4. ``personal_data``: spans are replaced by their kind in brackets.
5. ``tokens``: doc_id, ids of the texts and the text they decode to; other columns end with the stage before.

A stage gets the table folder for what else it reads (labels, benchmark). Null and empty texts pass every stage unless
quality rejects them; all empty texts are copies of each other. Repeated rows pass together, but ``near_duplicates``
keeps one. Rows travel through the first four stages as one value, so columns of any name come back unchanged (only
``personal_data`` changes ``text``). An empty table gives an empty one in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from funnelwright.llm import bpe, decontaminate, near_copies, pii, quality as rules
from funnelwright.llm.common import shared_folder, stored, table

# The stages' models and iterations have no SQL; they are tested against brute force.
ORACLE_SQL = None


def _carried(docs: DataFrame) -> DataFrame:
    """``row`` with all columns beside ``doc_id`` and ``text``: no name of the input can meet one that a stage makes."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5; the score is a column expression over statistics carried beside the row."""
    labels, own = table(spark, sf_dir, "labels"), _carried(docs)
    # Only labelled rows can be learnt from, so only they are measured for the fit.
    labelled = own.select("doc_id", "text").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    model = rules.fit(rules.statistics(labelled), labels)
    return rules.with_statistics(own).where(model.score("_stats.") >= 0.5).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _carried(docs)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    hit = stored(found.where(F.size("matches") > 0).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct(), "contaminated")
    own = docs.withColumn("own_hash", decontaminate.text_hash())
    return own.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("own_hash") == F.col("hit_hash")), "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = pii.redacted(_carried(docs), pii.fit(pii.find(docs)))
    return own.select(*["text" if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
