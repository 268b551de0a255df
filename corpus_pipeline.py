"""From raw documents to packed training sequences, in five stages.

Every stage gets all documents that the one before it kept, and its decisions take effect:

1. ``quality``: documents that the quality classifier rejects go.
2. ``near_duplicates``: of each group connected by 5-word shingle similarity of 0.8 or more, the document with the
   smallest id stays (of rows without ids, and of one id with several texts, the smallest text hash; equal rows once).
   Documents without words stay.
3. ``substring_dedup``: words of 50-word runs that an earlier document holds go; a text that loses words is its kept
   words joined by one space, and ``n_chars`` follows. Others stay as they are.
4. ``decontamination``: documents that hold a benchmark item (0.8 on 5-word shingles) go.
5. ``packing``: what is left, as pieces of sequences of 1024 tokens.

All but the last return the columns of their input. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import contrail
from contrail.llm import decontaminate, jaccard_join, packing, quality, recompression
from contrail.llm.common import held_out, table
from contrail.session import materialize

# Workers need not have this folder on their path: functions travel with their code.
cloudpickle.register_pickle_by_value(contrail)

LEAST_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5))
    labels = labels.select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    weights = quality.fit(docs.select(F.col("doc_id").alias("key"), "text"), labels)
    return quality.score(docs, weights, "__score").where(F.col("__score") >= LEAST_SCORE).drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = materialize(spark, jaccard_join.classes(docs, gram=5, percent=80), "classes")
    best = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("b"))
    best = best.select(F.col("b.doc_id").alias("__id"), F.col("b.th").alias("__th"))
    empty = found.where("n_shingles = 0").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    stays = best.union(empty).distinct()
    marked = docs.withColumn("__hash", text_hash)
    kept = marked.join(stays, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__hash"]).drop("__hash")


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shorter = recompression.dedup(docs)
    if "n_chars" in docs.columns:
        shorter = shorter.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return shorter.select(*[f"`{c}`" for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_substrings),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Classifier, shingle hashes and tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
