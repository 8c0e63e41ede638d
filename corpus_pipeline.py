"""A training corpus out of raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``docs``, whatever they are besides ``doc_id`` and ``text``.

Results of odd input: null and empty texts fail the quality rules; rows that repeat an id
and its text count as one document, of which near-copy removal keeps one row; an id with
several texts is judged text by text, and keeps one row for each group of near copies that
it names; rows without id stay unless the rules, the classifier or the benchmark reject
their text; empty tables pass through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import shared_folder
from tablewright.llm import contamination, near_copies, pieces, quality_rules, toxicity
from tablewright.llm.common import public_file, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the quality rules keep."""
    return quality_rules.keep_good(docs)


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by a model of the labelled ones among them."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    kept = near_copies.groups(docs).where("kept AND doc_id IS NOT NULL")
    one = kept.groupBy("doc_id", "group").agg(F.min("text_key").alias("text_key"))
    name = _free_name(docs)
    keyed = docs.withColumn(name, F.xxhash64(F.col("text").cast("string")))
    own = F.col("doc_id").cast("bigint")
    there = one.select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"))
    same = (own == F.col("_kept_id")) & (F.col(name) == F.col("_kept_key"))
    with_id = keyed.where(own.isNotNull()).join(there, same, "left_semi").dropDuplicates(["doc_id", name])
    return with_id.drop(name).unionByName(docs.where(own.isNull()))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    name = _free_name(docs)
    keyed = docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
    found = contamination.contamination(keyed, read(spark, sf_dir, "benchmark"), id_col=name)
    bad = found.where("contaminated").select(F.col("doc_id").alias("_bad_key"))
    return keyed.join(bad, F.col(name) == F.col("_bad_key"), "left_anti").drop(name)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document and the text they decode to, as digests."""
    return pieces.encode_digests(docs, public_file("piece_bpe_32k.model"))


def _free_name(docs: DataFrame) -> str:
    """Name of a key column that no column of the documents has."""
    name = "_text_key"
    while name in map(str.lower, docs.columns):
        name += "_"
    return name


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("toxicity", clean_language),
    ("near_copies", one_of_each),
    ("contamination", uncontaminated),
    ("pieces", encoded),
]

#: SQL states neither compression, nor the classifier, nor the encoder; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4()}"
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
