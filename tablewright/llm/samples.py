"""Bounded samples of labelled rows, for models that one machine fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import held_out, pick


def labelled(
    labels: DataFrame, label_col: str, bound: int, modulus: int, rest: int, id_col: str = "doc_id"
) -> DataFrame:
    """At most ``bound`` rows ``(doc_id, label double)``, chosen by a hash of the id and the same ones in every run, none of them held out.

    Rows without id or label are left out; several labels of one id give their mean.
    """
    rows = pick(labels, doc_id=(id_col, "bigint"), label=(label_col, "double")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.where(~held_out(F.col("doc_id"), modulus, rest)).groupBy("doc_id").agg(F.avg("label").alias("label"))
    n = rows.count()
    if n > bound:
        place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40))
        rows = rows.where(place < int((1 << 40) * (bound / n))).orderBy(place, "doc_id").limit(bound)
    return rows


def with_text(df: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(text, label)`` of the sampled ids.  The sample is bounded, so it is sent to the texts, not they to it."""
    texts = pick(df, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    return texts.join(F.broadcast(sample), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "label")
