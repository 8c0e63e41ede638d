"""Exact copies by a tree of merges over sorted digest runs, in DataFrame functions alone.

Every partition of the input is a run: its texts' digests in order, one entry for each
different text with the row that stays and the number of rows.  In each round ``FAN_IN``
neighbouring runs become one (a binomial tree of that radix): their entries are exchanged
by (new run, digest), sorted, and equal neighbours merged into one entry, which keeps the
best row and adds up the counts.  So a merged run is never in one place; its digest range
is dealt over all tasks, and a text that fills a third of all rows is one entry a run before
anything is exchanged.  After the last round one run is left.

The winners then go back down the same tree, from each run to the runs it was merged from,
and at last to the rows of the first round, so that no step meets more than ``FAN_IN``
entries, or the rows of ``FAN_IN`` partitions, of one text.

An entry is the same text only where SHA-256, byte length and a second hash of another kind
(xxhash64) all agree; that is verified in every round, as they are the key of the merge.

Results of odd input: a null text is the empty text; rows without id are rows of their own,
any row with an id stays before them; of repeated rows with one id and one text exactly one
stays; an empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import checkpointed, pick

#: Runs merged into one in each round.
FAN_IN = 16
#: What must agree for two texts to be one.
IDENTITY = ["digest", "n_bytes", "second"]
LARGEST, SMALLEST = "largest", "smallest"


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(doc_id, digest, n_bytes, second, place, run)`` of every row; the text goes no further than this.

    ``place`` is a number of its own for each row and ``run`` the partition it was read in.
    Both are written with the digests, so a lost executor cannot change them later.
    """
    rows = pick(df, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    text = F.coalesce(F.col("text"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = rows.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.unhex(F.sha2(F.col("text"), 256)).alias("digest"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.xxhash64("text").alias("second"),
        F.monotonically_increasing_id().alias("place"),
    )
    return checkpointed(rows.withColumn("run", F.shiftright("place", 33)))


def merge_round(runs: DataFrame, best: Callable[[Column], Column], fan_in: int = FAN_IN) -> DataFrame:
    """``fan_in`` neighbouring runs merged into one: ``(run, identity, keep, n)``, one entry for each text.

    Equal entries of one task merge before the exchange, so the first round makes the runs
    of the input's partitions on the way.
    """
    merged = runs.select(_parent(fan_in).alias("run"), *IDENTITY, "keep", "n").groupBy("run", *IDENTITY)
    return merged.agg(best(F.col("keep")).alias("keep"), F.sum("n").alias("n"))


def _parent(fan_in: int) -> Column:
    return F.expr(f"run div {fan_in}")


def winners(levels: list[DataFrame], fan_in: int = FAN_IN) -> DataFrame:
    """Final entries of all texts with more than one row, for each run of the first round that holds the text."""
    found = levels[-1].where("n > 1")
    for level in reversed(levels[:-1]):
        below = level.select(F.col("run").alias("own"), _parent(fan_in).alias("run"), *IDENTITY)
        found = below.join(found, ["run", *IDENTITY]).select(F.col("own").alias("run"), *IDENTITY, "keep", "n")
    return found


def exact_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = LARGEST,
    normalise: Callable[[Column], Column] | None = None,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row.

    ``keep`` says which id of equal texts stays; ``normalise`` is applied to the texts before they are compared.
    """
    if keep not in (LARGEST, SMALLEST):
        raise ValueError(f"Unknown rule: {keep}")
    best, has_id = (F.max, F.col("doc_id").isNotNull()) if keep == LARGEST else (F.min, F.col("doc_id").isNull())
    rows = fingerprints(df, id_col, text_col, normalise)
    last_run = rows.agg(F.max("run")).first()[0] or 0
    levels = [rows.select("run", *IDENTITY, F.struct(has_id.alias("has_id"), "doc_id", "place").alias("keep"), F.lit(1).cast("bigint").alias("n"))]
    while len(levels) == 1 or last_run > 0:
        last_run //= fan_in
        merged = merge_round(levels[-1], best, fan_in)
        levels.append(checkpointed(merged) if last_run > 0 else merged)  # every level is kept for the way back
    found = winners(levels[1:], fan_in)
    rows = rows.withColumn("run", _parent(fan_in))
    return rows.join(found, ["run", *IDENTITY], "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("keep.place") == F.col("place"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
