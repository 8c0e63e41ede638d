"""Helpers the operators share: column selection, Arrow maps, sums over all partitions."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablewright.functions.columns import checkpointed, col

__all__ = ["bounded_batches", "checkpointed", "col", "held_out", "map_arrow", "map_batches", "pick", "public_file", "read", "tree_sum"]

#: Rows of long texts make large batches, so a batch is also bounded in bytes.
BATCH_BYTES = 8 << 20
_BYTES_SETTING, _SPARK_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def public_file(name: str) -> str:
    """Place of an installed public vocabulary file; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pick(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Only the named columns, as ``new=(source name, type)``; other columns, whatever their names, go."""
    return df.select(*[col(source).cast(kind).alias(name) for name, (source, kind) in columns.items()])


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """True where crc32 of the id's text leaves ``rest``; rows without an id are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(True))


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same table, in a session whose Arrow batches are bounded (unless the user has chosen a bound)."""
    conf = df.sparkSession.conf
    if conf.get(_BYTES_SETTING) == _SPARK_DEFAULT:
        conf.set(_BYTES_SETTING, str(BATCH_BYTES))
    return df


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: pa.Schema) -> DataFrame:
    return bounded_batches(df).mapInArrow(run, from_arrow_schema(schema))


def map_batches(df: DataFrame, schema: pa.Schema, f: Callable[[pa.RecordBatch], dict[str, Iterable] | None]) -> DataFrame:
    """``mapInArrow`` with one output batch of columns per input batch; ``None`` or no rows give no batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = f(batch) if batch.num_rows else None
            if columns is not None:
                yield pa.RecordBatch.from_arrays([_array(columns[n], schema.field(n).type) for n in schema.names], schema=schema)

    return map_arrow(df, run, schema)


def _array(values: Iterable, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def tree_sum(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], object], merge: Callable, zero: object) -> object:
    """One bounded value per partition, merged in a tree of fan-in 16, so the driver adds only a few.

    The caller guarantees that ``partial`` and ``merge`` give values of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(partial(batches), 5)], pa.binary())], ["value"])

    rows = bounded_batches(df).mapInArrow(run, "value binary").rdd
    depth = max(2, math.ceil(math.log(max(2, rows.getNumPartitions()), 16)))
    found = rows.map(lambda r: pickle.loads(r.value)).treeAggregate(
        None, lambda a, b: b if a is None else merge(a, b), lambda a, b: b if a is None else a if b is None else merge(a, b), depth
    )
    return zero if found is None else found
