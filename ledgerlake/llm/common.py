"""Small helpers shared by the operators: staging tables in the shared folder, table reads, Arrow rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.session import checkpoint_dir

# White space of the word contracts: space and the control characters 9 to 13.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (every executor can read and write it)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written in this block are deleted at its end, but for those written with ``keep``.

    What leaves the block must not read them: everything that is returned is written with ``keep`` or reads
    only such tables. Kept tables belong to the enclosing block, if there is one.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and gives Catalyst the table's real
    size, so that it broadcasts only what is below ``spark.sql.autoBroadcastJoinThreshold``. The codec is zstd:
    Parquet's snappy codec holds whole pages in direct buffers, outside the heap, until a collection frees them.
    """
    path = new_folder(df.sparkSession, name)
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words (runs of characters that are not white space); null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def row_key(df: DataFrame) -> DataFrame:
    """Add ``_h``, a hash of the text (and of a missing number): with ``doc_id`` it tells apart rows that repeat a number.

    Rows equal in both are the same document for every operator that joins its decisions back.
    """
    return df.withColumn("_h", F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNull()))
