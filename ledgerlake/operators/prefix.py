"""Prefix sums per key that stay parallel when one key holds most rows.

A plain ``sum().over(partitionBy(key).orderBy(seq))`` puts every row of a
key in one task. ``prefix_sum`` counts the rows per key (a partial aggregate
over one column) and cuts the keys that hold many into chunks of a fixed
``seq`` span; all other keys are one chunk. Rows are shuffled once, on
(key, chunk), and summed there; chunks of large keys then add the sum of
their earlier chunks. At most ``MOST_LARGE`` keys are large, since such a key
holds at least that share of all rows, so their list is safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_SPAN = 1 << 16
MOST_LARGE = 10_000


def large_keys(df: DataFrame, key: str, chunk_span: int) -> DataFrame:
    """_key, _large of the keys with more than ``chunk_span`` rows and more than 1 / ``MOST_LARGE`` of all (so at most that many)."""
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.agg((F.sum("_n") / MOST_LARGE).alias("_share"))
    return (counts.where(F.col("_n") > chunk_span).where(F.col("_n") > F.coalesce(share.scalar(), F.lit(0)))
            .select("_key", F.lit(True).alias("_large")))


def prefix_sum(df: DataFrame, key: str, seq: str, value: str | Column, out: str,
               inclusive: bool = True, chunk_span: int | None = DEFAULT_CHUNK_SPAN, large: DataFrame | None = None,
               chunk: str | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over earlier rows of the same ``key`` (ordered by ``seq``).

    ``inclusive`` counts the current row. ``seq`` must be unique within a key
    and integral when ``chunk_span`` is set; a large key has more than
    ``chunk_span`` rows and more than 1 / ``MOST_LARGE`` of all. ``large``
    gives the large keys, if they are known (see ``large_keys``); ``chunk``
    names a column to keep with a row's chunk (-1 for keys in one piece).
    """
    val = F.col(value) if isinstance(value, str) else value
    end = Window.currentRow if inclusive else -1
    if not chunk_span:
        w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, end)
        d = df.withColumn(out, F.coalesce(F.sum(val).over(w), F.lit(0)))
        return d.withColumn(chunk, F.lit(-1).cast("long")) if chunk else d
    large = large_keys(df, key, chunk_span) if large is None else large
    d = (df.withColumn("_v", val).join(F.broadcast(large), F.col(key) == F.col("_key"), "left").drop("_key")
         .withColumn("_chunk", F.when(F.col("_large"), F.floor(F.col(seq) / F.lit(chunk_span)).cast("long"))
                     .otherwise(F.lit(-1).cast("long"))))
    totals = d.where("_large").groupBy(key, "_chunk").agg(F.sum("_v").alias("_ctot"))
    wc = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_chunk", F.coalesce(F.sum("_ctot").over(wc), F.lit(0)).alias("_off"))
    wr = Window.partitionBy(key, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, end)
    d = d.join(offsets, [key, "_chunk"], "left").withColumn(
        out, F.coalesce(F.col("_off"), F.lit(0)) + F.coalesce(F.sum("_v").over(wr), F.lit(0)))
    return (d.withColumnRenamed("_chunk", chunk) if chunk else d.drop("_chunk")).drop("_v", "_off", "_large")
