"""Transaction numbers that a stream has taken, between its micro-batches.

The registry is a set of (num_conta, num_transacao) in segments, each partitioned by a hash bucket of the account. Batch n
writes the numbers that it accepts as segment (0, n); whenever ``FAN`` segments of a level are full, they are merged into
one of the next level. So before batch n the set is given by the digits of n in base ``FAN``: at most FAN - 1 segments
per level and as many levels as n has digits, all found from n alone. A batch reads only the buckets of its own accounts
in those segments; a number is rewritten once per level. All writes overwrite, so a replayed batch rewrites the same
folders. Segments below a merged one are no longer read and may be expired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 16
BUCKETS = 64
_SCHEMA = "num_conta int, num_transacao int, level int, segment long, bucket int"


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64(F.col("num_conta").cast("int")), F.lit(BUCKETS)).cast("int")


def segments(batch: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, segment) that together hold batches 0 to ``batch`` - 1, newest last."""
    found, level, n = [], 0, batch
    while n:
        found += [(level, n - 1 - i) for i in range(n % fan)]
        level, n = level + 1, n // fan
    return found[::-1]


def _read(spark: SparkSession, out: str, which: list[tuple[int, int]]) -> DataFrame:
    paths = [f"{out}/numbers/level={level}/segment={k}" for level, k in which]
    return spark.read.schema(_SCHEMA).option("basePath", f"{out}/numbers").parquet(*paths)


def numbers_before(rows: DataFrame, out: str, batch: int, fan: int = FAN) -> DataFrame | None:
    """num_conta, num_transacao taken before ``batch`` in the buckets of the accounts of ``rows``; None if there are none."""
    which = segments(batch, fan)
    if not which:
        return None
    wanted = [r[0] for r in rows.where("num_conta is not null").select(_bucket().alias("b")).distinct().collect()]  # at most BUCKETS
    return _read(rows.sparkSession, out, which).where(F.col("bucket").isin(wanted)).select("num_conta", "num_transacao")


def write_numbers(taken: DataFrame, out: str, batch: int, fan: int = FAN) -> None:
    """Write the numbers (num_conta, num_transacao) that ``batch`` took, and the merges that are due after it."""
    spark = taken.sparkSession

    def put(df: DataFrame, level: int, k: int) -> None:
        (df.select(F.col("num_conta").cast("int"), F.col("num_transacao").cast("int"), _bucket().alias("bucket"))
         .repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/numbers/level={level}/segment={k}"))

    put(taken.where("num_transacao is not null"), 0, batch)
    level, n = 0, batch + 1
    while n % fan == 0:
        n //= fan
        put(_read(spark, out, [(level, n * fan - 1 - i) for i in range(fan)]), level + 1, n - 1)
        level += 1
