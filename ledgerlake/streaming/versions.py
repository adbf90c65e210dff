"""Balances of a stream between its micro-batches.

Batch n writes the accounts it changed to ``changes/batch=<n>``; every ``SNAPSHOT_EVERY`` batches the whole snapshot is
written to ``balances/v=<n>``. The balances before a batch are the last snapshot with the latest later change of each
account. All writes overwrite, so a batch that is replayed after a restart rewrites the same folders. Files older than
the last snapshot are no longer read and may be expired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SNAPSHOT_EVERY = 16
ACCOUNT_COLS = ["num_conta", "saldo", "tipo_conta", "limite_credito"]


def balances_before(initial: DataFrame, out: str, batch: int) -> DataFrame:
    spark = initial.sparkSession
    first = batch // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    base = spark.read.parquet(f"{out}/balances/v={first - 1}") if first else initial.select(*ACCOUNT_COLS)
    if batch == first:
        return base
    later = spark.read.option("basePath", f"{out}/changes").parquet(*[f"{out}/changes/batch={i}" for i in range(first, batch)])
    last = later.groupBy(F.col("num_conta").alias("_n")).agg(F.max_by("saldo", "batch").alias("_saldo"), F.lit(True).alias("_set"))
    return (base.join(last, F.col("num_conta") == F.col("_n"), "left")
            .withColumn("saldo", F.when(F.col("_set"), F.col("_saldo")).otherwise(F.col("saldo"))).select(*ACCOUNT_COLS))


def write_balances(before: DataFrame, after: DataFrame, out: str, batch: int) -> None:
    """Write the accounts whose balance ``after`` differs, and a snapshot when one is due."""
    old = before.select(F.col("num_conta").alias("_n"), F.col("saldo").alias("_old"))
    (after.join(old, F.col("num_conta") == F.col("_n")).where(~F.col("saldo").eqNullSafe(F.col("_old")))
     .select("num_conta", "saldo").write.mode("overwrite").parquet(f"{out}/changes/batch={batch}"))
    if (batch + 1) % SNAPSHOT_EVERY == 0:
        after.select(*ACCOUNT_COLS).write.mode("overwrite").parquet(f"{out}/balances/v={batch}")
