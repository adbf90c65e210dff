"""L2, safe against records delivered again: payroll per branch from a change stream that may repeat records.

State store v2 holds, per branch and span of ``SPAN`` sequence numbers, the sum of its deltas and a bit per delta seen.
A delta whose bit is set is not added again, in whatever batch it returns. The state is bounded by the spans that the
sequence covers (at most ``2 * SPAN / 8`` bytes each), not by a set of all numbers. A branch with a third of all changes
is split by its spans, so no task holds a whole branch. Every micro-batch writes the sums of the spans it changed to
``sums/batch=<n>``, overwriting on replay; ``payroll_totals`` adds up the latest sum of each span.

A change to the same branch has two deltas with a bit each. Records without a sequence number cannot be recognised and
count every time; deltas without a branch or salary count nothing. An empty stream gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ledgerlake.functions.exprs import money
from ledgerlake.streaming.posting import stream_folders
from ledgerlake.streaming.stateful import rocksdb

SPAN = 2048
SUMS = "num_ag int, span long, cents long"


class SpanProcessor(StatefulProcessor):
    """Sum and seen bits of one span of a branch."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("span", "cents long, seen binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        cents, bits = 0, 0
        if self.state.exists():
            cents, stored = self.state.get()
            bits = int.from_bytes(stored, "little")
        for pdf in rows:
            for bit, delta in zip(pdf["bit"].tolist(), pdf["delta"].tolist()):
                if bit >= 0:
                    if bits >> bit & 1:
                        continue
                    bits |= 1 << bit
                cents += delta
        self.state.update((cents, bits.to_bytes((bits.bit_length() + 7) // 8, "little")))
        yield pd.DataFrame({"num_ag": [key[0]], "span": [key[1]], "cents": [cents]})

    def close(self) -> None:
        pass


def payroll_spans(cdc_stream: DataFrame, seq: str = "seq") -> DataFrame:
    """Running sums per branch and span (Update mode) of change rows: seq, op I/U/D, old/new branch and salary."""
    cents = lambda c: (money(c) * 100).cast("long")
    minus = F.struct(F.col("old_num_ag").alias("num_ag"), (-cents("old_salario")).alias("delta"), F.lit(0).alias("part"))
    plus = F.struct(F.col("new_num_ag").alias("num_ag"), cents("new_salario").alias("delta"), F.lit(1).alias("part"))
    parts = F.when(F.col("op") == "I", F.array(plus)).when(F.col("op") == "D", F.array(minus)).when(F.col("op") == "U", F.array(minus, plus))
    s = F.col(seq).cast("long")
    rows = (cdc_stream.select(s.alias("s"), F.explode(parts).alias("d")).where("d.num_ag is not null and d.delta is not null")
            .select(F.col("d.num_ag").alias("num_ag"), F.coalesce(F.floor(F.col("s") / SPAN).cast("long"), F.lit(-1).cast("long")).alias("span"),
                    F.coalesce(F.pmod("s", F.lit(SPAN)) * 2 + F.col("d.part"), F.lit(-1)).cast("long").alias("bit"),
                    F.col("d.delta").alias("delta")))
    return rows.groupBy("num_ag", "span").transformWithStateInPandas(SpanProcessor(), SUMS, "Update", "None")


def run_payroll(cdc_stream: DataFrame, folder: str | None = None, seq: str = "seq") -> str:
    """Run the stream over everything available now and return its output folder; the same ``folder`` resumes it."""
    spark = cdc_stream.sparkSession
    out, ckpt = stream_folders(spark, "payroll-out", folder)

    def run_batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/sums/batch={batch_id}")

    with rocksdb(spark):
        q = (payroll_spans(cdc_stream, seq).writeStream.option("checkpointLocation", ckpt).outputMode("update")
             .trigger(availableNow=True).foreachBatch(run_batch).start())
        q.awaitTermination()
    if q.exception():
        raise q.exception()
    return out


def payroll_totals(spark: SparkSession, out: str) -> DataFrame:
    """num_ag, sal_total after the batches written so far."""
    schema = T.StructType.fromDDL(SUMS + ", batch int")
    sums = spark.read.schema(schema).parquet(f"{out}/sums")
    last = sums.groupBy("num_ag", "span").agg(F.max_by("cents", "batch").alias("cents"))
    return last.groupBy("num_ag").agg((F.sum(F.col("cents").cast("decimal(38,0)")) / 100).cast("double").alias("sal_total"))
