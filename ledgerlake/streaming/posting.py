"""L1 and L2: continuous posting and continuous branch payroll (Structured Streaming).

L1 keeps the running balance of every account in the state store, one state
per group of 256 neighbouring account numbers, and decides each arriving
transaction as K1 does; outcomes never change once
emitted, so the output mode is Append. There is no event time and no
watermark: arrival order (``seq``) is the posting order, and ``seq`` must
rise from one micro-batch to the next.

L2 turns each employee change (insert / update / delete) into signed
salary deltas for the branches involved and keeps a streaming sum per
branch; the result equals the batch recomputation (D6) of the final table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ledgerlake.functions.exprs import money
from ledgerlake.operators.ledger import (ACCEPTED, CREDIT_LIMIT_EXCEEDED, INSUFFICIENT_FUNDS, INVALID_TYPE,
                                         NULL_FIELD, SPECIAL, UNKNOWN_ACCOUNT)
from ledgerlake.schema import CREDIT_KINDS, DEBIT_KINDS, TIPO_TRANSACAO
from ledgerlake.session import checkpoint_dir

POST_OUT = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("num_conta", T.IntegerType()),
    T.StructField("tipo", T.StringType()),
    T.StructField("valor", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("saldo_apos", T.DoubleType()),
])
# Balances of a group's accounts that have had rows; null: no balance is kept.
POST_STATE = T.StructType([
    T.StructField("num_conta", T.ArrayType(T.IntegerType())),
    T.StructField("bal", T.ArrayType(T.LongType())),
])
# Accounts whose numbers differ in the last 8 bits only share one state and one Python call, which costs far more than a row.
GROUP_BITS = 8


def _cents(c) -> F.Column:
    return (money(c) * 100).cast("long")


def account_group() -> F.Column:
    """The group of neighbouring account numbers that ``num_conta`` belongs to; fixed, so that a stream can be resumed."""
    return F.shiftright("num_conta", GROUP_BITS)


def _post_group(key, pdfs: Iterator[pd.DataFrame], state):
    frames = list(pdfs)
    pdf = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    if len(pdf) > 1:
        pdf = pdf.sort_values("seq", kind="stable")
    balances = dict(zip(*state.get)) if state.exists else {}
    terms: dict[int, tuple] = {}
    status = []
    after = []
    for num, pre, delta, debit, known, s0, floor, tipo_conta in zip(*(pdf[c].tolist() for c in (
            "num_conta", "_pre", "_delta", "_debit", "_known", "_s0", "_floor", "_tipo_conta"))):
        if known is True and num not in balances:
            balances[num] = None if pd.isna(s0) else int(s0)
        if isinstance(pre, str):
            status.append(pre)
            after.append(None)
            continue
        if num not in terms:
            terms[num] = (0 if pd.isna(floor) else int(floor),
                          CREDIT_LIMIT_EXCEEDED if tipo_conta == SPECIAL else INSUFFICIENT_FUNDS)
        least, refuse = terms[num]
        bal = balances[num]
        if bal is None:
            status.append(ACCEPTED)
        elif debit and bal + delta < least:
            status.append(refuse)
        else:
            status.append(ACCEPTED)
            bal = balances[num] = bal + int(delta)
        after.append(None if bal is None else bal / 100.0)
    if balances:
        state.update(([int(n) for n in balances], list(balances.values())))
    yield pd.DataFrame({"seq": pdf["seq"].tolist(), "num_conta": pdf["num_conta"].tolist(), "tipo": pdf["tipo"].tolist(),
                        "valor": pdf["valor"].tolist(), "status": status, "saldo_apos": after})


def post_stream(txn_stream: DataFrame, accounts: DataFrame, seq: str = "seq") -> DataFrame:
    """L1: streaming K1. ``txn_stream``: seq, num_conta, tipo, valor. Append-mode outcomes."""
    acc = accounts.select("num_conta", _cents("saldo").alias("_s0"), F.col("tipo_conta").alias("_tipo_conta"),
                          F.when(F.col("tipo_conta") == SPECIAL,
                                 -_cents(F.coalesce(F.col("limite_credito"), F.lit(0.0))))
                          .otherwise(F.lit(0)).cast("long").alias("_floor"),
                          F.lit(True).alias("_known"))
    debit = F.col("tipo").isin(DEBIT_KINDS)
    amt = _cents("valor")
    s = (txn_stream.select(F.col(seq).cast("long").alias("seq"), "num_conta", "tipo", "valor")
         .join(acc, "num_conta", "left")
         .withColumn("_pre", F.when(F.col("num_conta").isNull() | F.col("tipo").isNull() | F.col("valor").isNull(),
                                    F.lit(NULL_FIELD))
                     .when(~F.col("tipo").isin(TIPO_TRANSACAO), F.lit(INVALID_TYPE))
                     .when(F.col("_known").isNull(), F.lit(UNKNOWN_ACCOUNT)))
         .withColumn("_debit", debit)
         .withColumn("_delta", F.when(debit, -amt).when(F.col("tipo").isin(CREDIT_KINDS), amt).otherwise(F.lit(0))))
    return s.withColumn("_group", account_group()).groupBy("_group").applyInPandasWithState(
        _post_group, POST_OUT, POST_STATE, "Append", GroupStateTimeout.NoTimeout)


def payroll_deltas(cdc: DataFrame) -> DataFrame:
    """Change rows (op I/U/D, old/new branch and salary) as signed deltas per branch (one or two rows)."""
    minus_old = F.struct(F.col("old_num_ag").alias("num_ag"), (-money("old_salario")).alias("delta"))
    plus_new = F.struct(F.col("new_num_ag").alias("num_ag"), money("new_salario").alias("delta"))
    parts = (F.when(F.col("op") == "I", F.array(plus_new))
             .when(F.col("op") == "D", F.array(minus_old))
             .when(F.col("op") == "U", F.array(minus_old, plus_new)))
    return cdc.select(F.explode(parts).alias("d")).select("d.num_ag", "d.delta")


def payroll_stream(cdc_stream: DataFrame) -> DataFrame:
    """L2: running payroll per branch from an employee change stream (Update/Complete mode)."""
    return (payroll_deltas(cdc_stream).groupBy("num_ag")
            .agg(F.sum("delta").alias("_s"))
            .select("num_ag", F.col("_s").cast("double").alias("sal_total")))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for a sink or a staged source."""
    return f"{checkpoint_dir(spark).rstrip('/')}/ledgerlake-{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str, mode: str = "append", fmt: str = "parquet",
                 folder: str | None = None) -> DataFrame:
    """Run a streaming query over everything available now; return the written table as a DataFrame.

    Append queries write to a file sink; Update/Complete aggregates are
    written per micro-batch with ``foreachBatch`` (overwrite, idempotent on
    replay). The same ``folder`` resumes a stopped stream.
    """
    spark = stream.sparkSession
    out, ckpt = stream_folders(spark, name, folder)
    w = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format(fmt).option("path", out).start()
    else:
        def write_batch(df: DataFrame, batch_id: int) -> None:
            df.write.mode("overwrite").format(fmt).save(out)

        q = w.outputMode(mode).foreachBatch(write_batch).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.format(fmt).load(out)


def stream_folders(spark: SparkSession, name: str, folder: str | None) -> tuple[str, str]:
    """Output and checkpoint folders: below ``folder``, so that a stopped stream resumes, or fresh ones."""
    root = folder.rstrip("/") if folder else scratch_path(spark, name)
    return f"{root}/out", f"{root}/checkpoint"


def post_stream_versioned(txn_stream: DataFrame, accounts: DataFrame, seq: str = "seq", name: str = "post",
                          folder: str | None = None) -> str:
    """L1, batch-vectorised form: each micro-batch runs K1 against the balances left by the ones before it.

    Micro-batch n writes ``decisions/batch=<n>`` once, reads it back for the
    new balances (see ``versions``) and refuses transaction numbers (column
    ``num_transacao``, if the stream has it) that an earlier batch has
    accepted (see ``registry``: a batch reads the buckets of its accounts). Give ``folder`` to be able to stop and resume: the same folder
    continues after the last finished batch, and a replayed batch rewrites
    the same files. Per-key state is avoided: a per-group Python call per
    account costs far more than one vectorised pass over the batch. Returns
    the output folder.
    """
    from ledgerlake.operators.ledger import Posting, balances_after, post
    from ledgerlake.streaming.registry import numbers_before, write_numbers
    from ledgerlake.streaming.versions import ACCOUNT_COLS, balances_before, write_balances

    spark = txn_stream.sparkSession
    out, ckpt = stream_folders(spark, f"{name}-out", folder)
    initial = accounts.select(*ACCOUNT_COLS)
    numbered = "num_transacao" in txn_stream.columns
    cols = [seq, "num_conta", "tipo", "valor"] + ["num_transacao"] * numbered

    def run_batch(df: DataFrame, batch_id: int) -> None:
        acc = balances_before(initial, out, batch_id)
        log = numbers_before(df, out, batch_id) if numbered else None
        decided = post(acc, df.select(*cols), seq=seq, existing_log=log).decisions
        at = f"{out}/decisions/batch={batch_id}"
        decided.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(at)
        done = Posting(spark.read.parquet(at))
        write_balances(acc, balances_after(acc, done), out, batch_id)
        if numbered:
            write_numbers(done.accepted.select("num_conta", "num_transacao"), out, batch_id)

    q = (txn_stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
         .foreachBatch(run_batch).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return out
