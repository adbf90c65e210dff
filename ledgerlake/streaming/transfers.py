"""L3: continuous transfers.

A transfer touches two accounts atomically, so per-key state cannot decide
it. Each micro-batch instead runs the batch operator (N2 authorization, then
the K2 fixpoint) against the balances left by the batches before it (see
``versions``) and writes ``decisions/batch=<batch_id>`` and the accounts it
changed, with overwrite, so a replayed batch rewrites the same files.
Requests must arrive in ``seq`` order across batches. Numbers that requests
bring along are refused if the stored log or an accepted leg of an earlier
batch has taken them (see ``registry``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import transfers as K2
from ledgerlake.schema import Bank
from ledgerlake.streaming.posting import stream_folders
from ledgerlake.streaming.registry import numbers_before, write_numbers
from ledgerlake.streaming.versions import ACCOUNT_COLS, balances_before, write_balances

NUMBER_COLS = ["num_transacao", "num_trans_origem", "num_trans_destino"]  # optional
REQUEST_COLS = ["seq", "kind", "num_conta", "tipo", "valor", "solicitante", "conta_origem", "conta_destino"]


def post_transfers_stream(b: Bank, requests: DataFrame, mode: str = "as_written", name: str = "transfers",
                          folder: str | None = None, log: DataFrame | None = None) -> str:
    """Run the request stream (columns ``REQUEST_COLS``, and ``NUMBER_COLS`` if it has them) to completion; returns the output folder.

    ``log`` (num_conta, num_transacao) holds the numbers taken before the stream.

    ``<out>/decisions`` holds one row per request (seq, kind, status, batch);
    the balances are kept as ``versions`` describes. The same ``folder``
    resumes a stopped stream.
    """
    spark = requests.sparkSession
    out, ckpt = stream_folders(spark, f"{name}-out", folder)
    initial = b.conta.select(*ACCOUNT_COLS)
    numbered = [c for c in NUMBER_COLS if c in requests.columns]

    def run_batch(df: DataFrame, batch_id: int) -> None:
        accounts = balances_before(initial, out, batch_id)
        snap = b.with_tables(conta=b.conta.drop("saldo").join(accounts.select("num_conta", "saldo"), "num_conta"))
        number = lambda c: (F.col(c) if c in numbered else F.lit(None)).cast("int").alias(c)
        singles = df.where(F.col("kind") == "single").select("seq", "num_conta", "tipo", "valor", number("num_transacao"))
        transfers = (df.where(F.col("kind") == "transfer")
                     .select("seq", "solicitante", "conta_origem", "conta_destino", "valor",
                             number("num_trans_origem"), number("num_trans_destino")))
        from ledgerlake.operators.access import authorize

        auth = authorize(snap, transfers)
        ok = auth.where(F.col("reason").isNull()).drop("reason")
        legs = K2.build_legs(singles, ok, mode)
        taken = log
        if numbered and (earlier := numbers_before(legs, out, batch_id)) is not None:
            taken = earlier if log is None else log.select("num_conta", "num_transacao").unionByName(earlier)
        done, _ = K2.post_transfers(snap.conta, legs, taken if numbered else None)
        dec = K2.decisions(done).unionByName(
            auth.where(F.col("reason").isNotNull()).select(
                F.col("seq").cast("long").alias("seq"), F.lit("transfer").alias("kind"),
                F.col("reason").alias("status")))
        dec.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/decisions/batch={batch_id}")
        write_balances(accounts, K2.balances(accounts, done), out, batch_id)
        if numbered:
            write_numbers(K2.accepted_legs(done).select("num_conta", F.col("num").alias("num_transacao")), out, batch_id)

    q = (requests.select(*REQUEST_COLS, *numbered).writeStream.option("checkpointLocation", ckpt)
         .trigger(availableNow=True).foreachBatch(run_batch).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return out
