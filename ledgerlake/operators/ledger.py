"""Ledger posting (K1, K3, K4).

Rule of the balance trigger: a debit (saque, pagamento, transferência, PIX)
is refused when ``saldo - valor < -coalesce(limite_credito, 0)`` for a
'conta especial' and ``< 0`` otherwise; credits (depósito, estorno) always
pass. A refused row leaves no trace, so acceptance of row n depends on the
acceptance of every earlier row of the account (arrival order = ``seq``). A
NULL balance makes each test NULL, which accepts and keeps the balance NULL.

Execution, per batch:

1. Validation joins (unknown account, duplicate number against the stored
   log, NULL fields, type outside the enum) reject rows up front.
2. Fast path, all JVM: a skew-safe prefix sum of signed cents per account
   under "everything accepted". Every row before an account's first
   possible breach is exactly accepted with that running balance.
3. Sorted pass for the remainder only: rows from the first possible breach
   on, hash-partitioned by account and sorted by ``seq``, folded by a
   generator over Arrow batches (``mapInPandas``) that carries one
   (account, balance) state; memory is O(batch), any account length.
   Within one account the fold is sequential by definition of the rule.
4. Large accounts (cut into chunks for the prefix sum) are not folded row by
   row. Every (account, chunk) has a summary: the lowest distance of a debit
   from the floor under "everything accepted". A refused debit only raises
   later balances, by its amount, so the true balances are those of the
   summary plus one offset per account, and a chunk whose lowest distance
   plus the offset is not negative refuses nothing. Rounds replay the first
   ``REPLAY_CHUNKS`` chunks of each account that might, which raises its
   offset, and jump over all others: those rows stay where they are and only
   add their chunk's offset. Accounts where a number repeats in the batch, or
   with negative debits (which can lower the offset), take route 3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.exprs import money
from ledgerlake.operators.prefix import DEFAULT_CHUNK_SPAN, large_keys, prefix_sum
from ledgerlake.schema import CREDIT_KINDS, DEBIT_KINDS, TIPO_TRANSACAO, Bank
from ledgerlake.session import cut_lineage

ACCEPTED = "ACCEPTED"
# Reject reasons, in the order the checks apply.
USER_NOT_FOUND = "USER_NOT_FOUND"
NOT_HOLDER = "NOT_HOLDER"
SAME_ACCOUNT = "SAME_ACCOUNT"
NULL_FIELD = "NULL_FIELD"
INVALID_TYPE = "INVALID_TYPE"
UNKNOWN_ACCOUNT = "UNKNOWN_ACCOUNT"
DUPLICATE_NUMBER = "DUPLICATE_NUMBER"
CREDIT_LIMIT_EXCEEDED = "CREDIT_LIMIT_EXCEEDED"
INSUFFICIENT_FUNDS = "INSUFFICIENT_FUNDS"

SPECIAL = "conta especial"


def _cents(col) -> F.Column:
    return (money(col) * 100).cast("long")


def _from_cents(col) -> F.Column:
    return (F.col(col).cast("decimal(20,0)") / 100).cast("decimal(18,2)").cast("double")


@dataclass
class Posting:
    """Result of a posting run. ``decisions`` has one row per input row."""

    decisions: DataFrame
    replayed: int = 0  # rows of large accounts that were replayed, and in how many rounds
    rounds: int = 0

    @property
    def accepted(self) -> DataFrame:
        return self.decisions.where(F.col("status") == ACCEPTED)

    @property
    def rejected(self) -> DataFrame:
        return self.decisions.where(F.col("status") != ACCEPTED)


def _prepare(accounts: DataFrame, txns: DataFrame, seq: str, existing_log: DataFrame | None) -> DataFrame:
    acc = accounts.select("num_conta", F.col("saldo").alias("_saldo0"), F.col("tipo_conta").alias("_tipo_conta"),
                          F.col("limite_credito").alias("_limite"), F.lit(True).alias("_known"))
    t = txns.join(acc, "num_conta", "left")
    has_number = "num_transacao" in txns.columns
    if existing_log is not None and has_number:
        touched = txns.select("num_conta").distinct()  # the history of other accounts is not shuffled on the number
        used = (existing_log.join(touched, "num_conta", "left_semi").select("num_conta", "num_transacao").distinct()
                .withColumn("_used", F.lit(True)))
        t = t.join(used, ["num_conta", "num_transacao"], "left")
    else:
        t = t.withColumn("_used", F.lit(None).cast("boolean"))
    null_field = F.col("num_conta").isNull() | F.col("tipo").isNull() | F.col("valor").isNull() | F.col(seq).isNull()
    pre = (F.when(null_field, F.lit(NULL_FIELD))
           .when(~F.col("tipo").isin(TIPO_TRANSACAO), F.lit(INVALID_TYPE))
           .when(F.col("_known").isNull(), F.lit(UNKNOWN_ACCOUNT))
           .when(F.col("_used").isNotNull(), F.lit(DUPLICATE_NUMBER)))
    debit = F.col("tipo").isin(DEBIT_KINDS)
    amt = _cents("valor")
    return (t.withColumn("_pre", pre)
            .withColumn("_debit", debit)
            .withColumn("_delta", F.when(debit, -amt).when(F.col("tipo").isin(CREDIT_KINDS), amt).otherwise(F.lit(0)))
            .withColumn("_floor", F.when(F.col("_tipo_conta") == SPECIAL,
                                         -_cents(F.coalesce(F.col("_limite"), F.lit(0.0)))).otherwise(F.lit(0)))
            .withColumn("_s0", _cents("_saldo0")))


_FOLD_OUT = [
    T.StructField("status", T.StringType()),
    T.StructField("_bal_after", T.LongType()),
]


def _fold_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sequential acceptance over rows sorted by (num_conta, seq); state carried across batches.

    Rows arriving with a ``_status`` are already decided (passed through
    vectorised); only rows with a NULL ``_status`` run the per-row rule.
    """
    cur = None
    bal = 0
    bal_null = False
    taken: set = set()
    for pdf in batches:
        n = len(pdf)
        status = pdf["_status"].to_numpy(dtype=object, na_value=None).copy()
        known = pd.notna(pdf["_bal_known"]).to_numpy()
        after = np.where(known, pdf["_bal_known"].fillna(0).to_numpy(dtype=np.float64), 0).astype(np.int64)
        after_null = ~known
        todo = np.flatnonzero(pd.isna(pdf["_status"]).to_numpy())
        if len(todo):
            acct = pdf["num_conta"].to_numpy()
            delta = pdf["_delta"].to_numpy(dtype=np.int64)
            debit = pdf["_debit"].to_numpy(dtype=bool)
            floor = pdf["_floor"].to_numpy(dtype=np.int64)
            start = pdf["_start"].to_numpy(dtype=np.float64)
            special = (pdf["_tipo_conta"] == SPECIAL).to_numpy()
            dup = pdf["_dup"].eq(True).to_numpy(dtype=bool)
            number = pdf["num_transacao"].to_numpy() if "num_transacao" in pdf else np.zeros(n)
            for i in todo:
                if acct[i] != cur:
                    cur = acct[i]
                    bal_null = bool(np.isnan(start[i]))
                    bal = 0 if bal_null else int(start[i])
                    taken = set()
                if dup[i] and number[i] in taken:
                    status[i] = DUPLICATE_NUMBER
                elif bal_null:
                    status[i] = ACCEPTED
                elif debit[i] and bal + delta[i] < floor[i]:
                    status[i] = CREDIT_LIMIT_EXCEEDED if special[i] else INSUFFICIENT_FUNDS
                else:
                    status[i] = ACCEPTED
                    bal += int(delta[i])
                if status[i] == ACCEPTED and dup[i]:
                    taken.add(number[i])
                after[i] = bal
                after_null[i] = bal_null
        out = pdf.drop(columns=["_status", "_bal_known", "_start"])
        out["status"] = status
        out["_bal_after"] = pd.array(after, dtype="Int64")
        out.loc[after_null, "_bal_after"] = pd.NA
        yield out


REPLAY_CHUNKS = 64
_BLOCK = 4096


def _replay_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of chunks that might refuse, sorted by (num_conta, seq): from one refusal to the next, in blocks.

    ``_offset`` is what refusals before the round's first chunk add to the balances of "everything accepted".
    """
    cur, offset = None, 0
    for pdf in batches:
        n = len(pdf)
        acct = pdf["num_conta"].to_numpy()
        before, delta = (pdf[c].to_numpy(dtype=np.int64) for c in ("_bal_before", "_delta"))
        start = pdf["_offset"].to_numpy(dtype=np.int64)
        room = np.where(pdf["_debit"].to_numpy(dtype=bool), before + delta - pdf["_floor"].to_numpy(dtype=np.int64),
                        np.iinfo(np.int64).max // 2)
        after, refused = before + delta, np.zeros(n, dtype=bool)
        borders = np.append(np.flatnonzero(np.append(True, acct[1:] != acct[:-1])), n) if n else [0]
        for lo, hi in zip(borders[:-1], borders[1:]):
            if acct[lo] != cur:
                cur, offset = acct[lo], int(start[lo])
            i = lo
            while i < hi:
                end = min(i + _BLOCK, hi)
                hits = np.flatnonzero(room[i:end] < -offset)
                stop = i + int(hits[0]) if len(hits) else end
                after[i:stop] += offset
                if len(hits):
                    after[stop] = before[stop] + offset
                    refused[stop] = True
                    offset -= int(delta[stop])
                    stop += 1
                i = stop
        reason = np.where((pdf["_tipo_conta"] == SPECIAL).to_numpy(), CREDIT_LIMIT_EXCEEDED, INSUFFICIENT_FUNDS)
        out = pdf.drop(columns=["_bal_before", "_offset"])
        out["status"] = np.where(refused, reason, ACCEPTED)
        out["_bal_after"] = after
        yield out


def _jump(rows: DataFrame, seq: str, replay_chunks: int) -> tuple[DataFrame, int, int]:
    """Decide large accounts (``_chunk`` >= 0) by chunk summaries.

    Returns their rows with status and ``_bal_after``, how many were replayed, and the rounds.
    """
    gap = F.when(F.col("_debit"), F.col("_bal_before") + F.col("_delta") - F.col("_floor"))
    chunks = cut_lineage(rows.groupBy("num_conta", "_chunk").agg(F.min(gap).alias("_low")))
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("_bal_before", "_uncertain")] + _FOLD_OUT)
    spark, replayed, rounds, pieces = rows.sparkSession, 0, 0, []
    kind = rows.schema["num_conta"].dataType.simpleString()
    gains = spark.createDataFrame([], f"num_conta {kind}, _chunk long, _gain long")  # per replayed chunk
    while True:
        so_far = gains.groupBy("num_conta").agg(F.sum("_gain").alias("_offset"), F.max("_chunk").alias("_done"))
        waiting = (chunks.join(so_far, "num_conta", "left").withColumn("_offset", F.coalesce("_offset", F.lit(0)).cast("long"))
                   .where((F.col("_chunk") > F.coalesce("_done", F.lit(-1))) & (F.col("_low") + F.col("_offset") < 0)))
        turn = F.row_number().over(Window.partitionBy("num_conta").orderBy("_chunk"))
        picked = cut_lineage(waiting.withColumn("_turn", turn).where(F.col("_turn") <= replay_chunks)
                             .select("num_conta", "_chunk", "_offset"))
        if picked.isEmpty():
            break
        rounds += 1
        part = rows.drop("_uncertain").join(picked, ["num_conta", "_chunk"])
        piece = cut_lineage(part.repartition("num_conta").sortWithinPartitions("num_conta", seq)
                            .mapInPandas(_replay_partition, schema))
        pieces.append(piece)
        refused = F.when(F.col("status") != ACCEPTED, -F.col("_delta")).otherwise(F.lit(0))
        per = cut_lineage(piece.groupBy("num_conta", "_chunk").agg(F.sum(refused).alias("_gain"), F.count(F.lit(1)).alias("_n")))
        replayed += per.agg(F.sum("_n")).first()[0]
        gains = gains.unionByName(per.drop("_n"))
    earlier = Window.partitionBy("num_conta").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = chunks.select("num_conta", "_chunk").join(gains, ["num_conta", "_chunk"], "left").select(
        "num_conta", "_chunk", F.col("_gain").isNull().alias("_kept"), F.coalesce(F.sum("_gain").over(earlier), F.lit(0)).alias("_shift"))
    out = (rows.join(shifts.where("_kept"), ["num_conta", "_chunk"])
           .withColumn("status", F.lit(ACCEPTED))
           .withColumn("_bal_after", (F.col("_bal_before") + F.col("_delta") + F.col("_shift")).cast("long"))
           .select(*[f.name for f in schema.fields]))
    for piece in pieces:
        out = out.unionByName(piece.select(*out.columns))
    return out, replayed, rounds


def post(accounts: DataFrame, txns: DataFrame, seq: str = "id_transacao",
         existing_log: DataFrame | None = None, chunk_span: int = DEFAULT_CHUNK_SPAN,
         replay_chunks: int = REPLAY_CHUNKS) -> Posting:
    """K1 + K4: post single-leg transactions in arrival order.

    ``accounts``: num_conta, saldo, tipo_conta, limite_credito.
    ``txns``: ``seq`` (arrival order, unique), num_conta, tipo, valor, and
    optionally num_transacao and other columns (passed through).
    Returns one decision per row: the input columns plus ``status``
    (ACCEPTED or the reason) and ``saldo_apos`` (balance after the row;
    unchanged for a row refused by the balance rule; NULL for a row refused
    before it: unknown account, NULL field, invalid type, number already used).

    Rows refused before the balance rule are split off first. Prefix sums
    (cut into chunks for large accounts) give each row the balance under
    "everything accepted", and each account its first row that might be
    refused; that state is written once to the checkpoint folder. Rows
    before that point are decided; only each account's rest is folded. Large
    accounts are decided by chunk summaries; ``Posting.replayed`` counts the
    rows of theirs that had to be replayed.
    """
    in_cols = txns.columns
    # The large accounts are at most ``prefix.MOST_LARGE``; they are counted on the input, before any join.
    hot = [r[0] for r in large_keys(txns.where(F.col("num_conta").isNotNull()), "num_conta", chunk_span).select("_key").collect()]
    t = _prepare(accounts, txns, seq, existing_log)
    live = t.where(F.col("_pre").isNull())
    if "num_transacao" in in_cols:
        # Rows sharing (account, number) inside the batch: the first accepted one
        # takes the number, so their outcome is left to the sorted pass.
        same_number = F.count(F.lit(1)).over(Window.partitionBy("num_conta", "num_transacao"))
        live = live.withColumn("_dup", F.col("num_transacao").isNotNull() & (same_number > 1))
    else:
        live = live.withColumn("_dup", F.lit(False))
    kind = txns.schema["num_conta"].dataType.simpleString()
    large = txns.sparkSession.createDataFrame([(k, True) for k in hot], f"_key {kind}, _large boolean") if hot else None
    live = prefix_sum(live, "num_conta", seq, "_delta", "_before", inclusive=False, chunk_span=chunk_span if hot else None,
                      large=large, chunk="_chunk")
    bal_before = F.col("_s0") + F.col("_before")
    uncertain = F.col("_dup") | (
        F.col("_debit") & F.col("_s0").isNotNull() & (bal_before + F.col("_delta") < F.col("_floor")))
    keep = list(dict.fromkeys(in_cols + ["_delta", "_debit", "_floor", "_tipo_conta", "_dup"]))
    refused = t.where(F.col("_pre").isNotNull()).select(
        *in_cols, F.col("_pre").alias("status"), F.lit(None).cast("long").alias("_bal_after"))
    state = cut_lineage(live.select(*keep, "_chunk", bal_before.alias("_bal_before"), uncertain.alias("_uncertain")))
    jumped, replayed, rounds = None, 0, 0
    if hot:
        odd = F.max(F.col("_dup") | (F.col("_debit") & (F.col("_delta") > 0)))
        ruled = state.where("_chunk >= 0").groupBy("num_conta").agg(odd.alias("_odd")).where("not _odd").select("num_conta")
        ruled = cut_lineage(ruled)  # at most MOST_LARGE accounts
        jumped, replayed, rounds = _jump(state.join(F.broadcast(ruled), "num_conta", "left_semi"), seq, replay_chunks)
        state = state.join(F.broadcast(ruled), "num_conta", "left_anti")
    state = state.drop("_chunk")
    # First uncertain row per account and the exact balance before it (partial aggregate, joined back).
    first = (state.where("_uncertain").groupBy("num_conta")
             .agg(F.min(seq).alias("_first"), F.min_by("_bal_before", F.col(seq)).alias("_start")))
    state = state.join(first, "num_conta", "left")
    sure = F.col("_first").isNull() | (F.col(seq) < F.col("_first"))
    fast = state.where(sure).select(*in_cols, F.lit(ACCEPTED).alias("status"),
                                    (F.col("_bal_before") + F.col("_delta")).cast("long").alias("_bal_after"))
    rest = state.where(~sure).select(*keep, F.col("_start").cast("double").alias("_start"),
                                     F.lit(None).cast("string").alias("_status"), F.lit(None).cast("double").alias("_bal_known"))
    fold_schema = T.StructType([f for f in rest.schema.fields if f.name not in ("_start", "_status", "_bal_known")] + _FOLD_OUT)
    folded = (rest.repartition("num_conta").sortWithinPartitions("num_conta", seq)
              .mapInPandas(_fold_partition, fold_schema).select(*in_cols, "status", "_bal_after"))
    done = folded.unionByName(fast).unionByName(refused)
    if jumped is not None:
        done = done.unionByName(jumped.select(*in_cols, "status", "_bal_after"))
    return Posting(done.select(*in_cols, "status", _from_cents_expr(F.col("_bal_after")).alias("saldo_apos")), replayed, rounds)


def _from_cents_expr(c: F.Column) -> F.Column:
    return (c.cast("decimal(20,0)") / 100).cast("decimal(18,2)").cast("double")


def balances_after(accounts: DataFrame, posting: Posting) -> DataFrame:
    """New account snapshot: stored balance plus the signed sum of accepted rows (exact decimals)."""
    acc = posting.accepted
    delta = (acc.groupBy("num_conta")
             .agg(F.sum(F.when(F.col("tipo").isin(DEBIT_KINDS), -money("valor"))
                        .when(F.col("tipo").isin(CREDIT_KINDS), money("valor"))
                        .otherwise(F.lit(0).cast("decimal(18,2)"))).alias("_d")))
    return (accounts.join(delta, "num_conta", "left")
            .withColumn("saldo", (money("saldo") + F.coalesce("_d", F.lit(0).cast("decimal(18,2)"))).cast("double"))
            .drop("_d"))


def running_balance(b: Bank, chunk_span: int | None = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """K3: running balance of the accepted log per account, in arrival order (signed, from zero)."""
    t = b.transacao.select("id_transacao", "num_conta", "tipo", "valor")
    signed = (F.when(F.col("tipo").isin(DEBIT_KINDS), -_cents("valor"))
              .when(F.col("tipo").isin(CREDIT_KINDS), _cents("valor")).otherwise(F.lit(0).cast("long")))
    r = prefix_sum(t, "num_conta", "id_transacao", signed, "_run", inclusive=True, chunk_span=chunk_span)
    return r.select("id_transacao", "num_conta", _from_cents("_run").alias("saldo_corrente"))
