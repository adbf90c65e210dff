"""L1 on state store v2: one processor per group of neighbouring accounts with their balances and taken numbers.

``transformWithStateInPandas`` starts from the accounts as initial state (and, if given, the numbers of a stored log), so
the stream is joined with nothing. The state of a group (256 account numbers) is a value (balance, floor and kind of each
account) and a map of taken numbers, one entry each in RocksDB: a batch loads only the entries that its rows ask for,
however many numbers an account has used. A call of Python and of the state store costs far more than a row, so accounts
share them, numbers taken by the rows of a call are looked up in memory, and accounts without stored numbers not at all.
Outcomes never change once emitted (Append); there is no event time and no timer. ``seq`` must rise from one micro-batch
to the next; within one, an account's rows are put in order.

A number is refused (DUPLICATE_NUMBER) if the log or an accepted row of this stream has it. Rows refused before the
balance rule have no balance; a number taken within the stream leaves the balance as it is, as in the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ledgerlake.functions.exprs import money
from ledgerlake.operators.ledger import (ACCEPTED, CREDIT_LIMIT_EXCEEDED, DUPLICATE_NUMBER, INSUFFICIENT_FUNDS, INVALID_TYPE,
                                         NULL_FIELD, SPECIAL, UNKNOWN_ACCOUNT)
from ledgerlake.schema import CREDIT_KINDS, DEBIT_KINDS, TIPO_TRANSACAO
from ledgerlake.session import STATEFUL_STREAMING
from ledgerlake.streaming.posting import POST_OUT, account_group

STATE = "num_conta array<int>, bal array<long>, floor array<long>, special array<boolean>, numbered array<boolean>"
FROM_LOG = -1


class AccountProcessor(StatefulProcessor):
    """Balances and numbers of a group of accounts; an account that the initial state does not name is unknown."""

    def init(self, handle) -> None:
        self.accounts = handle.getValueState("accounts", STATE)
        self.numbers = handle.getMapState("numbers", "num_conta int, num long", "seq long")

    def _held(self) -> dict[int, list]:
        """Account: balance, floor, special, whether it has taken a number."""
        if not self.accounts.exists():
            return {}
        nums, *cols = self.accounts.get()
        return {n: list(v) for n, *v in zip(nums, *cols)}

    def _keep(self, held: dict[int, list]) -> None:
        if held:
            self.accounts.update((list(held), *map(list, zip(*held.values()))))

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        held = self._held()
        for account, num, bal, floor, special in zip(*(initial[c].tolist() for c in ("num_conta", "num", "start", "floor", "special"))):
            if pd.isna(account):
                continue
            account = int(account)
            numbered = account in held and held[account][3]
            if not pd.isna(num):
                self.numbers.updateValue((account, int(num)), (FROM_LOG,))
                held[account] = [*(held[account][:3] if account in held else (None, None, None)), True]
            else:
                held[account] = [None if pd.isna(bal) else int(bal), int(floor), bool(special), numbered]
        self._keep(held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frames = [p for p in rows if len(p)]  # groups of the initial state without rows come with empty frames
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True).sort_values("seq", kind="stable")
        held = self._held()
        before = {a for a, v in held.items() if v[3]}  # accounts with numbers in the state: only these are looked up
        taken: set[tuple[int, int]] = set()            # numbers that rows of this call have taken
        status, after = [], []
        for account, pre, delta, debit, num in zip(*(pdf[c].tolist() for c in ("num_conta", "pre", "delta", "debit", "num"))):
            # An account that only the log names has no floor.
            at = held.get(account)
            known = at is not None and at[1] is not None
            why = pre if isinstance(pre, str) else None if known else UNKNOWN_ACCOUNT
            number = None if pd.isna(num) or not known else (int(account), int(num))
            judged = why is None
            if judged and number and (number in taken or account in before and self.numbers.containsKey(number)):
                why = DUPLICATE_NUMBER
                judged = number in taken or self.numbers.getValue(number)[0] != FROM_LOG
            elif judged:
                bal, floor, special, _ = at
                if bal is not None and debit and bal + delta < floor:
                    why = CREDIT_LIMIT_EXCEEDED if special else INSUFFICIENT_FUNDS
                else:
                    at[0] = None if bal is None else bal + int(delta)
                    if number:
                        taken.add(number)
                        at[3] = True
            status.append(why or ACCEPTED)
            after.append(at[0] / 100.0 if judged and at[0] is not None else None)
        for number in taken:
            self.numbers.updateValue(number, (0,))
        self._keep(held)
        yield pd.DataFrame({"seq": pdf["seq"].tolist(), "num_conta": pdf["num_conta"].tolist(), "tipo": pdf["tipo"].tolist(),
                            "valor": pdf["valor"].tolist(), "status": status, "saldo_apos": after})

    def close(self) -> None:
        pass


def _cents(c) -> F.Column:
    return (money(c) * 100).cast("long")


def initial_state(accounts: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """One row per account, and one per number that ``log`` has taken."""
    special = F.coalesce(F.col("tipo_conta") == SPECIAL, F.lit(False))
    rows = accounts.select(
        "num_conta", F.lit(None).cast("long").alias("num"), _cents("saldo").alias("start"),
        F.when(special, -_cents(F.coalesce(F.col("limite_credito"), F.lit(0.0)))).otherwise(F.lit(0)).cast("long").alias("floor"),
        special.alias("special"))
    if log is not None:
        rows = rows.unionByName(log.where("num_transacao is not null").select(
            "num_conta", F.col("num_transacao").cast("long").alias("num"), F.lit(None).cast("long").alias("start"),
            F.lit(0).cast("long").alias("floor"), F.lit(False).alias("special")).distinct())
    return rows


def post_stream_state(txn_stream: DataFrame, accounts: DataFrame, seq: str = "seq", log: DataFrame | None = None) -> DataFrame:
    """Streaming K1 with K4's numbers. ``txn_stream``: seq, num_conta, tipo, valor and optionally num_transacao.

    Start it with the RocksDB state store (``rocksdb``); Append mode.
    """
    # Column names without a leading underscore: the processor's frames may pass through named tuples.
    amt, debit = _cents("valor"), F.col("tipo").isin(DEBIT_KINDS)
    number = F.col("num_transacao").cast("long") if "num_transacao" in txn_stream.columns else F.lit(None).cast("long")
    s = txn_stream.select(
        F.col(seq).cast("long").alias("seq"), "num_conta", "tipo", "valor", number.alias("num"),
        F.when(F.col("num_conta").isNull() | F.col("tipo").isNull() | F.col("valor").isNull() | F.col(seq).isNull(), F.lit(NULL_FIELD))
        .when(~F.col("tipo").isin(TIPO_TRANSACAO), F.lit(INVALID_TYPE)).alias("pre"),
        debit.alias("debit"),
        F.when(debit, -amt).when(F.col("tipo").isin(CREDIT_KINDS), amt).otherwise(F.lit(0)).alias("delta"))
    group = account_group()
    return s.withColumn("grp", group).groupBy("grp").transformWithStateInPandas(
        AccountProcessor(), POST_OUT, "Append", "None",
        initialState=initial_state(accounts, log).withColumn("grp", group).groupBy("grp"))


@contextmanager
def rocksdb(spark: SparkSession):
    """The RocksDB state store for queries started in this block; the session's own setting comes back after it."""
    old = {k: spark.conf.get(k, None) for k in STATEFUL_STREAMING}
    for k, v in STATEFUL_STREAMING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
