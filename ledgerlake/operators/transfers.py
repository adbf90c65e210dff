"""K2: transfers (both legs or none) mixed with single-leg transactions.

Each request becomes legs: a single transaction is one leg; a transfer is an
origin leg (debit) and a destination leg, debited as the stored procedure
writes it (``mode='as_written'``: both legs are 'transferência', which the
balance rule debits) or credited (``mode='double_entry'``).

Fixpoint over rounds: every leg starts as passing. A round (1) tells each
leg whether the other legs of its request passed in the previous round (a
window over ``seq``), then (2) folds each account's legs in arrival order
(hash-partitioned by account, sorted, ``mapInPandas``): a leg's own test uses
the balance of the legs applied before it in this pass, and a leg is applied
only if its own test passes and its partners passed. Within an account the
pass is sequential; across accounts it is a Jacobi step. A decision depends
only on requests with a smaller ``seq``, so the fixed point is unique and
equals the sequential result; rounds continue until no leg's result
changes, and the count of rounds follows the depth of cross-account
transfer chains. After the first round the iteration is semi-naive: only
accounts holding a partner of a leg whose result just changed are folded
again, and their results overlay the checkpointed first round, so a round
costs a scan of that base plus work proportional to what changed. Each
round is cut by files in the session's checkpoint folder, so a lost executor
recomputes one round, not the whole chain, and the few rows that changed are
known to be few.

Deep chains. A round settles one step of every chain of dependent transfers,
so a chain of n accounts alone would take n rounds. After ``PATIENCE`` rounds
without an end, or once many legs change and hardly fewer than the round before,
the rest is therefore decided by conflict components. All
requests before the first leg that changed last are settled (a decision
depends on earlier requests only). Accounts linked by later transfers form
components; those that hold a leg still in doubt are folded one by one, each
in arrival order with the balances of all its accounts (``_fold_components``,
partitioned by component). A component of more than ``FOLD_LEGS`` legs is
folded up to that many, which settles this stretch, and the rounds go on
behind it. So memory is bounded by ``FOLD_LEGS`` and a chain of any depth ends
in a number of jobs that grows with its legs / ``FOLD_LEGS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.exprs import money
from ledgerlake.operators.access import authorize
from ledgerlake.operators.changes import assign_next
from ledgerlake.operators.ledger import (ACCEPTED, CREDIT_LIMIT_EXCEEDED, DUPLICATE_NUMBER, INSUFFICIENT_FUNDS, INVALID_TYPE,
                                         NULL_FIELD, SAME_ACCOUNT, SPECIAL, UNKNOWN_ACCOUNT)
from ledgerlake.operators.requests import Result
from ledgerlake.schema import CREDIT_KINDS, DEBIT_KINDS, TIPO_TRANSACAO, Bank
from ledgerlake.session import counted, cut_and_count, cut_to_files, shuffled

MODES = ("as_written", "double_entry")


def _cents(c) -> F.Column:
    return (money(c) * 100).cast("long")


def build_legs(singles: DataFrame | None, transfers: DataFrame | None, mode: str = "as_written") -> DataFrame:
    """Legs (seq, sub, kind, num_conta, num, tipo, valor, _delta, _debit, _same) of singles and transfers.

    ``num`` is the transaction number that the request gives the leg (``num_transacao`` of a single,
    ``num_trans_origem`` / ``num_trans_destino`` of a transfer), NULL where it gives none.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    parts = []
    number = lambda df, c: (F.col(c) if c in df.columns else F.lit(None)).cast("int").alias("num")
    if singles is not None:
        debit = F.col("tipo").isin(DEBIT_KINDS)
        amt = _cents("valor")
        parts.append(singles.select(
            F.col("seq").cast("long").alias("seq"), F.lit(0).alias("sub"), F.lit("single").alias("kind"),
            "num_conta", number(singles, "num_transacao"), "tipo", "valor",
            F.when(debit, -amt).when(F.col("tipo").isin(CREDIT_KINDS), amt).otherwise(F.lit(0)).alias("_delta"),
            debit.alias("_debit"), F.lit(False).alias("_same")))
    if transfers is not None:
        amt = _cents("valor")
        same = F.coalesce(F.col("conta_origem") == F.col("conta_destino"), F.lit(False)).alias("_same")
        origin = transfers.select(
            F.col("seq").cast("long").alias("seq"), F.lit(0).alias("sub"), F.lit("transfer").alias("kind"),
            F.col("conta_origem").alias("num_conta"), number(transfers, "num_trans_origem"), F.lit("transferência").alias("tipo"), "valor",
            (-amt).alias("_delta"), F.lit(True).alias("_debit"), same)
        dest_debit = mode == "as_written"
        dest = transfers.select(
            F.col("seq").cast("long").alias("seq"), F.lit(1).alias("sub"), F.lit("transfer").alias("kind"),
            F.col("conta_destino").alias("num_conta"), number(transfers, "num_trans_destino"), F.lit("transferência").alias("tipo"), "valor",
            (-amt if dest_debit else amt).alias("_delta"), F.lit(dest_debit).alias("_debit"), same)
        parts += [origin, dest]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fold_accounts(batches):
    """Per-account sequential pass over legs sorted by (num_conta, seq, sub).

    A leg's own test uses the balance from the legs applied before it in
    this pass; a leg is applied only when its own test passes and the other
    legs of its request passed in the previous round. A leg whose number an
    applied leg of the account has taken fails. Every state column is carried
    through, so the round needs no join back.
    """
    import numpy as np

    cur, taken = None, set()
    bal = 0
    bal_null = False
    for pdf in batches:
        n = len(pdf)
        acct = pdf["num_conta"].to_numpy()
        delta = pdf["_delta"].to_numpy(dtype=np.int64)
        debit = pdf["_debit"].to_numpy(dtype=bool)
        floor = pdf["_floor"].fillna(0).to_numpy(dtype=np.int64)
        s0 = pdf["_s0"].to_numpy(dtype=np.float64)
        partner = pdf["_partner_ok"].eq(True).to_numpy()
        live = pdf["_live"].eq(True).to_numpy()
        own = np.zeros(n, dtype=bool)
        dup = np.zeros(n, dtype=bool)
        numbered = pdf["num"].notna().to_numpy()
        number = pdf["num"].to_numpy()
        for i in range(n):
            if acct[i] != cur:
                cur, taken = acct[i], set()
                bal_null = bool(np.isnan(s0[i]))
                bal = 0 if bal_null else int(s0[i])
            if not live[i]:
                continue
            dup[i] = numbered[i] and number[i] in taken
            ok = not dup[i] and (bal_null or not (debit[i] and bal + delta[i] < floor[i]))
            own[i] = ok
            if ok and partner[i]:
                if numbered[i]:
                    taken.add(number[i])
                if not bal_null:
                    bal += int(delta[i])
        out = pdf.drop(columns=["_partner_ok"])
        out["_own"], out["_dup"] = own, dup
        yield out


def _round(state: DataFrame) -> DataFrame:
    """One Jacobi step across accounts, sequential within each account."""
    w_req = Window.partitionBy("seq")
    passing = F.sum(F.col("_own").cast("int")).over(w_req) - F.col("_own").cast("int")
    with_partner = (state.withColumn("_partner_ok", passing == F.count(F.lit(1)).over(w_req) - 1)
                    .withColumnRenamed("_own", "_prev"))
    out_schema = T.StructType([f for f in with_partner.schema.fields if f.name != "_partner_ok"]
                              + [T.StructField("_own", T.BooleanType())])
    return (with_partner.repartition("num_conta")
            .sortWithinPartitions("num_conta", "seq", "sub")
            .mapInPandas(_fold_accounts, out_schema))


MERGE_EVERY = 4


PATIENCE = 8
FOLD_LEGS = 1_000_000
ROUND_LEGS = 100_000  # a round that changes more legs than this has to change a tenth less than the one before, or components decide


def _fold_components(batches):
    """Sequential pass over the requests of a component, sorted by (component, seq, sub).

    One balance and one set of numbers per account; both are dropped when the component ends. A request's
    legs may arrive in different batches, so the last request is held back until the next one begins.
    """
    import pandas as pd

    cur, bal, taken = None, {}, {}

    def decide(pdf):
        nonlocal cur, bal, taken
        n = len(pdf)
        comp, seq, acct = (pdf[c].tolist() for c in ("_component", "seq", "num_conta"))
        delta, debit, floor, start = (pdf[c].tolist() for c in ("_delta", "_debit", "_floor", "_start"))
        live, used, num, can = (pdf[c].tolist() for c in ("_live", "_taken", "num", "_can"))
        own, dup, i = [False] * n, [False] * n, 0
        while i < n:
            if comp[i] != cur:
                cur, bal, taken = comp[i], {}, {}
            j = i
            while j < n and seq[j] == seq[i]:
                a = acct[j]
                if live[j] is True:
                    if a not in bal:
                        bal[a] = None if pd.isna(start[j]) else int(start[j])
                    dup[j] = not pd.isna(num[j]) and (used[j] is True or num[j] in taken.get(a, ()))
                    own[j] = not dup[j] and (bal[a] is None or not (debit[j] and bal[a] + delta[j] < floor[j]))
                j += 1
            if can[i] and all(own[i:j]):
                for k in range(i, j):
                    if bal[acct[k]] is not None:
                        bal[acct[k]] += int(delta[k])
                    if not pd.isna(num[k]):
                        taken.setdefault(acct[k], set()).add(num[k])
            i = j
        return pdf[["seq", "sub"]].assign(_own=own, _dup=dup)

    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = (pdf["_component"].iloc[-1], pdf["seq"].iloc[-1])
        whole = ~((pdf["_component"] == last[0]) & (pdf["seq"] == last[1]))
        held = pdf[~whole]
        if whole.any():
            yield decide(pdf[whole])
    if held is not None and len(held):
        yield decide(held)


def _first_stretches(legs: DataFrame, fold_legs: int) -> DataFrame:
    """_component, _end: the seq up to which a component of more than ``fold_legs`` legs is folded now.

    Cuts at a quantile until the stretch is short enough; a cut is a seq of the component, so it holds one request at least.
    """
    def cuts(rows):
        size = rows.groupBy("_component").agg(F.count(F.lit(1)).alias("_legs"), F.percentile_approx(
            "seq", [k / 256 for k in range(1, 256)], 2000).alias("_cuts"))
        part = F.least(F.greatest(F.floor(256.0 * fold_legs / F.col("_legs")), F.lit(1)), F.lit(255)).cast("int")
        return size.select("_component", "_legs", F.element_at("_cuts", part).alias("_end"))

    found = cut_to_files(cuts(legs).where(F.col("_legs") > fold_legs).drop("_legs"))
    while True:
        again = cuts(legs.join(found, "_component").where(F.col("seq") <= F.col("_end")).drop("_end"))
        again = cut_to_files(again.where(F.col("_legs") > 2 * fold_legs).select("_component", F.col("_end").alias("_new")))
        if again.isEmpty():
            return found
        found = cut_to_files(found.join(again, "_component", "left").select("_component", F.coalesce("_new", "_end").alias("_end")))


def _by_component(current: DataFrame, settled: int, dirty: DataFrame, fold_legs: int) -> tuple[DataFrame, DataFrame]:
    """Exact results of the components in doubt (seq, sub, _own, _dup), and the accounts of those folded in part only.

    ``current`` holds all legs with their present results; requests before ``settled`` are final.
    """
    from ledgerlake.operators.conflicts import components

    later = current.where(F.col("seq") >= settled)
    # A request with a leg that cannot pass links nothing and moves nothing; its other leg is still tested.
    requests = later.groupBy("seq").agg(F.min("num_conta").alias("u"), F.max("num_conta").alias("v"), F.min("_live").alias("_can"))
    named = components(requests.where(F.col("_can") & (F.col("u") < F.col("v"))).select("u", "v")).withColumnRenamed("node", "num_conta")
    member = (later.where("num_conta is not null").select("num_conta").distinct().join(shuffled(named), "num_conta", "left")
              .select("num_conta", F.coalesce("component", "num_conta").alias("_component")))
    doubt = member.join(dirty, "num_conta", "left_semi").select("_component").distinct()
    member = cut_to_files(member.join(doubt, "_component", "left_semi"))
    legs = later.join(member, "num_conta").join(shuffled(requests.select("seq", "_can")), "seq")
    ends = _first_stretches(legs, fold_legs)
    legs = legs.join(ends, "_component", "left").where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    # Balances and numbers that the settled requests leave behind, for the accounts in doubt.
    past = current.where(F.col("seq") < settled)
    applied = past.groupBy("seq").agg(F.min("_own").alias("_ok")).where("_ok").select("seq")
    gone = past.join(member.select("num_conta"), "num_conta", "left_semi").join(shuffled(applied), "seq", "left_semi")
    moved = gone.groupBy("num_conta").agg(F.sum("_delta").alias("_moved"))
    numbers = gone.where("num is not null").select("num_conta", "num").distinct().withColumn("_taken", F.lit(True))
    legs = (legs.join(shuffled(moved), "num_conta", "left").join(shuffled(numbers), ["num_conta", "num"], "left")
            .withColumn("_start", F.col("_s0") + F.coalesce("_moved", F.lit(0))))
    rows = legs.select("_component", "seq", "sub", "num_conta", "num", "_delta", "_debit", "_floor", "_start", "_live", "_can",
                       F.coalesce("_taken", F.lit(False)).alias("_taken"))
    folded = (rows.repartition("_component").sortWithinPartitions("_component", "seq", "sub")
              .mapInPandas(_fold_components, "seq long, sub int, _own boolean, _dup boolean"))
    return folded, member.join(ends, "_component", "left_semi").select("num_conta")


def post_transfers(accounts: DataFrame, legs: DataFrame, existing_log: DataFrame | None = None, patience: int = PATIENCE,
                   fold_legs: int = FOLD_LEGS) -> tuple[DataFrame, int]:
    """Run the fixpoint over ``legs``; ``existing_log`` holds the numbers already taken. Returns (legs with their result ``_own``/``_pass`` and ``_leg_reason``, rounds).

    The first round folds every account once. Each later round folds only
    the accounts of partners of the legs that just changed, and lays their
    results over the first round's. After ``patience`` such rounds the rest
    is decided by conflict components (see above), which counts as a round.
    Rounds go on until no leg changes. The overlay is written out every
    ``MERGE_EVERY`` rounds, so plans stay short however deep the chain of
    transfers is.
    """
    acc = accounts.select("num_conta", _cents("saldo").alias("_s0"), F.col("tipo_conta").alias("_tipo_conta"),
                          F.when(F.col("tipo_conta") == SPECIAL,
                                 -_cents(F.coalesce(F.col("limite_credito"), F.lit(0.0))))
                          .otherwise(F.lit(0)).cast("long").alias("_floor"),
                          F.lit(True).alias("_known"))
    pre = (F.when(F.col("num_conta").isNull() | F.col("valor").isNull() | F.col("tipo").isNull(), F.lit(NULL_FIELD))
           .when(~F.col("tipo").isin(TIPO_TRANSACAO), F.lit(INVALID_TYPE))
           .when(F.col("_same"), F.lit(SAME_ACCOUNT))  # neither leg could be judged on its own
           .when(F.col("_known").isNull(), F.lit(UNKNOWN_ACCOUNT))
           .when(F.col("_used"), F.lit(DUPLICATE_NUMBER)))
    if existing_log is not None:
        used = (existing_log.select("num_conta", F.col("num_transacao").cast("int").alias("num")).distinct()
                .withColumn("_used", F.lit(True)))
        legs = legs.join(shuffled(used), ["num_conta", "num"], "left").withColumn("_used", F.coalesce("_used", F.lit(False)))
    else:
        legs = legs.withColumn("_used", F.lit(False))
    cur = (legs.join(shuffled(acc), "num_conta", "left").withColumn("_pre", pre).drop("_used", "_same").withColumn("_dup", F.lit(False))
           .withColumn("_live", F.col("_pre").isNull())
           .withColumn("_s0", F.col("_s0").cast("double"))
           .withColumn("_own", F.col("_live")))
    # Round 1: every account folded once (partners assumed passing); its checkpoint is the first cut.
    first = cut_to_files(_round(cur))
    rounds = 1
    base = first.drop("_prev")
    frontier, changed = cut_and_count(first.where(F.col("_own") != F.col("_prev")).select("seq", "sub"))
    laid = 0  # rows of the overlay, at most
    overlay = base.where("false").select("seq", "sub", F.col("_own").alias("_own_o"), F.col("_dup").alias("_dup_o"))
    legs_key = base.select("seq", "sub", "num_conta")
    own_now, dup_now = F.coalesce(F.col("_own_o"), F.col("_own")), F.coalesce(F.col("_dup_o"), F.col("_dup"))

    def laid_over(rows: DataFrame) -> DataFrame:
        return (rows.join(counted(overlay, laid), ["seq", "sub"], "left").withColumn("_own", own_now).withColumn("_dup", dup_now)
                .drop("_own_o", "_dup_o"))

    # Later rounds: an account's fold changes only if a partner leg's result changed, so only the accounts
    # of partners of the legs that just changed are folded again (semi-naive), over the checkpointed base.
    # Changes and accounts are counted: few of them go to the legs, and the legs stay where they are.
    def partners() -> tuple[DataFrame, int]:
        return cut_and_count(legs_key.join(counted(frontier.select("seq").distinct(), changed), "seq", "left_semi")
                             .join(counted(frontier, changed), ["seq", "sub"], "left_anti").select("num_conta").distinct())

    waited, fresh, (dirty, touched) = 0, True, partners()
    deep, part = False, False
    while touched:
        rounds += 1
        waited += 1
        if (waited > patience or deep) and fresh:
            waited, fresh, part = 0, False, True  # what a stretch leaves in doubt shows in the next round's frontier
            overlay, laid = cut_and_count(overlay)
            settled = frontier.agg(F.min("seq")).first()[0]
            folded, open_accounts = _by_component(laid_over(base), settled, dirty, fold_legs)
            (folded, n), (dirty, touched) = cut_and_count(folded), cut_and_count(open_accounts)
        else:
            d = laid_over(base.join(counted(dirty, touched), "num_conta", "left_semi"))
            req = (base.select("seq", "sub", "_own").join(d.select("seq").distinct(), "seq", "left_semi")
                   .join(counted(overlay, laid), ["seq", "sub"], "left")
                   .groupBy("seq").agg(F.count(F.lit(1)).alias("_n"), F.sum(own_now.cast("int")).alias("_np")))
            d = (d.join(shuffled(req), "seq")
                 .withColumn("_partner_ok", F.col("_np") - F.col("_own").cast("int") == F.col("_n") - 1)
                 .drop("_n", "_np").withColumnRenamed("_own", "_prev"))
            out_schema = T.StructType([f for f in d.schema.fields if f.name != "_partner_ok"]
                                      + [T.StructField("_own", T.BooleanType())])
            folded, n = cut_and_count(d.repartition("num_conta").sortWithinPartitions("num_conta", "seq", "sub")
                                      .mapInPandas(_fold_accounts, out_schema))
            before = changed
            frontier, changed = cut_and_count(folded.where(F.col("_own") != F.col("_prev")).select("seq", "sub"))
            deep, part = changed > ROUND_LEGS and (part or changed > 0.9 * before), False
            (dirty, touched), fresh = partners(), True
        overlay = (overlay.join(counted(folded.select("seq", "sub"), n), ["seq", "sub"], "left_anti")
                   .unionByName(folded.select("seq", "sub", F.col("_own").alias("_own_o"), F.col("_dup").alias("_dup_o"))))
        laid += n
        if rounds % MERGE_EVERY == 0:
            overlay, laid = cut_and_count(overlay)
    cur = laid_over(base)
    reason = (F.when(F.col("_pre").isNotNull(), F.col("_pre"))
              .when(F.col("_dup"), F.lit(DUPLICATE_NUMBER))
              .when(F.col("_tipo_conta") == SPECIAL, F.lit(CREDIT_LIMIT_EXCEEDED))
              .otherwise(F.lit(INSUFFICIENT_FUNDS)))
    done = cur.withColumn("_pass", F.col("_own"))
    return done.withColumn("_leg_reason", F.when(~F.col("_pass"), reason)), rounds


def accepted_legs(legs_done: DataFrame) -> DataFrame:
    """Legs of requests whose every leg passed (a request is applied as a whole)."""
    ok = legs_done.groupBy("seq").agg(F.min(F.col("_own").cast("int")).alias("_ok")).where("_ok = 1")
    return legs_done.join(ok.select("seq"), "seq", "left_semi")


def decisions(legs_done: DataFrame) -> DataFrame:
    """One row per request: status ACCEPTED or the reason of its first failing leg."""
    first_fail = F.min_by(F.col("_leg_reason"), F.when(F.col("_leg_reason").isNotNull(), F.col("sub")))
    return (legs_done.groupBy("seq", "kind")
            .agg(F.min(F.col("_own").cast("int")).alias("_ok"), first_fail.alias("_why"))
            .select("seq", "kind", F.when(F.col("_ok") == 1, F.lit(ACCEPTED)).otherwise(F.col("_why")).alias("status")))


def ledger_rows(legs_done: DataFrame, log: DataFrame, as_of=None) -> DataFrame:
    """New log rows of the accepted legs: given numbers as they are, the others continue their account's sequence.

    Returns seq, sub, num_transacao, num_conta, tipo, data_hora, valor.
    """
    ts = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else F.localtimestamp()
    ok = accepted_legs(legs_done).select("seq", "sub", F.col("num").alias("num_transacao"), "num_conta", "tipo",
                                         ts.alias("data_hora"), "valor")
    given = ok.where(F.col("num_transacao").isNotNull())
    taken = log.select("num_conta", "num_transacao").unionByName(given.select("num_conta", "num_transacao"))
    # Both legs of a transfer may lie on one account, so (seq, sub) is the order.
    free = ok.where(F.col("num_transacao").isNull()).drop("num_transacao").withColumn("_order", F.col("seq") * 2 + F.col("sub"))
    return given.unionByName(assign_next(free, taken, seq="_order").select(*given.columns))


def balances(accounts: DataFrame, legs_done: DataFrame) -> DataFrame:
    """Account snapshot after the accepted legs."""
    d = accepted_legs(legs_done).groupBy("num_conta").agg(F.sum("_delta").alias("_d"))
    return (accounts.join(d, "num_conta", "left")
            .withColumn("saldo", ((_cents("saldo") + F.coalesce("_d", F.lit(0))).cast("decimal(20,0)") / 100)
                        .cast("decimal(18,2)").cast("double"))
            .drop("_d"))


def run_transfers(b: Bank, singles: DataFrame | None, transfer_requests: DataFrame, mode: str = "as_written",
                  log: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Authorize transfer requests (N2), then post them with the singles (K2).

    Returns (one row per request with ``status``, rounds). Requests refused
    by authorization keep their authorization reason. ``log`` (num_conta,
    num_transacao) holds the numbers already taken; give the stored log to
    refuse requests that bring one of them (DUPLICATE_NUMBER).
    """
    done, refused, rounds = _authorized(b, singles, transfer_requests, mode, log)
    return decisions(done).unionByName(refused), rounds


def _authorized(b: Bank, singles, transfer_requests, mode, log) -> tuple[DataFrame, DataFrame, int]:
    auth = authorize(b, transfer_requests)
    ok = auth.where(F.col("reason").isNull()).drop("reason")
    refused = auth.where(F.col("reason").isNotNull()).select(
        F.col("seq").cast("long").alias("seq"), F.lit("transfer").alias("kind"), F.col("reason").alias("status"))
    legs = build_legs(singles, ok, mode)
    done, rounds = post_transfers(b.conta, legs, log)
    return done, refused, rounds


def apply_transfers(b: Bank, singles: DataFrame | None, transfer_requests: DataFrame, mode: str = "as_written", as_of=None) -> Result:
    """Transfers end to end against the stored log: decisions, the new log rows (transacao) and all balances after them (conta).

    Numbers that requests bring are refused if the log has them; the others continue their account's sequence.
    """
    done, refused, _ = _authorized(b, singles, transfer_requests, mode, b.transacao.select("num_conta", "num_transacao"))
    rows = ledger_rows(done, b.transacao, as_of)
    return Result(decisions(done).unionByName(refused),
                  {"transacao": rows, "conta": balances(b.conta, done).select(*b.conta.columns)})
