"""K2 on deep chains: conflict components against the sequential model, and the number of rounds."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake import session
from ledgerlake.operators import changes, conflicts
from ledgerlake.operators import transfers as K2
from ledgerlake.operators.access import authorize
from ledgerlake.operators.conflicts import components
from ledgerlake.plans.catalog import QUERIES
from tests.models import transfers_model
from tests.seed import seed_bank

SF = "/root/testdata/sf0.001"

ACC = "num_conta int, saldo double, tipo_conta string, limite_credito double"
REQ = "seq long, conta_origem int, conta_destino int, valor double"
TX = "seq long, num_conta int, tipo string, valor double"


def _run(spark, accounts, singles, transfers, mode="as_written", **how):
    acc = spark.createDataFrame([(k, *v) for k, v in accounts.items()], ACC)
    legs = K2.build_legs(spark.createDataFrame(singles, TX), spark.createDataFrame(transfers, REQ), mode)
    done, rounds = K2.post_transfers(acc, legs, **how)
    return {r["seq"]: r["status"] for r in K2.decisions(done).collect()}, rounds


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 400)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (2000, 2001), (2001, 2000)]
    random.seed(1)
    random.shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u int, v int")).collect()}
    assert got == {**{i: 1 for i in range(1, 401)}, **{1000 + i: 1000 for i in range(50)}, 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([(3, 3)], "u int, v int")).count() == 0


def test_chain_of_10_000_transfers_ends_in_a_few_rounds(spark):
    """Each transfer depends on the one before it: rounds alone would take 10,000 of them."""
    n = 10_000
    rng = random.Random(4)
    accounts = {i: (100.0, "conta-corrente", None) for i in range(n + 1)}
    transfers = [(i, i, i + 1, float(rng.randint(40, 90))) for i in range(n)]
    got, rounds = _run(spark, accounts, [], transfers)
    assert got == transfers_model(accounts, [], transfers)
    assert rounds <= K2.PATIENCE + 2
    assert len(set(got.values())) == 2


@pytest.mark.parametrize("mode", ["as_written", "double_entry"])
@pytest.mark.parametrize("patience, fold_legs", [(0, 10**6), (1, 10**6), (2, 40), (0, 12)])
def test_components_equal_the_sequential_model(spark, mode, patience, fold_legs):
    """Components from the first round on, and components folded a stretch at a time."""
    rng = random.Random(patience * 7 + fold_legs)
    accounts = {}
    for a in range(1, 13):
        kind = rng.choice(["conta-corrente", "conta especial"])
        accounts[a] = (None if a == 5 else round(rng.uniform(0, 200), 2), kind, 50.0 if kind == "conta especial" else None)
    seqs = rng.sample(range(1, 3000), 220)
    singles = [(s, rng.randint(1, 13), rng.choice(["saque", "depósito", "PIX"]), round(rng.uniform(1, 90), 2)) for s in seqs[:80]]
    transfers = []
    for s in seqs[80:]:
        o, d = rng.sample(range(1, 14), 2)  # account 13 does not exist
        transfers.append((s, o, d, round(rng.uniform(1, 90), 2)))
    got, _ = _run(spark, accounts, singles, transfers, mode, patience=patience, fold_legs=fold_legs)
    assert got == transfers_model(accounts, singles, transfers, mode)


def test_numbers_in_components(spark):
    """Numbers taken by settled legs and by earlier legs of the component are refused, as in the rounds."""
    rng = random.Random(8)
    acc = spark.createDataFrame([(a, 120.0, "conta-corrente", None) for a in range(1, 9)], ACC)
    rows = []
    for s in range(1, 90):
        o, d = rng.sample(range(1, 9), 2)
        rows.append((s, o, d, float(rng.randint(5, 40)), rng.choice([None, rng.randint(1, 12)]), rng.choice([None, rng.randint(1, 12)])))
    t = spark.createDataFrame(rows, REQ + ", num_trans_origem int, num_trans_destino int")
    log = spark.createDataFrame([(1, 3), (4, 7)], "num_conta int, num_transacao int")
    legs = K2.build_legs(None, t, "double_entry")
    runs = [{r["seq"]: r["status"] for r in K2.decisions(K2.post_transfers(acc, legs, log, patience=p, fold_legs=k)[0]).collect()}
            for p, k in ((10**9, 10**6), (0, 10**6), (0, 20))]
    assert runs[0] == runs[1] == runs[2] and "DUPLICATE_NUMBER" in runs[0].values()


def test_transfer_to_the_same_account_is_refused(spark):
    got, _ = _run(spark, {1: (100.0, "conta-corrente", None)}, [(1, 1, "saque", 10.0)], [(2, 1, 1, 60.0), (3, 1, 1, 1.0)])
    assert got == {1: "ACCEPTED", 2: "SAME_ACCOUNT", 3: "SAME_ACCOUNT"}


def test_steps_of_components_keep_real_sizes(spark):
    """The planner's size of the result must not grow with every step (it multiplies at joins)."""
    links = [(i, i + 1) for i in range(3000)] + [(9000, 9000 + i) for i in range(1, 300)]
    random.Random(2).shuffle(links)
    out = components(spark.createDataFrame(links, "u long, v long"))
    assert {r["node"]: r["component"] for r in out.collect()} == {**{i: 0 for i in range(3001)}, **{9000 + i: 9000 for i in range(300)}}
    assert int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() < 1000


def test_deep_chains_of_many_transfers_end_rounds_early(spark, monkeypatch):
    """Rounds that change many legs, and hardly fewer each time, give way to components."""
    accounts = {i: (100.0, "conta-corrente", None) for i in range(2001)}
    transfers = [(i, i, i + 1, 40.0 + i * 7919 % 50) for i in range(2000)]
    monkeypatch.setattr(K2, "ROUND_LEGS", 20)
    got, rounds = _run(spark, accounts, [], transfers)
    assert got == transfers_model(accounts, [], transfers)
    assert rounds < K2.PATIENCE


def _plans(monkeypatch, *modules):
    """The plans of all frames that the modules cut, as they are before they run."""
    found, cut = [], session.cut_and_count

    def seen(df):
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    for m in (session, *modules):
        monkeypatch.setattr(m, "cut_and_count", seen)
    return found


def test_frames_of_many_rows_are_not_broadcast_for_their_small_files(spark):
    """200,000 numbers in order: well below the threshold as files, not as a hash table on the driver."""
    many = session.cut_to_files(spark.range(200_000).withColumn("ok", F.col("id") % 2 == 0))
    other = spark.range(1000, 400_000)
    for side in (many, many.where("ok"), many.select("id").distinct(), many.groupBy("id").agg(F.max("ok"))):
        assert "BroadcastHashJoin" not in other.join(side, "id", "left")._jdf.queryExecution().executedPlan().toString()
    few = session.cut_to_files(spark.range(200))
    assert "BroadcastHashJoin" in other.join(few, "id")._jdf.queryExecution().executedPlan().toString()


def test_greedy_rounds_and_fold_broadcast_no_rows(spark, monkeypatch):
    """holder_chain's job, where every frame counts as large: only the list of large keys may be broadcast."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    plans = _plans(monkeypatch, conflicts, changes)
    asked = spark.createDataFrame([(n, (n + 1) // 2, n // 2 if n % 31 else None) for n in range(120)], "seq long, a long, b long")
    out, _ = changes.greedy_unique(asked, "seq", [["a"], ["b"]], patience=1)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    start, want = 0, {}
    for n in range(120):
        if n % 2 and (n % 31 == 0 or (n - 1) % 31 == 0):  # no account shared with the request before
            start = n
        want[n] = (n - start) % 2 == 0
    assert {r["seq"]: r["accepted"] for r in out.collect()} == want
    assert len(plans) > 10 and not [p for p in plans if "BroadcastHashJoin" in p and "_large" not in p]


def test_transfers_broadcast_no_rows_that_were_not_counted(spark, monkeypatch):
    """Where every frame counts as large, nothing is broadcast: not the accounts, the overlay, the changes or the components."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", -1)
    plans = _plans(monkeypatch, conflicts, K2)
    accounts = {i: (100.0, "conta-corrente", None) for i in range(31)}
    transfers = [(i, i, i + 1, 40.0 + i * 7919 % 50) for i in range(30)]
    got, _ = _run(spark, accounts, [], transfers, patience=1)
    assert got == transfers_model(accounts, [], transfers)
    # A stretch's end is one row per component of a million legs; components in doubt are measured when they are joined.
    assert len(plans) > 10
    assert not [p for p in plans if "BroadcastHashJoin" in p.replace("BroadcastHashJoin [_component", "") and "_end" not in p]


def test_authorization_broadcasts_no_table_of_the_bank(spark):
    b = seed_bank(spark)
    req = spark.createDataFrame([(1, "desconhecido", 1, 2, 10.0)], "seq long, solicitante string, conta_origem int, conta_destino int, valor double")
    out = authorize(b, req)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r["reason"] for r in out.collect()] == ["USER_NOT_FOUND"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", ["post_transfer_chain", "post_transfers"])
def test_inputs_of_transfers_broadcast_no_accounts(spark, monkeypatch, name):
    """All accounts of a bank are small as files: the first plan (requests, authorization, accounts) joins them by shuffle."""
    class Seen(Exception):
        pass

    def first(df):
        raise Seen(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(K2, "cut_to_files", first)
    with pytest.raises(Seen) as plan:
        QUERIES[name](spark, SF)
    assert "SortMergeJoin" in str(plan.value) and "BroadcastHashJoin" not in str(plan.value)
