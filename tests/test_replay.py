"""K1 on hot accounts: chunk summaries against the sequential model, and how few rows are replayed."""

import random

import pytest

from ledgerlake.operators import ledger as K
from tests.models import post_model

ACC = "num_conta int, saldo double, tipo_conta string, limite_credito double"
TX = "seq long, num_conta int, tipo string, valor double"


def _decided(spark, accounts, txns, **how):
    posting = K.post(spark.createDataFrame([(k, *v) for k, v in accounts.items()], ACC), spark.createDataFrame(txns, TX), seq="seq", **how)
    return {r["seq"]: (r["status"], r["saldo_apos"]) for r in posting.decisions.collect()}, posting


def _equal(got, exp):
    assert got.keys() == exp.keys()
    for s, (status, bal) in exp.items():
        assert got[s][0] == status and (got[s][1] is None if bal is None else abs(got[s][1] - float(bal)) < 1e-9), (s, got[s], exp[s])


@pytest.mark.parametrize("replay_chunks", [1, 3, 64])
@pytest.mark.parametrize("seed", range(3))
def test_chunks_equal_the_sequential_model(spark, seed, replay_chunks):
    """Often refused, several hot accounts, one of each odd kind: a null balance, negative debits, unknown account."""
    rng = random.Random(seed)
    accounts = {1: (50.0, "conta-corrente", None), 2: (0.0, "conta especial", 80.0), 3: (None, "poupança", None),
                4: (20.0, "conta-corrente", None), 5: (100.0, "poupança", None)}
    txns = []
    for s in rng.sample(range(10_000), 900):
        a = rng.choice([1, 1, 2, 2, 3, 4, 5, 6])
        v = round(rng.uniform(1, 60), 2) * (-1 if a == 4 and rng.random() < 0.2 else 1)
        txns.append((s, a, rng.choice(["saque", "depósito", "PIX", "estorno"]), v))
    got, posting = _decided(spark, accounts, txns, chunk_span=40, replay_chunks=replay_chunks)
    _equal(got, post_model(accounts, txns))
    assert posting.rounds > 1 or replay_chunks > 1


def test_rare_refusals_replay_few_rows(spark):
    """An early refused debit leaves every later balance of "everything accepted" below the floor; only its chunk is replayed."""
    accounts = {1: (1000.0, "conta-corrente", None), 2: (10.0, "conta-corrente", None)}
    txns = [(s, 1, "depósito" if s % 2 else "saque", 5.0) for s in range(20_000)]
    for s in (37, 9_000, 15_500):
        txns[s] = (s, 1, "saque", 1_000_000.0)
    txns += [(20_000 + s, 2, "saque", 6.0) for s in range(4)]
    got, posting = _decided(spark, accounts, txns, chunk_span=500)
    _equal(got, post_model(accounts, txns))
    assert sum(v[0] != "ACCEPTED" for k, v in got.items() if k < 20_000) == 3
    assert 0 < posting.replayed <= 64 * 500 and posting.rounds <= 3
    one_by_one = _decided(spark, accounts, txns, chunk_span=500, replay_chunks=1)
    assert one_by_one[0] == got and one_by_one[1].replayed == 3 * 500


def test_numbers_repeated_in_a_hot_account(spark):
    accounts = {1: (30.0, "conta-corrente", None)}
    rng = random.Random(2)
    txns = [(s, 1, rng.choice(["saque", "depósito"]), float(rng.randint(1, 20)), rng.choice([None, rng.randint(1, 40)])) for s in range(300)]
    tx = spark.createDataFrame(txns, TX + ", num_transacao int")
    acc = spark.createDataFrame([(k, *v) for k, v in accounts.items()], ACC)
    got = {r["seq"]: r["status"] for r in K.post(acc, tx, seq="seq", chunk_span=20).decisions.collect()}
    assert got == {k: v[0] for k, v in post_model(accounts, txns).items()}
