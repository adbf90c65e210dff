"""Change application: greedy acceptance (J5, I4), dependents (J7), numbering (I7, I8), updates."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import changes as I
from tests.seed import MARTA, TIAGO, seed_bank


def _greedy_model(rows, keys):
    taken = [set() for _ in keys]
    out = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        ks = [tuple(r[c] for c in k) for k in keys]
        clash = any(None not in kv and kv in taken[i] for i, kv in enumerate(ks))
        out[r["seq"]] = not clash
        if not clash:
            for i, kv in enumerate(ks):
                if None not in kv:
                    taken[i].add(kv)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_unique_equals_sequential(spark, seed):
    rng = random.Random(seed)
    rows = [{"seq": s, "a": rng.randint(0, 8), "b": rng.randint(0, 8), "c": rng.choice([None, 1, 2, 3])}
            for s in rng.sample(range(1000), 80)]
    df = spark.createDataFrame([(r["seq"], r["a"], r["b"], r["c"]) for r in rows], "seq long, a int, b int, c int")
    keys = [["a"], ["b", "c"]]
    got, rounds = I.greedy_unique(df, "seq", keys)
    assert {r["seq"]: r["accepted"] for r in got.collect()} == _greedy_model(rows, keys)


def test_accept_holders_rules(spark):
    import datetime as dt

    extra = {
        "cliente": [("11111111111", "Gil", "1", "SSP", "CE", dt.date(1990, 1, 1), None, None, None, None, None,
                     None, None, None)],
        "conta": [(61020, 10.0, "x" * 64, "poupança", 0.5, None, None, 3, "MAT2040"),
                  (61021, 10.0, "x" * 64, "conta-corrente", None, None, None, 9, "MAT2040")],
    }
    b = seed_bank(spark, extra)
    req = spark.createDataFrame([
        (1, 61020, MARTA, "2º titular"),   # same branch as her stored account -> refused
        (2, 61021, "11111111111", "1º titular"),   # accepted
        (3, 61021, MARTA, "1º titular"),   # slot taken by seq 2 in this batch
        (4, 61021, MARTA, "2º titular"),   # accepted
        (5, 59999, "11111111111", "2º titular"),   # unknown account
        (6, 61021, TIAGO, None),                   # no slot
        (7, 61021, "11111111111", "2º titular"),   # holds this branch since seq 2, and the slot is taken
    ], "seq long, num_conta int, cpf_cliente string, tipo_titular string")
    out, _ = I.accept_holders(b, req)
    got = {r["seq"]: (r["accepted"], r["reason"]) for r in out.collect()}
    assert got == {1: (False, "ONE_ACCOUNT_PER_BRANCH"), 2: (True, None), 3: (False, "SLOT_TAKEN"),
                   4: (True, None), 5: (False, "UNKNOWN_ACCOUNT"), 6: (False, "INVALID_SLOT"),
                   7: (False, "ONE_ACCOUNT_PER_BRANCH")}


def test_accept_dependents_limit_and_duplicates(spark):
    import datetime as dt

    b = seed_bank(spark)
    d = dt.date(2000, 1, 1)
    req = spark.createDataFrame(
        [("Rui Costa", "MAT2040", d, "filho(a)", None, 0)] + [(f"Dep {i}", "MAT2040", d, "filho(a)", None, i) for i in range(1, 5)]
        + [("Rui Costa", "MAT2040", d, "filho(a)", None, 50), ("Dep 1", "MAT2041", d, "filho(a)", None, 51),
           ("Dep 1", "MAT2041", d, "filho(a)", None, 52)],
        "nome_completo string, matricula_func string, data_nascimento date, parentesco string, idade int, seq long")
    got = {r["seq"]: (r["accepted"], r["reason"]) for r in I.accept_dependents(b.dependente, req).collect()}
    assert got[0] == (False, "DUPLICATE_KEY")  # stored name, slots left
    assert [got[i] for i in range(1, 5)] == [(True, None)] * 3 + [(False, "DEPENDENT_LIMIT")]
    assert got[50] == (False, "DEPENDENT_LIMIT")  # the limit is checked before the key
    assert got[51] == (True, None) and got[52] == (False, "DUPLICATE_KEY")


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 + 3).alias("seq")).repartition(13)
    got = sorted((r["seq"], r["_grank"]) for r in I.global_rank(df, "seq").collect())
    assert [g for _, g in got] == list(range(1, 5001))


def test_assign_next_continues_per_account(spark):
    existing = spark.createDataFrame([(1, 3), (1, 5), (2, 1)], "num_conta int, num_transacao int")
    req = spark.createDataFrame([(10, 1), (11, 2), (12, 1), (13, 3)], "seq long, num_conta int")
    got = {r["seq"]: r["num_transacao"] for r in I.assign_next(req, existing, chunk_span=2).collect()}
    assert got == {10: 6, 11: 2, 12: 7, 13: 1}


def test_apply_updates_latest_change_per_column(spark):
    b = seed_bank(spark)
    ch = spark.createDataFrame([(MARTA, 1, "X", None), (MARTA, 2, None, "Y"), (MARTA, 3, "Z", None)],
                               "cpf string, seq long, bairro string, cidade string")
    r = I.apply_updates(b.cliente, ch, ["cpf"], ["bairro", "cidade"]).where(F.col("cpf") == MARTA).collect()[0]
    assert (r["bairro"], r["cidade"]) == ("Z", "Y")


def test_sync_users_first_wins_on_any_key(spark):
    import datetime as dt

    # A customer whose CPF text equals an employee's matricula clashes on username: the employee
    # (inserted first) keeps it and the customer row is ignored.
    clash = ("MAT2041", "Zeca", "1", "SSP", "CE", dt.date(1990, 1, 1), None, None, None, None, None, None, None, None)
    b = seed_bank(spark, {"cliente": [clash]})
    users = I.sync_users(b).collect()
    names = [u["username"] for u in sorted(users, key=lambda u: u["id"])]
    assert names == ["MAT2040", "MAT2041", "MAT2042", "MAT2043", TIAGO, MARTA, "Admin"]
    assert [u["role"] for u in sorted(users, key=lambda u: u["id"])][:4] == ["gerente", "caixa", "atendente", "gerente"]


def test_greedy_unique_follows_deep_chains(spark):
    """Requests that chain over two keys need a round for every other one; all are settled, whatever the depth."""
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(41)]
    out, rounds = I.greedy_unique(spark.createDataFrame(rows, "seq long, a string, b string"), "seq", [["a"], ["b"]])
    taken, expect = set(), {}
    for i, a, b in rows:
        expect[i] = a not in taken and b not in taken
        if expect[i]:
            taken |= {a, b}
    assert {r["seq"]: r["accepted"] for r in out.collect()} == expect
    assert rounds > I.MERGE_EVERY  # decided rows were merged on the way
    one, _ = I.greedy_unique(spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "seq long, a string"), "seq", [["a"]])
    assert {r["seq"] for r in one.where("accepted").collect()} == {1, 3, 4}


def _clash_model(rows):
    taken, out = set(), {}
    for seq, *ks in sorted(rows):
        held = [(i, k) for i, k in enumerate(ks) if k is not None]
        clash = next((i for i, k in held if (i, k) in taken), None)
        out[seq] = (clash is None, clash)
        if clash is None:
            taken.update(held)
    return out


def test_chain_of_5000_requests_ends_in_a_few_rounds(spark):
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}" if i % 97 else None) for i in range(5000)]
    out, rounds = I.greedy_unique(spark.createDataFrame(rows, "seq long, a string, b string"), "seq", [["a"], ["b"]])
    assert {r["seq"]: (r["accepted"], r["_clash"]) for r in out.collect()} == _clash_model(rows)
    assert rounds == I.PATIENCE + 1


def test_long_chains_of_many_requests_end_rounds_early(spark, monkeypatch):
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}" if i % 97 else None) for i in range(3000)]
    monkeypatch.setattr(I, "ROUND_ROWS", 100)
    out, rounds = I.greedy_unique(spark.createDataFrame(rows, "seq long, a string, b string"), "seq", [["a"], ["b"]])
    assert {r["seq"]: (r["accepted"], r["_clash"]) for r in out.collect()} == _clash_model(rows)
    assert rounds == 2


@pytest.mark.parametrize("patience, fold_rows", [(0, 10**6), (1, 12), (10**6, 1)])
def test_components_of_requests_equal_the_model(spark, patience, fold_rows):
    """Components at once, in small stretches, after a round, and rounds only: the same decisions and the same clashing key."""
    rng = random.Random(patience + fold_rows)
    pick = lambda n: None if rng.random() < 0.2 else rng.randint(1, n)
    rows = [(s, pick(8), pick(30), f'"{pick(12)}"') for s in rng.sample(range(10_000), 70)]
    df = spark.createDataFrame(rows, "seq long, a int, b int, c string").withColumn("z", F.lit("x"))
    out, _ = I.greedy_unique(df, "seq", [["a"], ["b", "z"], ["c"]], patience=patience, fold_rows=fold_rows)
    assert {r["seq"]: (r["accepted"], r["_clash"]) for r in out.collect()} == _clash_model(rows)
    assert out.columns == df.columns + ["accepted", "_clash"]


def test_greedy_unique_of_nothing(spark):
    out, rounds = I.greedy_unique(spark.createDataFrame([], "seq long, a int, b int"), "seq", [["a"], ["b"]])
    assert out.count() == 0 and rounds == 0
