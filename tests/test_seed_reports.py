"""The tiny bank of tests/seed.py through the reports and audits."""

from pyspark.sql import functions as F

from ledgerlake.operators import ledger as K
from ledgerlake.operators import quality as Q
from ledgerlake.operators import reports as R
from tests.seed import MARTA, seed_bank

AS_OF = "2026-06-10 00:00:00"


def test_payroll_and_reconciliation(spark):
    b = seed_bank(spark)
    pay = {r["num_ag"]: r["sal_total_calc"] for r in R.branch_payroll(b).collect()}
    assert pay == {3: 10850.25, 8: 11914.5, 9: 0.0}
    assert Q.reconcile_balances(b).count() == 0
    rec = {r["num_ag"]: r["diferenca"] for r in Q.reconcile_payroll(b).collect()}
    assert rec == {3: 10850.25, 8: 11914.5}
    assert Q.role_drift(b).count() == 0  # admin over gerente is the allowed pair


def test_activity_windows_and_coholders(spark):
    b = seed_bank(spark)
    for d, n in ((7, 1), (30, 2), (365, 2)):
        assert [tuple(r) for r in R.activity_count(b, AS_OF, d).collect()] == [(61007, n)]  # checking accounts only
    assert R.co_holders(b, MARTA).count() == 1


def test_withdrawals_against_seed_balance(spark):
    b = seed_bank(spark)
    for amount, status, bal in [(310.76, "INSUFFICIENT_FUNDS", 310.75), (310.75, "ACCEPTED", 0.0)]:
        t = spark.createDataFrame([(10, 61007, "saque", amount)], "seq long, num_conta int, tipo string, valor double")
        r = K.post(b.conta, t, seq="seq").decisions.collect()[0]
        assert (r["status"], r["saldo_apos"]) == (status, bal)


def test_window_has_no_upper_bound(spark):
    """Rows after as_of still count (lower bound only)."""
    import datetime as dt

    b = seed_bank(spark, {"transacao": [(4, 3, 61007, "saque", dt.datetime(2030, 1, 1), 1.0)]})
    assert R.activity_count(b, AS_OF, 7).collect()[0]["total"] == 2


def test_enum_sort_and_collation(spark):
    """T4 enum rank order; T5 case/accent-insensitive city filter."""
    b = seed_bank(spark)
    out = [r["cargo"] for r in R.employees_by_city(b.with_tables(
        agencia=b.agencia.withColumn("cidade", F.lit("Évora"))), "EVORA").collect()]
    assert out == ["gerente", "caixa", "gerente", "atendente"]  # by branch, then by rank
    b2 = b.with_tables(agencia=b.agencia.withColumn("cidade", F.lit("São Paulo")))
    assert R.branches_by_city(b2, "sao paulo").count() == 3


def test_dependents_left_join_keeps_zero(spark):
    b = seed_bank(spark)
    got = {r["nome_completo"]: r["dependentes"] for r in R.employees_with_dependents(b, 3).collect()}
    assert got == {"Helena Costa": 2, "Igor Melo": 0}


def test_user_directory_never_returns_secret(spark):
    b = seed_bank(spark)
    d = R.user_directory(b)
    assert "senha" not in d.columns
    assert [r["role"] for r in d.collect()][:2] == ["admin", "admin"]


def test_name_sort_is_case_and_accent_insensitive(spark):
    """T5: names sort as the server's default collation does (Álvaro, ana, Bruno)."""
    b = seed_bank(spark)
    users = spark.createDataFrame(
        [(10, "u1", "ana", "x", "client", None, None), (11, "u2", "Bruno", "x", "client", None, None),
         (12, "u3", "Álvaro", "x", "client", None, None)],
        "id long, username string, nome string, senha string, role string, cpf string, matricula string")
    out = [r["nome"] for r in R.user_directory(b.with_tables(usuario=users)).collect()]
    assert out == ["Álvaro", "ana", "Bruno"]


def test_statements_of_tellers_multiply_last(spark):
    """No exchange moves a row per teller and account or transaction; equal rows and null branches as a plain join has them."""
    from ledgerlake.operators import access as N

    b = seed_bank(spark, {"usuario": [(8, "MAT2044", "Ana", "x", "caixa", None, "MAT2041")]})
    b = b.with_tables(conta=b.conta.withColumn("num_ag", F.when(F.col("num_ag") == 3, F.col("num_ag"))),
                      transacao=b.transacao.unionByName(b.transacao.where("id_transacao = 1")))
    df = N.statements_for(b, b.usuario.where("role = 'caixa'"))
    got = sorted((r["username"], r["scope"], r["num_conta"], r["num_transacao"]) for r in df.collect())
    assert got == sorted((u, "agencia", 61007, n) for u in ("MAT2041", "MAT2044") for n in (1, 1, 2))
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at, top = next((i, x) for i, x in enumerate(lines) if "Join Inner, (num_ag" in x)
    above, least = [], depth(top)
    for x in reversed(lines[:at]):
        if depth(x) < least:
            above, least = above + [x], depth(x)
    assert not any("Join" in x or "Repartition" in x for x in above)
