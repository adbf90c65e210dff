"""Composite requests (I9-I14) on the tiny bank."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlake.operators import quality as Q
from ledgerlake.operators import requests as RQ
from tests.seed import MARTA, TIAGO, digest, seed_bank

AS_OF = "2026-06-10 00:00:00"
D = dt.date(1990, 1, 1)


def test_open_accounts(spark):
    b = seed_bank(spark)
    b = b.with_tables(funcionario=b.funcionario.unionByName(b.funcionario.limit(1).withColumn("matricula", F.lit("MAT1001"))))
    new, other = "99999999999", "88888888888"
    rows = [
        (1, MARTA, None, "poupança", 10.0, 9, 1.0, None, "gerente", "MAT2043"),
        (2, MARTA, None, "poupança", 10.0, 3, 1.0, None, "gerente", "MAT2043"),       # branch held
        (3, new, None, "poupança", 0.0, 8, 1.0, None, "gerente", "MAT2043"),          # not yet a customer
        (4, new, "Nova", "conta especial", 0.0, 8, None, 50.0, "admin", None),        # admin: the default manager
        (5, new, "Nova", "poupança", 5.0, 9, 1.0, None, "gerente", "MAT2043"),        # registered by seq 4
        (6, new, None, "poupança", 7.5, 9, 1.0, None, "admin", "MAT2040"),            # a customer by now
        (7, MARTA, None, "poupança", 5.0, 9, 1.0, None, "gerente", "MAT2043"),        # same branch as seq 1
        (8, MARTA, "Marta", "poupança", 5.0, 8, 1.0, None, "gerente", "MAT2043"),     # stored CPF
        (9, TIAGO, None, "poupança", 5.0, 9, 1.0, None, "caixa", "MAT2041"),
        (10, other, None, "poupança", 5.0, 9, 1.0, None, "gerente", "MAT2043"),
        (11, "123", "Curta", "poupança", 5.0, 9, 1.0, None, "gerente", "MAT2043"),
        (12, TIAGO, None, "poupança", 5.0, 9, 1.0, None, "gerente", "MAT7"),
    ]
    req = spark.createDataFrame(rows, "seq long, cpf string, nome_completo string, tipo_conta string, saldo_inicial double, "
                                      "num_ag int, taxa_juros double, limite_credito double, requester_role string, "
                                      "requester_matricula string")
    req = (req.withColumn("data_nascimento", F.lit(D)).withColumn("senha_hash", F.lit("h" * 64))
           .withColumn("email", F.lit("n@example.org")).withColumn("telefone", F.lit("(85) 98888-7777"))
           .withColumn("username", F.when(F.col("nome_completo").isNotNull(), F.concat(F.lit("u"), F.col("seq").cast("string"))))
           .withColumn("senha", F.lit("pw")).withColumn("rg_numero", F.lit("77")))
    r = RQ.open_accounts(b, req, AS_OF)
    got = {x["seq"]: (x["status"], x["num_conta"]) for x in r.decisions.collect()}
    assert got == {1: ("ACCEPTED", 61009), 2: ("ONE_ACCOUNT_PER_BRANCH", None), 3: ("CUSTOMER_NOT_FOUND", None),
                   4: ("ACCEPTED", 61010), 5: ("CUSTOMER_EXISTS", None), 6: ("ACCEPTED", 61011),
                   7: ("ONE_ACCOUNT_PER_BRANCH", None), 8: ("CUSTOMER_EXISTS", None), 9: ("ROLE_NOT_ALLOWED", None),
                   10: ("CUSTOMER_NOT_FOUND", None), 11: ("INVALID_CPF", None), 12: ("MANAGER_NOT_FOUND", None)}
    conta = {x["num_conta"]: x for x in r.rows["conta"].collect()}
    assert {k: (x["saldo"], x["matricula_gerente"], x["taxa_juros"], x["limite_credito"]) for k, x in conta.items()} == {
        61009: (10.0, "MAT2043", 1.0, None), 61010: (0.0, "MAT1001", None, 50.0), 61011: (7.5, "MAT1001", 1.0, None)}
    dep = {x["num_conta"]: x["valor"] for x in r.rows["transacao"].collect()}
    assert dep == {61009: 10.0, 61011: 7.5}  # no deposit row for a zero opening balance
    cli = r.rows["cliente"].collect()
    assert [(x["cpf"], x["rg_numero"], x["rg_uf"], x["cidade"]) for x in cli] == [(new, "77", "", None)]
    assert r.rows["cliente"].columns == b.cliente.columns
    assert [(x["id"], x["username"], x["cpf"], x["senha"]) for x in r.rows["usuario"].collect()] == [(8, "u4", new, digest("pw"))]
    assert [x["telefone"] for x in r.rows["telefone_cliente"].collect()] == ["85988887777"]
    after = b.with_tables(conta=b.conta.unionByName(r.rows["conta"]), transacao=b.transacao.unionByName(
        r.rows["transacao"].select((F.col("seq") + 100).cast("int").alias("id_transacao"), "num_transacao", "num_conta", "tipo",
                                   "data_hora", "valor")))
    assert Q.reconcile_balances(after).count() == 0


def test_register_customers(spark):
    b = seed_bank(spark)
    b = b.with_tables(usuario=b.usuario.where(F.col("cpf").isNull() | (F.col("cpf") != TIAGO)))
    req = spark.createDataFrame([
        (1, "11111111111", "Ana", D, "ana", "pw", "a@x.com", "(85) 98888-7777"),
        (2, MARTA, "Eva", D, "eva2", "pw", None, None),                # CPF of a user
        (3, "22222222222", "Bia", D, "ana", "pw", None, None),         # username repeats seq 1
        (4, TIAGO, "Tiago", D, "tiago", "pw", None, None),             # a customer without a user
        (5, "12", "Curta", D, "curta", "pw", None, None),
        (6, "33333333333", "", D, "vazia", "pw", None, None),
    ], "seq long, cpf string, nome_completo string, data_nascimento date, username string, senha string, "
       "email string, telefone string")
    r = RQ.register_customers(b, req, AS_OF)
    got = {x["seq"]: (x["status"], x["num_conta"]) for x in r.decisions.collect()}
    assert got == {1: ("ACCEPTED", 61009), 2: ("USER_OR_CPF_EXISTS", None), 3: ("USER_OR_CPF_EXISTS", None),
                   4: ("CUSTOMER_EXISTS", None), 5: ("INVALID_CPF", None), 6: ("MISSING_FIELD", None)}
    assert [x["telefone"] for x in r.rows["telefone_cliente"].collect()] == ["85988887777"]
    conta = r.rows["conta"].collect()[0]
    assert (conta["num_ag"], conta["matricula_gerente"], conta["tipo_conta"], conta["saldo"]) == (3, "MAT2040", "conta-corrente", 1000.0)
    assert [x["valor"] for x in r.rows["transacao"].collect()] == [1000.0]
    assert r.rows["cliente"].columns == b.cliente.columns and [x["id"] for x in r.rows["usuario"].collect()] == [7]


def test_employees(spark):
    b = seed_bank(spark)
    req = spark.createDataFrame([
        (1, "hire", None, "Nova", "caixa", "feminino", D, 3000.0, 9, "h" * 64, "Évora"),
        (2, "hire", None, "Baixo", "caixa", "feminino", D, 1000.0, 9, "h" * 64, None),
        (3, "edit", "MAT2040", "Helena C.", "gerente", "feminino", D, 8200.25, 8, "", "Faro"),
        (4, "edit", "MAT2041", "Igor Melo", "caixa", "masculino", D, 2750.0, 3, "z" * 64, "Faro"),
    ], "seq long, op string, matricula string, nome_completo string, cargo string, genero string, "
       "data_nascimento date, salario double, num_ag int, senha_hash string, cidade string")
    r = RQ.apply_employees(b, req)
    got = {x["seq"]: (x["status"], x["matricula"]) for x in r.decisions.collect()}
    assert got == {1: ("ACCEPTED", "MAT2044"), 2: ("SALARY_BELOW_FLOOR", None), 3: ("ACCEPTED", None), 4: ("ACCEPTED", None)}
    f = {x["matricula"]: x for x in r.rows["funcionario"].collect()}
    assert (f["MAT2040"]["salario"], f["MAT2040"]["cidade"], f["MAT2040"]["senha"]) == (8200.25, "Faro", digest("h"))
    assert f["MAT2041"]["senha"] == "z" * 64 and f["MAT2044"]["cidade"] == "Évora"
    users = {x["username"]: x for x in r.rows["usuario"].collect()}
    assert (users["MAT2040"]["role"], users["MAT2040"]["senha"]) == ("gerente", digest("h"))  # T16: admin becomes gerente
    assert users["MAT2041"]["senha"] == "z" * 64 and (users["MAT2044"]["id"], users["MAT2044"]["role"]) == (8, "caixa")
    pay = {x["num_ag"]: x["sal_total"] for x in r.rows["agencia"].collect()}
    assert pay == {3: -8100.25, 8: 8200.25, 9: 3000.0}  # stored totals were 0: only the changes show


def test_promotions_in_arrival_order(spark):
    b = seed_bank(spark)
    prom = spark.createDataFrame([
        (1, 6, "admin", 1, "admin"),       # still a client
        (2, 6, "gerente", 1, "admin"), (3, 6, "admin", 5, "gerente"), (4, 6, "gerente", 1, "admin"), (5, 6, "admin", 1, "admin"),
        (6, 3, "gerente", 3, "caixa"), (7, 99, "gerente", 1, "admin"), (8, 5, "admin", 1, "admin"), (9, 5, "admin", 1, "admin"),
    ], "seq long, id_usuario long, novo_cargo string, requester_id long, requester_role string")
    p = RQ.apply_promotions(b, prom)
    got = {x["seq"]: x["status"] for x in p.decisions.collect()}
    assert got == {1: "NOT_ALLOWED", 2: "ACCEPTED", 3: "NOT_ALLOWED", 4: "NOT_ALLOWED", 5: "ACCEPTED",
                   6: "SELF_PROMOTION", 7: "USER_NOT_FOUND", 8: "ACCEPTED", 9: "NOT_ALLOWED"}
    u = {x["id"]: (x["role"], x["matricula"]) for x in p.rows["usuario"].collect()}
    assert u[6] == ("admin", "MAT2044") and u[5] == ("admin", "MAT2043")
    emp = {x["matricula"]: (x["cargo"], x["salario"], x["num_ag"], x["genero"]) for x in p.rows["funcionario"].collect()}
    assert emp["MAT2044"] == ("gerente", 3000.0, 1, "não-binário") and emp["MAT2043"][0] == "gerente"


_DEPS = ("seq long, op string, matricula_func string, nome_antigo string, nome_completo string, "
         "data_nascimento date, parentesco string")


def test_dependents_and_fees(spark):
    b = seed_bank(spark)
    req = spark.createDataFrame([
        (1, "add", "MAT2041", None, "Filha", dt.date(2012, 7, 1), "filho(a)"),
        (2, "edit", "MAT2040", "Rui Costa", "Rui C. Costa", dt.date(2015, 9, 9), "filho(a)"),
        (3, "edit", "MAT2041", "Ninguém", "Outro", D, "filho(a)"),               # no such row: nothing happens
        (4, "add", "MAT2040", None, "LÍA costa", D, "filho(a)"),                 # one name, whatever case and accents
        (5, "add", "MAT0", None, "Solto", D, "filho(a)"), (6, "add", "MAT2041", None, "Primo", D, "primo"),
        (7, "add", "MAT2041", None, None, D, "filho(a)"),
    ], _DEPS)
    r = RQ.apply_dependents(b, req, AS_OF)
    got = {x["seq"]: x["status"] for x in r.decisions.collect()}
    assert got == {1: "ACCEPTED", 2: "ACCEPTED", 3: "ACCEPTED", 4: "DUPLICATE_KEY", 5: "UNKNOWN_EMPLOYEE",
                   6: "INVALID_KINSHIP", 7: "MISSING_FIELD"}
    deps = {(x["matricula_func"], x["nome_completo"]): x["idade"] for x in r.rows["dependente"].collect()}
    assert deps == {("MAT2040", "Rui C. Costa"): 10, ("MAT2040", "Lia Costa"): 54, ("MAT2041", "Filha"): 13}

    fees = spark.createDataFrame([
        (1, 61007, 100.0, "MAT2042", "MAT2041"), (2, 61007, 5.0, "MAT2041", "MAT2041"), (3, 61007, 2000.0, "MAT2042", "MAT2041"),
        (4, 61007, 1.0, "MAT2042", "908.172.635-40"), (5, 61007, 1.0, "MAT2042", "nobody"), (6, 1, 1.0, "MAT2042", "MAT2043"),
        (7, 61007, 0.0, "MAT2042", "MAT2043"), (8, 61007, 10.0, "MAT2042", "MAT2043")],
        "seq long, num_conta int, valor double, requester_matricula string, authorizer_username string")
    f = RQ.post_fees(b, fees, AS_OF)
    got = {x["seq"]: x["status"] for x in f.decisions.collect()}
    assert got == {1: "ACCEPTED", 2: "SELF_AUTHORIZATION", 3: "INSUFFICIENT_FUNDS", 4: "AUTHORIZER_NOT_EMPLOYEE",
                   5: "AUTHORIZER_NOT_EMPLOYEE", 6: "UNKNOWN_ACCOUNT", 7: "INVALID_AMOUNT", 8: "ACCEPTED"}
    rows = sorted((x["num_transacao"], x["tipo"], x["valor"]) for x in f.rows["transacao"].collect())
    assert rows == [(3, "pagamento", 100.0), (4, "pagamento", 10.0)]


def test_dependents_in_arrival_order(spark):
    """A delete earlier in the batch frees a slot for a later add; an edit onto an existing name is refused."""
    b = seed_bank(spark)
    rows = [(i, "add", "MAT2040", None, f"Dep {i}", D, "filho(a)") for i in range(1, 4)]  # 2 stored + 3 = 5
    rows += [(5, "add", "MAT2040", None, "Dep 1", D, "filho(a)"),            # the limit is checked before the name
             (6, "delete", "MAT2040", "dep 1", "Dep 1", D, "filho(a)"),      # frees a slot
             (7, "add", "MAT2040", None, "Extra", D, "filho(a)"),            # now accepted
             (8, "edit", "MAT2040", "Dep 2", "Extra", D, "filho(a)"),        # new name exists
             (9, "edit", "MAT2040", "Dep 3", "Dep 3b", D, "cônjuge")]
    r = RQ.apply_dependents(b, spark.createDataFrame(rows, _DEPS), AS_OF)
    got = {x["seq"]: x["status"] for x in r.decisions.collect()}
    assert got == {1: "ACCEPTED", 2: "ACCEPTED", 3: "ACCEPTED", 5: "DEPENDENT_LIMIT", 6: "ACCEPTED", 7: "ACCEPTED",
                   8: "DUPLICATE_KEY", 9: "ACCEPTED"}
    names = sorted(x["nome_completo"] for x in r.rows["dependente"].where("matricula_func = 'MAT2040'").collect())
    assert names == ["Dep 2", "Dep 3b", "Extra", "Lia Costa", "Rui Costa"]


def test_cash_operations(spark):
    b = seed_bank(spark)
    req = spark.createDataFrame([
        (1, "MAT2041", 61007, "saque", 300.0), (2, "MAT2041", 61007, "saque", 20.0), (3, "MAT2041", 61007, "depósito", 50.0),
        (4, "MAT2041", 61007, "saque", 20.0), (5, "MAT2041", 61008, "saque", 1.0), (6, "Admin", 61008, "saque", 200.0),
        (7, "MAT2043", 61008, "saque", 1.0), (8, "Admin", 61008, "depósito", 0.0), (9, "Admin", 5, "depósito", 1.0),
        (10, MARTA, 61007, "saque", 1.0)], "seq long, solicitante string, num_conta int, tipo string, valor double")
    r = RQ.cash_operations(b, req, AS_OF)
    got = {x["seq"]: (x["status"], x["saldo_apos"]) for x in r.decisions.collect()}
    assert got == {1: ("ACCEPTED", 10.75), 2: ("INSUFFICIENT_FUNDS", 10.75), 3: ("ACCEPTED", 60.75), 4: ("ACCEPTED", 40.75),
                   5: ("BRANCH_MISMATCH", None), 6: ("ACCEPTED", -110.9), 7: ("ROLE_NOT_ALLOWED", None),
                   8: ("INVALID_AMOUNT", None), 9: ("UNKNOWN_ACCOUNT", None), 10: ("ROLE_NOT_ALLOWED", None)}
    rows = sorted((x["num_conta"], x["num_transacao"], x["valor"]) for x in r.rows["transacao"].collect())
    assert rows == [(61007, 3, 300.0), (61007, 4, 50.0), (61007, 5, 20.0), (61008, 2, 200.0)]
    assert {x["num_conta"]: x["saldo"] for x in r.rows["conta"].collect()} == {61007: 40.75, 61008: -110.9}


def test_many_dependents_of_one_employee(spark):
    """Each of 40,000 stored names is renamed or removed: the time of a request does not grow with the employee's rows."""
    import time

    b = seed_bank(spark)
    n = 40_000
    stored = spark.range(n).select(F.concat(F.lit("Dep "), F.col("id").cast("string")).alias("nome_completo"),
                                   F.lit("MAT2041").alias("matricula_func"), F.lit(D).alias("data_nascimento"),
                                   F.lit("filho(a)").alias("parentesco"), F.lit(1).alias("idade"))
    req = stored.withColumn("seq", F.substring("nome_completo", 5, 9).cast("long")).select(
        "seq", F.when(F.col("seq") % 4 == 0, "delete").otherwise("edit").alias("op"), "matricula_func", F.col("nome_completo").alias("nome_antigo"),
        F.concat("nome_completo", F.lit(" Jr")).alias("nome_completo"), "data_nascimento", "parentesco")
    start = time.time()
    r = RQ.apply_dependents(b.with_tables(dependente=stored), req, AS_OF)
    assert time.time() - start < 30
    assert r.decisions.where("status = 'ACCEPTED'").count() == n
    assert r.rows["dependente"].where("nome_completo like '% Jr'").count() == r.rows["dependente"].count() == n * 3 // 4
