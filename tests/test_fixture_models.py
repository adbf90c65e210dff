"""Rows-only registered queries checked against the sequential models on the driver's sf0.001 tables."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.access import authorize
from ledgerlake.plans.catalog import QUERIES
from ledgerlake.sources.fixture import Fixture
from tests.models import post_model, transfers_model

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _accounts(b):
    return {r[0]: (r[1], r[2], r[3])
            for r in b.conta.select("num_conta", "saldo", "tipo_conta", "limite_credito").collect()}


@pytest.mark.parametrize("name,mode", [("post_transfers", "as_written"), ("post_transfers_double_entry", "double_entry")])
def test_post_transfers_matches_model(spark, name, mode):
    fx = Fixture(spark, SF)
    b = fx.bank()
    got = {r["seq"]: r["status"] for r in QUERIES[name](spark, SF).collect()}
    singles = [tuple(r) for r in b.transacao.where(F.col("tipo") != "transferência").select(
        "id_transacao", "num_conta", "tipo", "valor").collect()]
    auth = authorize(b, fx.view("transfer_req")).collect()
    ok = [(r["seq"], r["conta_origem"], r["conta_destino"], r["valor"]) for r in auth if r["reason"] is None]
    exp = transfers_model(_accounts(b), singles, ok, mode)
    exp.update({r["seq"]: r["reason"] for r in auth if r["reason"] is not None})
    assert got == exp


def test_post_matches_model_on_fixture(spark):
    b = Fixture(spark, SF).bank()
    got = {r["id_transacao"]: r["status"] for r in QUERIES["post"](spark, SF).collect()}
    txns = [tuple(r) for r in b.transacao.select("id_transacao", "num_conta", "tipo", "valor").collect()]
    exp = {k: v[0] for k, v in post_model(_accounts(b), txns).items()}
    assert got == exp
    assert sum(1 for v in got.values() if v == "ACCEPTED") == 859


def test_accept_holders_matches_model(spark):
    fx = Fixture(spark, SF)
    b = fx.bank()
    got = {r["seq"]: r["accepted"] for r in QUERIES["accept_holders"](spark, SF).collect()}
    branch = {r[0]: r[1] for r in b.conta.select("num_conta", "num_ag").collect()}
    held_branch = set()
    held_slot = set()
    held_pk = set()
    for r in b.titularidade_conta.collect():
        held_branch.add((r["cpf_cliente"], branch[r["num_conta"]]))
        held_slot.add((r["num_conta"], r["tipo_titular"]))
        held_pk.add((r["num_conta"], r["cpf_cliente"]))
    known = {r[0] for r in b.cliente.select("cpf").collect()}
    exp = {}
    for r in sorted(fx.view("holder_req").collect(), key=lambda r: r["seq"]):
        acct, cpf, slot = r["num_conta"], r["cpf_cliente"], r["tipo_titular"]
        ok = (acct in branch and cpf in known and (cpf, branch[acct]) not in held_branch
              and (acct, slot) not in held_slot and (acct, cpf) not in held_pk)
        exp[r["seq"]] = ok
        if ok:
            held_branch.add((cpf, branch[acct]))
            held_slot.add((acct, slot))
            held_pk.add((acct, cpf))
    assert got == exp


def test_post_fees_matches_model(spark):
    from ledgerlake.plans.catalog import fee_requests

    fx = Fixture(spark, SF)
    b = fx.bank()
    got = {r["seq"]: r["status"] for r in QUERIES["post_fees"](spark, SF).collect()}
    staff = {}
    for r in sorted(b.usuario.collect(), key=lambda r: -r["id"]):
        staff |= {k: r["matricula"] for k in (r["username"], r["cpf"], r["matricula"]) if k}
    accounts = _accounts(b)
    exp, to_post = {}, []
    for r in sorted(fee_requests(fx).collect(), key=lambda r: r["seq"]):
        auth = staff.get(r["authorizer_username"])
        if auth is None:
            exp[r["seq"]] = "AUTHORIZER_NOT_EMPLOYEE"
        elif auth == r["requester_matricula"]:
            exp[r["seq"]] = "SELF_AUTHORIZATION"
        elif r["num_conta"] not in accounts:
            exp[r["seq"]] = "UNKNOWN_ACCOUNT"
        elif r["valor"] is None or r["valor"] <= 0:
            exp[r["seq"]] = "INVALID_AMOUNT"
        else:
            to_post.append((r["seq"], r["num_conta"], "pagamento", r["valor"]))
    exp.update({k: v[0] for k, v in post_model(accounts, to_post).items()})
    assert got == exp


def test_apply_dependents_as_the_screen_does(spark):
    """Each request in arrival order against a list per employee: limit, kinship, name, employee."""
    from ledgerlake.plans.catalog import dependent_requests

    fx = Fixture(spark, SF)
    b = fx.bank()
    got = {r["seq"]: r["status"] for r in QUERIES["apply_dependents"](spark, SF).collect()}
    names = {}
    for r in b.dependente.collect():
        names.setdefault(r["matricula_func"], []).append(r["nome_completo"].lower())
    staff = {r["matricula"] for r in b.funcionario.collect()}
    exp = {}
    for r in sorted(dependent_requests(fx).collect(), key=lambda r: r["seq"]):
        own = names.setdefault(r["matricula_func"], [])
        new, old = r["nome_completo"].lower(), (r["nome_antigo"] or "").lower()
        bad_kin = r["parentesco"] not in ("filho(a)", "cônjuge", "genitor(a)")
        if r["op"] == "add":
            why = ("DEPENDENT_LIMIT" if len(own) >= 5 else "INVALID_KINSHIP" if bad_kin else "DUPLICATE_KEY" if new in own
                   else "UNKNOWN_EMPLOYEE" if r["matricula_func"] not in staff else "ACCEPTED")
            if why == "ACCEPTED":
                own.append(new)
        elif r["op"] == "delete":
            why, names[r["matricula_func"]] = "ACCEPTED", [n for n in own if n != old]
        else:
            others = [n for n in own if n != old]
            why = "DUPLICATE_KEY" if old in own and new in others else "ACCEPTED"
            if why == "ACCEPTED":
                names[r["matricula_func"]] = [new if n == old else n for n in own]
        exp[r["seq"]] = why
    assert got == exp
    assert {"ACCEPTED", "DEPENDENT_LIMIT", "INVALID_KINSHIP", "UNKNOWN_EMPLOYEE"} <= set(got.values())
