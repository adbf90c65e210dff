"""Read-only reports over a ``Bank`` snapshot.

Joins are left to Catalyst/AQE: dimension tables (branches, employees) are
broadcast by AQE only when their measured size is under
``spark.sql.autoBroadcastJoinThreshold``; otherwise the join stays a
shuffle join. Aggregates are partial (map-side) before their shuffle, so a
hot account never lands whole in one task. Sorts are part of each report
(the reference orders every result); callers that only need the rows can
drop the final ``orderBy``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.exprs import age_years, ci_ai, enum_rank, money, money_out, since, window_start
from ledgerlake.schema import CARGO, ROLE, TIPO_CONTA, Bank

CHECKING = "conta-corrente"


# ------------------------------------------------------------------ A5, A6

def v_accounts_by_manager(b: Bank) -> DataFrame:
    """A5: account x holder x customer (the manager's view)."""
    c = b.conta.select("matricula_gerente", "num_conta", "tipo_conta", "saldo")
    tc = b.titularidade_conta.select("num_conta", "cpf_cliente")
    cl = b.cliente.select(F.col("cpf"), "nome_completo")
    return (c.join(tc, "num_conta")
             .join(cl, tc.cpf_cliente == cl.cpf)
             .select("matricula_gerente", "num_conta", "tipo_conta", "saldo", "cpf", "nome_completo"))


def v_statement(b: Bank) -> DataFrame:
    """The statement view (5 of the 6 transaction columns)."""
    return b.transacao.select("num_conta", "num_transacao", "tipo", "data_hora", "valor")


# -------------------------------------------------------------------- B1-B7

def overdrawn_special(b: Bank) -> DataFrame:
    """B1: special accounts in the red, most negative first."""
    return (b.conta.where((F.col("tipo_conta") == "conta especial") & (F.col("saldo") < 0))
            .select("num_conta", "saldo", "limite_credito")
            .orderBy(F.col("saldo").asc()))


def positive_savings(b: Bank) -> DataFrame:
    """B2: savings accounts with a positive balance, largest first."""
    return (b.conta.where((F.col("tipo_conta") == "poupança") & (F.col("saldo") > 0))
            .select("num_conta", "saldo")
            .orderBy(F.col("saldo").desc()))


def customers_by_city(b: Bank, city: str, as_of: str | dt.datetime) -> DataFrame:
    """Customers of a city (case/accent-insensitive match) with age, youngest first."""
    return (b.cliente.where(ci_ai("cidade") == F.lit(city))
            .select("nome_completo", "tipo_logradouro", "nome_logradouro", "numero", "bairro",
                    age_years("data_nascimento", as_of).alias("idade"), "cpf")
            .orderBy("idade", "cpf").drop("cpf"))


def branches_by_city(b: Bank, city: str) -> DataFrame:
    """Branches of a city by stored payroll, largest first."""
    return (b.agencia.where(ci_ai("cidade") == F.lit(city))
            .select("nome_ag", "sal_total")
            .orderBy(F.col("sal_total").desc()))


def branch_accounts(b: Bank, num_ag: int) -> DataFrame:
    """Accounts (number, type, balance) of one branch."""
    return (b.conta.where(F.col("num_ag") == num_ag)
            .select("num_conta", "tipo_conta", "saldo")
            .orderBy("num_conta"))


def statement(b: Bank, num_conta: int | None = None, accounts: DataFrame | None = None) -> DataFrame:
    """Statement of one account (or of a set of accounts), newest first."""
    v = v_statement(b)
    if num_conta is not None:
        v = v.where(F.col("num_conta") == num_conta)
    if accounts is not None:
        v = v.join(accounts.select("num_conta").distinct(), "num_conta", "left_semi")
    return v.orderBy(F.col("data_hora").desc())


def lookup(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Bulk key lookup: rows of ``table`` whose key columns appear in ``keys``."""
    return table.join(keys.distinct(), list(keys.columns), "left_semi")


# ------------------------------------------------------------------- C1-C11

def employees_with_dependents(b: Bank, num_ag: int) -> DataFrame:
    """Employees of a branch with their dependent count (zero kept), by name.

    Dependents are pre-aggregated per employee before the join (the grouping
    key functionally determines the employee columns).
    """
    deps = (b.dependente.groupBy(F.col("matricula_func").alias("matricula"))
            .agg(F.count("nome_completo").alias("dependentes")))
    f = b.funcionario.where(F.col("num_ag") == num_ag)
    return (f.join(deps, "matricula", "left")
            .select("nome_completo", "cargo", "tipo_logradouro", "nome_logradouro", "numero", "cidade",
                    "salario", F.coalesce("dependentes", F.lit(0)).alias("dependentes"))
            .orderBy(ci_ai("nome_completo")))


def customers_of_branch(b: Bank, num_ag: int) -> DataFrame:
    """Customers and accounts of a branch, by account type (enum order)."""
    c = b.conta.where(F.col("num_ag") == num_ag).select("num_conta", "tipo_conta")
    return (b.cliente.select("cpf", "nome_completo")
            .join(b.titularidade_conta, F.col("cpf") == F.col("cpf_cliente"))
            .join(c, "num_conta")
            .select("nome_completo", "cpf", "num_conta", "tipo_conta")
            .orderBy(enum_rank("tipo_conta", TIPO_CONTA), "num_conta", "cpf"))


def accounts_of_customer(b: Bank, cpf: str) -> DataFrame:
    """A customer's accounts with branch name and manager name."""
    tc = b.titularidade_conta.where(F.col("cpf_cliente") == cpf).select("num_conta")
    a = b.agencia.select("num_ag", "nome_ag")
    f = b.funcionario.select(F.col("matricula").alias("matricula_gerente"), F.col("nome_completo").alias("gerente"))
    return (b.conta.join(tc, "num_conta")
            .join(a, "num_ag")
            .join(f, "matricula_gerente")
            .select("num_conta", "tipo_conta", "nome_ag", "gerente", "saldo"))


def co_holders(b: Bank, cpf: str | None = None) -> DataFrame:
    """C4: other holders of the same accounts.

    With ``cpf`` the first side is filtered to that customer's holdings
    before the join. Without it, the bulk form returns every
    (cpf, co-holder) pair. Each account has at most two holder slots
    (``UNIQUE(num_conta, tipo_titular)`` over a two-value enum, audited by
    ``check_holders``), so the self-join emits at most two rows per account.
    """
    tc1 = b.titularidade_conta.select("num_conta", F.col("cpf_cliente").alias("cpf_base"))
    if cpf is not None:
        tc1 = tc1.where(F.col("cpf_base") == cpf)
    tc2 = b.titularidade_conta.select("num_conta", F.col("cpf_cliente").alias("cpf_co"))
    pairs = (tc1.join(tc2, "num_conta")
             .where(F.col("cpf_base") != F.col("cpf_co"))
             .select("cpf_base", "cpf_co").distinct())
    cl = b.cliente.select("cpf", "nome_completo")
    out = pairs.join(cl, pairs.cpf_co == cl.cpf)
    if cpf is not None:
        return out.select("nome_completo", "cpf")
    return out.select("cpf_base", F.col("cpf").alias("cpf_co"), F.col("nome_completo").alias("nome_co"))


def employees_by_city(b: Bank, city: str) -> DataFrame:
    """Employees of a city's branches by branch, role (enum order), salary desc."""
    a = b.agencia.where(ci_ai("cidade") == F.lit(city)).select("num_ag", "nome_ag")
    return (b.funcionario.join(a, "num_ag")
            .orderBy("num_ag", enum_rank("cargo", CARGO), F.col("salario").desc())
            .select("nome_completo", "cargo", "salario", "nome_ag"))


def managed_accounts(b: Bank, matricula: str | None = None) -> DataFrame:
    """Distinct (account, holder name), all or one manager's."""
    c = b.conta.select("num_conta", "matricula_gerente")
    if matricula is not None:
        c = c.where(F.col("matricula_gerente") == matricula)
    return (c.join(b.titularidade_conta.select("num_conta", "cpf_cliente"), "num_conta")
            .join(b.cliente.select("cpf", "nome_completo"), F.col("cpf_cliente") == F.col("cpf"))
            .select("num_conta", "nome_completo").distinct()
            .orderBy("num_conta"))


def manager_report(b: Bank, matricula: str | None = None) -> DataFrame:
    """The manager view, all (admin) or one manager's, by account."""
    v = v_accounts_by_manager(b)
    if matricula is not None:
        v = v.where(F.col("matricula_gerente") == matricula)
    return v.orderBy("num_conta")


def account_profile(b: Bank) -> DataFrame:
    """C11: every account with its first holder, the holder's data, one e-mail and one phone.

    The screen takes an arbitrary ``LIMIT 1`` contact; here it is the lowest
    value per customer (deterministic, V2), computed by a partial aggregate.
    """
    first = (b.titularidade_conta.where(F.col("tipo_titular") == "1º titular")
             .groupBy("num_conta").agg(F.min("cpf_cliente").alias("cpf")))
    email = b.email_cliente.groupBy(F.col("cpf_cliente").alias("cpf")).agg(F.min("email").alias("email"))
    phone = b.telefone_cliente.groupBy(F.col("cpf_cliente").alias("cpf")).agg(F.min("telefone").alias("telefone"))
    cl = b.cliente.select("cpf", "nome_completo", "data_nascimento", "cidade")
    return (b.conta.select("num_conta", "tipo_conta", "saldo", "taxa_juros", "limite_credito", "num_ag",
                           "matricula_gerente")
            .join(first, "num_conta", "left")
            .join(cl, "cpf", "left")
            .join(email, "cpf", "left")
            .join(phone, "cpf", "left")
            .select("num_conta", "tipo_conta", "saldo", "taxa_juros", "limite_credito", "num_ag",
                    "matricula_gerente", "cpf", "nome_completo", "data_nascimento", "cidade", "email", "telefone"))


# -------------------------------------------------------------------- D1-D6

def _recent(b: Bank, as_of, days: int) -> DataFrame:
    return recent_transactions(b.transacao, as_of, days)


def recent_transactions(t: DataFrame, as_of, days: int) -> DataFrame:
    """Rows with ``data_hora >= as_of - days``; when the log is stored by month (``ano_mes``), the
    same bound on the month column prunes older partitions before any file is read."""
    out = t.where(since("data_hora", as_of, days))
    if "ano_mes" in t.columns:
        start = (as_of if not isinstance(as_of, str) else dt.datetime.fromisoformat(as_of)) - dt.timedelta(days=days)
        out = out.where(F.col("ano_mes") >= start.year * 100 + start.month)
    return out


def activity_count(b: Bank, as_of, days: int, limit: int | None = None) -> DataFrame:
    """Transactions per checking account in the trailing window, busiest first."""
    checking = b.conta.where(F.col("tipo_conta") == CHECKING).select("num_conta")
    out = (_recent(b, as_of, days).join(checking, "num_conta", "left_semi")
           .groupBy("num_conta").agg(F.count("id_transacao").alias("total"))
           .orderBy(F.col("total").desc()))
    return out.limit(limit) if limit else out


def activity_volume(b: Bank, as_of, days: int, limit: int | None = None) -> DataFrame:
    """Summed amount per account in the trailing window (all kinds, unsigned), largest first."""
    out = (_recent(b, as_of, days).groupBy("num_conta")
           .agg(money_out(F.sum(money("valor"))).alias("volume"))
           .orderBy(F.col("volume").desc()))
    return out.limit(limit) if limit else out


def customer_activity_count(b: Bank, cpf: str | None, as_of, days: int) -> DataFrame:
    """D3: D1 restricted to one customer's accounts (or, with ``cpf=None``, per (cpf, account))."""
    tc = b.titularidade_conta.select("num_conta", "cpf_cliente")
    if cpf is not None:
        tc = tc.where(F.col("cpf_cliente") == cpf)
    checking = b.conta.where(F.col("tipo_conta") == CHECKING).select("num_conta")
    t = _recent(b, as_of, days).select("num_conta", "id_transacao")
    keys = ["num_conta"] if cpf is not None else ["cpf_cliente", "num_conta"]
    return (t.join(tc, "num_conta").join(checking, "num_conta")
            .groupBy(*keys).agg(F.count("id_transacao").alias("total"))
            .orderBy(F.col("total").desc()))


def customer_activity_volume(b: Bank, cpf: str | None, as_of, days: int) -> DataFrame:
    """D2 restricted to one customer's accounts (or per (cpf, account))."""
    tc = b.titularidade_conta.select("num_conta", "cpf_cliente")
    if cpf is not None:
        tc = tc.where(F.col("cpf_cliente") == cpf)
    t = _recent(b, as_of, days).select("num_conta", "valor")
    keys = ["num_conta"] if cpf is not None else ["cpf_cliente", "num_conta"]
    return (t.join(tc, "num_conta")
            .groupBy(*keys).agg(money_out(F.sum(money("valor"))).alias("volume"))
            .orderBy(F.col("volume").desc()))


def activity_profile(b: Bank, as_of, days: tuple[int, ...] = (7, 30, 365)) -> DataFrame:
    """Counts and volumes for all windows in one scan (conditional aggregates).

    One row per account with at least one transaction in the widest window;
    the scan filter is the widest lower bound, so Parquet row groups older
    than it are skipped.
    """
    widest = max(days)
    t = recent_transactions(b.transacao, as_of, widest).select("num_conta", "data_hora", "valor")
    aggs: list[Column] = []
    for d in days:
        aggs.append(F.count_if(F.col("data_hora") >= window_start(as_of, d)).alias(f"count_{d}"))
    for d in days:
        aggs.append(money_out(F.coalesce(F.sum(F.when(F.col("data_hora") >= window_start(as_of, d), money("valor"))),
                                         F.lit(0).cast("decimal(18,2)"))).alias(f"volume_{d}"))
    per = t.groupBy("num_conta").agg(*aggs)
    return per.join(b.conta.select("num_conta", "tipo_conta"), "num_conta", "left")


def branch_payroll(b: Bank) -> DataFrame:
    """Payroll per branch recomputed from employees; branches without staff give 0."""
    pay = b.funcionario.groupBy("num_ag").agg(F.sum(money("salario")).alias("s"))
    return (b.agencia.select("num_ag", "nome_ag").join(pay, "num_ag", "left")
            .select("num_ag", "nome_ag", money_out(F.coalesce("s", F.lit(0).cast("decimal(18,2)"))).alias("sal_total_calc")))


def accounts_per_branch(b: Bank) -> DataFrame:
    """Accounts held per (customer, branch)."""
    return (b.titularidade_conta.join(b.conta.select("num_conta", "num_ag"), "num_conta")
            .groupBy("cpf_cliente", "num_ag").agg(F.count(F.lit(1)).alias("n_contas")))


def dependents_per_employee(b: Bank) -> DataFrame:
    """Dependents per employee."""
    return b.dependente.groupBy("matricula_func").agg(F.count(F.lit(1)).alias("n_dependentes"))


# ---------------------------------------------------------------------- F4

def user_directory(b: Bank) -> DataFrame:
    """users, highest role first, then name. The secret column never appears."""
    return (b.usuario.select("id", "username", "nome", "role", "cpf", "matricula")
            .orderBy(enum_rank("role", ROLE).desc(), ci_ai("nome").asc()))


def first_by_key(df: DataFrame, key: list[str], order: str, cols: list[str]) -> DataFrame:
    """one row per key, the one with the lowest ``order`` (deterministic stand-in for LIMIT 1)."""
    others = [c for c in cols if c not in key]
    return df.groupBy(*key).agg(*[(F.min(c) if c == order else F.min_by(c, order)).alias(c) for c in others])
