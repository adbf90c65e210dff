"""Integrity rules as validators that return the violating rows.

Every check is one pass of filters, partial aggregates or anti-joins; none
collects rows to the driver.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.exprs import money, money_out, signed_amount
from ledgerlake.operators.reports import branch_payroll
from ledgerlake.schema import ENUM_COLUMNS, MAX_LENGTHS, SALARY_FLOOR, TABLES, Bank


def check_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """Key values held by more than one row (UNIQUE ignores rows with a NULL key part)."""
    not_null = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return (df.where(not_null).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def check_fk(child: DataFrame, parent: DataFrame, child_cols: list[str], parent_cols: list[str]) -> DataFrame:
    """Child rows whose (non-NULL) reference has no parent row."""
    not_null = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in child_cols])
    keys = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_cols, child_cols)]).distinct()
    return child.where(not_null).join(keys, child_cols, "left_anti")


def check_schema(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """NOT NULL, ENUM-domain and length rules of ``table`` in one pass.

    Returns one row per (row key, failed rule), tagged ``origem='db'`` (rules the database enforces).
    """
    schema = TABLES[table]
    rules = []
    for f in schema.fields:
        if not f.nullable and f.name in df.columns:
            rules.append((f"not_null:{f.name}", F.col(f.name).isNull()))
    for c, domain in ENUM_COLUMNS.get(table, {}).items():
        if c in df.columns:
            rules.append((f"enum:{c}", F.col(c).isNotNull() & ~F.col(c).isin(domain)))
    for c, n in MAX_LENGTHS.get(table, {}).items():
        if c in df.columns:
            rules.append((f"length:{c}", F.char_length(F.col(c)) > n))
    failed = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda x: x.isNotNull())
    row_key = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    return (df.select(row_key.alias("row_key"), failed.alias("failed"))
            .where(F.size("failed") > 0)
            .select(F.lit(table).alias("tabela"), "row_key", F.explode("failed").alias("rule"),
                    F.lit("db").alias("origem")))


def check_salary(funcionario: DataFrame) -> DataFrame:
    """Salary below the floor (CHECK salario >= 2286.00)."""
    return funcionario.where(F.col("salario") < SALARY_FLOOR).select("matricula", "salario")


def multi_account_violations(b: Bank) -> DataFrame:
    """Customers holding more than one account in the same branch (stored data)."""
    return (b.titularidade_conta.join(b.conta.select("num_conta", "num_ag"), "num_conta")
            .groupBy("cpf_cliente", "num_ag").agg(F.count(F.lit(1)).alias("n_contas"))
            .where(F.col("n_contas") > 1))


def check_holders(b: Bank) -> DataFrame:
    """Accounts with more than two holders or a holder slot used twice."""
    return (b.titularidade_conta.groupBy("num_conta")
            .agg(F.count(F.lit(1)).alias("n_titulares"), F.count_distinct("tipo_titular").alias("n_slots"))
            .where((F.col("n_titulares") > 2) | (F.col("n_titulares") > F.col("n_slots"))))


def check_fields(df: DataFrame, kind: str, key: list[str], today: dt.date | str) -> DataFrame:
    """Form-level field rules, one row per (row key, failed rule).

    kind: 'cliente' (cpf 11 digits, cep 8 digits, birth date in range),
    'conta' (rate 0..100, limit >= 0, balance >= 0), 'transacao' (amount >= 0.01).
    Tagged ``origem='app'``: these rules exist in the screens only, not in the database.
    """
    if isinstance(today, str):
        today = dt.date.fromisoformat(today[:10])
    c = F.col
    if kind == "cliente":
        rules = [("cpf_11_digitos", ~c("cpf").rlike(r"^[0-9]{11}$") | c("cpf").isNull()),
                 ("cep_8_digitos", c("cep").isNotNull() & ~c("cep").rlike(r"^[0-9]{8}$")),
                 ("nascimento_fora_do_intervalo",
                  (c("data_nascimento") < F.lit(dt.date(1900, 1, 1))) | (c("data_nascimento") > F.lit(today)))]
    elif kind == "conta":
        rules = [("taxa_fora_0_100", c("taxa_juros").isNotNull() & ((c("taxa_juros") < 0) | (c("taxa_juros") > 100))),
                 ("limite_negativo", c("limite_credito").isNotNull() & (c("limite_credito") < 0)),
                 ("saldo_inicial_negativo", c("saldo").isNotNull() & (c("saldo") < 0))]
    elif kind == "transacao":
        rules = [("valor_minimo", c("valor") < 0.01)]
    else:
        raise ValueError(kind)
    failed = F.filter(F.array(*[F.when(cond, F.lit(n)) for n, cond in rules]), lambda x: x.isNotNull())
    row_key = F.concat_ws("|", *[c(k).cast("string") for k in key])
    return (df.select(row_key.alias("row_key"), failed.alias("failed")).where(F.size("failed") > 0)
            .select(F.lit(kind).alias("tabela"), "row_key", F.explode("failed").alias("rule"),
                    F.lit("app").alias("origem")))


def reconcile_balances(b: Bank) -> DataFrame:
    """Stored balance vs the signed sum of the transaction log, per account (differences only)."""
    log = b.transacao.groupBy("num_conta").agg(F.sum(signed_amount()).alias("calc"))
    zero = F.lit(0).cast("decimal(18,2)")
    j = b.conta.select("num_conta", "saldo").join(log, "num_conta", "left")
    diff = money("saldo") - F.coalesce("calc", zero)
    return (j.where(diff != 0)
            .select("num_conta", "saldo", money_out(F.coalesce("calc", zero)).alias("saldo_calc"),
                    money_out(diff).alias("diferenca")))


def reconcile_payroll(b: Bank) -> DataFrame:
    """Stored branch payroll vs the recomputed one (differences only)."""
    calc = branch_payroll(b).select("num_ag", "sal_total_calc")
    diff = money("sal_total_calc") - F.coalesce(money("sal_total"), F.lit(0).cast("decimal(18,2)"))
    return (b.agencia.select("num_ag", "sal_total").join(calc, "num_ag")
            .where(diff != 0)
            .select("num_ag", "sal_total", "sal_total_calc", money_out(diff).alias("diferenca")))


def role_drift(b: Bank) -> DataFrame:
    """Users whose role disagrees with their employee row's cargo (admin over gerente is allowed)."""
    f = b.funcionario.select("matricula", "cargo")
    return (b.usuario.where(F.col("matricula").isNotNull()).select("username", "matricula", "role")
            .join(f, "matricula")
            .where((F.col("role") != F.col("cargo")) & ~((F.col("role") == "admin") & (F.col("cargo") == "gerente"))))


HEX64 = r"^[0-9a-f]{64}$"


def unhashed_secrets(b: Bank) -> DataFrame:
    """Stored secrets that are not a 64-hex digest (keys only, never the secret)."""
    parts = [
        b.funcionario.where(~F.col("senha").rlike(HEX64)).select(F.lit("funcionario").alias("tabela"),
                                                                F.col("matricula").alias("chave")),
        b.conta.where(~F.col("senha").rlike(HEX64)).select(F.lit("conta").alias("tabela"),
                                                          F.col("num_conta").cast("string").alias("chave")),
        b.usuario.where(~F.col("senha").rlike(HEX64)).select(F.lit("usuario").alias("tabela"),
                                                            F.col("username").alias("chave")),
    ]
    return reduce(DataFrame.unionByName, parts)
