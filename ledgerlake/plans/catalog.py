"""Registered queries over the driver's tables, with their DuckDB oracles.

``QUERIES[name](spark, sf_dir)`` builds the Spark DataFrame; ``ORACLE[name]``
is the same question in SQL, run by DuckDB over the raw tables with the
fixture views prepended as CTEs (``oracle_with``). Queries whose semantics
are order-dependent folds (posting, greedy acceptance, streams) have no SQL
text; tests check them against sequential Python models instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import reports as R
from ledgerlake.schema import TABLES
from ledgerlake.session import ship_package, shuffled
from ledgerlake.sources.fixture import AS_OF, PARAMS, Fixture, oracle_with

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

P = PARAMS
TS = f"TIMESTAMP '{AS_OF}'"
AS_OF_DATE = AS_OF[:10]


def _run(fn: Callable[[Fixture], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)  # Python workers must be able to import the package
    return fn(Fixture(spark, sf_dir))


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Fixture], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _run(fn, spark, sf_dir)
        if sql is not None:
            ORACLE[name] = oracle_with(sql)
        return fn

    return deco


def bank(fx: Fixture):
    return fx.bank()


# ------------------------------------------------------------------ reports

register("overdrawn_special",
         "SELECT num_conta, saldo, limite_credito FROM conta WHERE tipo_conta = 'conta especial' AND saldo < 0")(
    lambda fx: R.overdrawn_special(bank(fx)))

register("positive_savings",
         "SELECT num_conta, saldo FROM conta WHERE tipo_conta = 'poupança' AND saldo > 0")(
    lambda fx: R.positive_savings(bank(fx)))

_AGE_SQL = (f"CAST(year(DATE '{AS_OF_DATE}') - year(data_nascimento) - CASE WHEN month(data_nascimento) * 100 "
            f"+ day(data_nascimento) > {int(AS_OF_DATE[5:7]) * 100 + int(AS_OF_DATE[8:10])} THEN 1 ELSE 0 END AS INT)")

register("customers_by_city",
         f"SELECT nome_completo, tipo_logradouro, nome_logradouro, numero, bairro, {_AGE_SQL} AS idade "
         f"FROM cliente WHERE cidade COLLATE NOCASE.NOACCENT = '{P['city']}'")(
    lambda fx: R.customers_by_city(bank(fx), P["city"], AS_OF))

register("branches_by_city",
         f"SELECT nome_ag, sal_total FROM agencia WHERE cidade COLLATE NOCASE.NOACCENT = '{P['city']}'")(
    lambda fx: R.branches_by_city(bank(fx), P["city"]))

register("branch_accounts",
         f"SELECT num_conta, tipo_conta, saldo FROM conta WHERE num_ag = {P['branch']}")(
    lambda fx: R.branch_accounts(bank(fx), P["branch"]))

register("statement",
         f"SELECT num_conta, num_transacao, tipo, data_hora, valor FROM transacao WHERE num_conta = {P['account']}")(
    lambda fx: R.statement(bank(fx), P["account"]))

_A5_SQL = ("SELECT c.matricula_gerente, c.num_conta, c.tipo_conta, c.saldo, cl.cpf, cl.nome_completo "
           "FROM conta c JOIN titularidade_conta tc ON c.num_conta = tc.num_conta "
           "JOIN cliente cl ON tc.cpf_cliente = cl.cpf")

register("v_accounts_by_manager", _A5_SQL)(lambda fx: R.v_accounts_by_manager(bank(fx)))

register("v_statement", "SELECT num_conta, num_transacao, tipo, data_hora, valor FROM transacao")(
    lambda fx: R.v_statement(bank(fx)))

register("employees_with_dependents",
         "SELECT f.nome_completo, f.cargo, f.tipo_logradouro, f.nome_logradouro, f.numero, f.cidade, f.salario, "
         "COUNT(d.nome_completo) AS dependentes FROM funcionario f "
         "LEFT JOIN dependente d ON f.matricula = d.matricula_func "
         f"WHERE f.num_ag = {P['employee_branch']} "
         "GROUP BY f.matricula, f.nome_completo, f.cargo, f.tipo_logradouro, f.nome_logradouro, f.numero, "
         "f.cidade, f.salario")(
    lambda fx: R.employees_with_dependents(bank(fx), P["employee_branch"]))

register("customers_of_branch",
         "SELECT cl.nome_completo, cl.cpf, c.num_conta, c.tipo_conta FROM cliente cl "
         "JOIN titularidade_conta tc ON cl.cpf = tc.cpf_cliente JOIN conta c ON tc.num_conta = c.num_conta "
         f"WHERE c.num_ag = {P['branch']}")(
    lambda fx: R.customers_of_branch(bank(fx), P["branch"]))

register("accounts_of_customer",
         "SELECT c.num_conta, c.tipo_conta, a.nome_ag, f.nome_completo AS gerente, c.saldo FROM conta c "
         "JOIN titularidade_conta tc ON c.num_conta = tc.num_conta JOIN agencia a ON c.num_ag = a.num_ag "
         f"JOIN funcionario f ON c.matricula_gerente = f.matricula WHERE tc.cpf_cliente = '{P['coholder_cpf']}'")(
    lambda fx: R.accounts_of_customer(bank(fx), P["coholder_cpf"]))

register("co_holders",
         "SELECT DISTINCT cl.nome_completo, cl.cpf FROM titularidade_conta tc1 "
         "JOIN titularidade_conta tc2 ON tc1.num_conta = tc2.num_conta AND tc1.cpf_cliente <> tc2.cpf_cliente "
         f"JOIN cliente cl ON tc2.cpf_cliente = cl.cpf WHERE tc1.cpf_cliente = '{P['coholder_cpf']}'")(
    lambda fx: R.co_holders(bank(fx), P["coholder_cpf"]))

register("co_holders_all",
         "SELECT DISTINCT tc1.cpf_cliente AS cpf_base, cl.cpf AS cpf_co, cl.nome_completo AS nome_co "
         "FROM titularidade_conta tc1 "
         "JOIN titularidade_conta tc2 ON tc1.num_conta = tc2.num_conta AND tc1.cpf_cliente <> tc2.cpf_cliente "
         "JOIN cliente cl ON tc2.cpf_cliente = cl.cpf")(
    lambda fx: R.co_holders(bank(fx)))

register("employees_by_city",
         "SELECT f.nome_completo, f.cargo, f.salario, a.nome_ag FROM funcionario f "
         f"JOIN agencia a ON f.num_ag = a.num_ag WHERE a.cidade COLLATE NOCASE.NOACCENT = '{P['city']}'")(
    lambda fx: R.employees_by_city(bank(fx), P["city"]))

register("managed_accounts",
         "SELECT DISTINCT c.num_conta, cl.nome_completo FROM conta c "
         "JOIN titularidade_conta tc ON c.num_conta = tc.num_conta JOIN cliente cl ON tc.cpf_cliente = cl.cpf")(
    lambda fx: R.managed_accounts(bank(fx)))

register("manager_report", f"SELECT * FROM ({_A5_SQL}) v WHERE matricula_gerente = '{P['manager']}'")(
    lambda fx: R.manager_report(bank(fx), P["manager"]))

register("account_profile",
         "SELECT c.num_conta, c.tipo_conta, c.saldo, c.taxa_juros, c.limite_credito, c.num_ag, "
         "c.matricula_gerente, f.cpf, cl.nome_completo, cl.data_nascimento, cl.cidade, e.email, p.telefone "
         "FROM conta c "
         "LEFT JOIN (SELECT num_conta, min(cpf_cliente) AS cpf FROM titularidade_conta "
         "           WHERE tipo_titular = '1º titular' GROUP BY num_conta) f ON c.num_conta = f.num_conta "
         "LEFT JOIN cliente cl ON f.cpf = cl.cpf "
         "LEFT JOIN (SELECT cpf_cliente, min(email) AS email FROM email_cliente GROUP BY cpf_cliente) e "
         "       ON e.cpf_cliente = f.cpf "
         "LEFT JOIN (SELECT cpf_cliente, min(telefone) AS telefone FROM telefone_cliente GROUP BY cpf_cliente) p "
         "       ON p.cpf_cliente = f.cpf")(
    lambda fx: R.account_profile(bank(fx)))

for _d in (7, 30, 365):
    _since = f"data_hora >= {TS} - INTERVAL {_d} DAY"
    register(f"activity_count_{_d}",
             f"SELECT num_conta, COUNT(id_transacao) AS total FROM transacao WHERE {_since} "
             "AND num_conta IN (SELECT num_conta FROM conta WHERE tipo_conta = 'conta-corrente') GROUP BY num_conta")(
        lambda fx, d=_d: R.activity_count(bank(fx), AS_OF, d))
    register(f"activity_volume_{_d}",
             "SELECT num_conta, CAST(SUM(CAST(valor AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM transacao "
             f"WHERE {_since} GROUP BY num_conta")(
        lambda fx, d=_d: R.activity_volume(bank(fx), AS_OF, d))
    register(f"customer_activity_count_{_d}",
             "SELECT t.num_conta, COUNT(t.id_transacao) AS total FROM transacao t "
             "JOIN titularidade_conta tc ON t.num_conta = tc.num_conta JOIN conta c ON t.num_conta = c.num_conta "
             f"WHERE tc.cpf_cliente = '{P['activity_cpf']}' AND c.tipo_conta = 'conta-corrente' "
             f"AND t.{_since} GROUP BY t.num_conta")(
        lambda fx, d=_d: R.customer_activity_count(bank(fx), P["activity_cpf"], AS_OF, d))
    register(f"customer_activity_volume_{_d}",
             "SELECT t.num_conta, CAST(SUM(CAST(t.valor AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM transacao t "
             f"JOIN titularidade_conta tc ON t.num_conta = tc.num_conta WHERE tc.cpf_cliente = '{P['activity_cpf']}' "
             f"AND t.{_since} GROUP BY t.num_conta")(
        lambda fx, d=_d: R.customer_activity_volume(bank(fx), P["activity_cpf"], AS_OF, d))

_prof_cols = ", ".join(
    [f"COUNT(CASE WHEN t.data_hora >= {TS} - INTERVAL {d} DAY THEN 1 END) AS count_{d}" for d in (7, 30, 365)]
    + [f"CAST(COALESCE(SUM(CASE WHEN t.data_hora >= {TS} - INTERVAL {d} DAY "
       f"THEN CAST(t.valor AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS volume_{d}" for d in (7, 30, 365)])
register("activity_profile",
         f"SELECT p.*, c.tipo_conta FROM (SELECT t.num_conta, {_prof_cols} FROM transacao t "
         f"WHERE t.data_hora >= {TS} - INTERVAL 365 DAY GROUP BY t.num_conta) p "
         "LEFT JOIN conta c ON p.num_conta = c.num_conta")(
    lambda fx: R.activity_profile(bank(fx), AS_OF))

register("branch_payroll",
         "SELECT a.num_ag, a.nome_ag, CAST(COALESCE(SUM(CAST(f.salario AS DECIMAL(18,2))), 0) AS DOUBLE) "
         "AS sal_total_calc FROM agencia a LEFT JOIN funcionario f ON f.num_ag = a.num_ag GROUP BY a.num_ag, a.nome_ag")(
    lambda fx: R.branch_payroll(bank(fx)))

register("user_directory", "SELECT id, username, nome, role, cpf, matricula FROM usuario")(
    lambda fx: R.user_directory(bank(fx)))


# --------------------------------------------------------- integrity audits

from ledgerlake.functions import exprs as X  # noqa: E402
from ledgerlake.functions.formatting import format_dates  # noqa: E402
from ledgerlake.operators import access as N  # noqa: E402
from ledgerlake.operators import quality as Q  # noqa: E402
from ledgerlake.schema import CREDIT_KINDS, DEBIT_KINDS, ENUM_COLUMNS, MAX_LENGTHS, TABLES  # noqa: E402


def _in_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


register("check_unique",
         "SELECT matricula_func, nome_completo, COUNT(*) AS n FROM dependente "
         "WHERE matricula_func IS NOT NULL AND nome_completo IS NOT NULL "
         "GROUP BY matricula_func, nome_completo HAVING COUNT(*) > 1")(
    lambda fx: Q.check_unique(fx.bank().dependente, ["matricula_func", "nome_completo"]))

register("check_fk",
         "SELECT d.* FROM dependente_dirty d WHERE d.matricula_func IS NOT NULL "
         "AND NOT EXISTS (SELECT 1 FROM funcionario f WHERE f.matricula = d.matricula_func)")(
    lambda fx: Q.check_fk(fx.view("dependente_dirty"), fx.bank().funcionario, ["matricula_func"], ["matricula"]))

_SCHEMA_CHECKS = [("conta", ["num_conta"]), ("funcionario", ["matricula"]), ("cliente", ["cpf"]),
                  ("titularidade_conta", ["num_conta", "cpf_cliente"])]


def _schema_oracle() -> str:
    parts = []
    for table, key in _SCHEMA_CHECKS:
        rk = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
        rules = [(f"not_null:{f.name}", f"{f.name} IS NULL") for f in TABLES[table].fields if not f.nullable]
        rules += [(f"enum:{c}", f"{c} IS NOT NULL AND {c} NOT IN ({_in_list(d)})")
                  for c, d in ENUM_COLUMNS.get(table, {}).items()]
        rules += [(f"length:{c}", f"length({c}) > {n}") for c, n in MAX_LENGTHS.get(table, {}).items()]
        for name, cond in rules:
            parts.append(f"SELECT '{table}' AS tabela, {rk} AS row_key, '{name}' AS rule, 'db' AS origem "
                         f"FROM {table} WHERE {cond}")
    return " UNION ALL ".join(parts)


def _schema_spark(fx: Fixture):
    from functools import reduce as _reduce

    b = fx.bank()
    return _reduce(DataFrame.unionByName, [Q.check_schema(getattr(b, t), t, k) for t, k in _SCHEMA_CHECKS])


register("check_schema", _schema_oracle())(_schema_spark)

register("check_salary", "SELECT matricula, salario FROM funcionario_dirty WHERE salario < 2286")(
    lambda fx: Q.check_salary(fx.view("funcionario_dirty")))

register("multi_account_violations",
         "SELECT tc.cpf_cliente, c.num_ag, COUNT(*) AS n_contas FROM titularidade_conta tc "
         "JOIN conta c ON tc.num_conta = c.num_conta GROUP BY tc.cpf_cliente, c.num_ag HAVING COUNT(*) > 1")(
    lambda fx: Q.multi_account_violations(fx.bank()))

register("check_holders",
         "SELECT num_conta, COUNT(*) AS n_titulares, COUNT(DISTINCT tipo_titular) AS n_slots "
         "FROM titularidade_conta GROUP BY num_conta "
         "HAVING COUNT(*) > 2 OR COUNT(*) > COUNT(DISTINCT tipo_titular)")(
    lambda fx: Q.check_holders(fx.bank()))

_FIELDS_ORACLE = " UNION ALL ".join([
    "SELECT 'cliente' AS tabela, cpf AS row_key, 'cpf_11_digitos' AS rule, 'app' AS origem FROM cliente "
    "WHERE cpf IS NULL OR NOT regexp_matches(cpf, '^[0-9]{11}$')",
    "SELECT 'cliente', cpf, 'cep_8_digitos', 'app' FROM cliente WHERE cep IS NOT NULL AND NOT regexp_matches(cep, '^[0-9]{8}$')",
    f"SELECT 'cliente', cpf, 'nascimento_fora_do_intervalo', 'app' FROM cliente "
    f"WHERE data_nascimento < DATE '1900-01-01' OR data_nascimento > DATE '{AS_OF_DATE}'",
    "SELECT 'conta', CAST(num_conta AS VARCHAR), 'taxa_fora_0_100', 'app' FROM conta "
    "WHERE taxa_juros IS NOT NULL AND (taxa_juros < 0 OR taxa_juros > 100)",
    "SELECT 'conta', CAST(num_conta AS VARCHAR), 'limite_negativo', 'app' FROM conta "
    "WHERE limite_credito IS NOT NULL AND limite_credito < 0",
    "SELECT 'conta', CAST(num_conta AS VARCHAR), 'saldo_inicial_negativo', 'app' FROM conta WHERE saldo IS NOT NULL AND saldo < 0",
])
register("check_fields", _FIELDS_ORACLE)(
    lambda fx: Q.check_fields(fx.bank().cliente, "cliente", ["cpf"], AS_OF).unionByName(
        Q.check_fields(fx.bank().conta, "conta", ["num_conta"], AS_OF)))

_SIGNED_SQL = (f"CASE WHEN tipo IN ({_in_list(DEBIT_KINDS)}) THEN -CAST(valor AS DECIMAL(18,2)) "
               f"WHEN tipo IN ({_in_list(CREDIT_KINDS)}) THEN CAST(valor AS DECIMAL(18,2)) "
               "ELSE CAST(0 AS DECIMAL(18,2)) END")
register("reconcile_balances",
         "SELECT c.num_conta, c.saldo, CAST(COALESCE(t.calc, 0) AS DOUBLE) AS saldo_calc, "
         "CAST(CAST(c.saldo AS DECIMAL(18,2)) - COALESCE(t.calc, 0) AS DOUBLE) AS diferenca FROM conta c "
         f"LEFT JOIN (SELECT num_conta, SUM({_SIGNED_SQL}) AS calc FROM transacao GROUP BY num_conta) t "
         "ON c.num_conta = t.num_conta WHERE CAST(c.saldo AS DECIMAL(18,2)) - COALESCE(t.calc, 0) <> 0")(
    lambda fx: Q.reconcile_balances(fx.bank()))

_PAYROLL_SQL = ("SELECT a.num_ag, a.nome_ag, CAST(COALESCE(SUM(CAST(f.salario AS DECIMAL(18,2))), 0) AS DOUBLE) "
                "AS sal_total_calc FROM agencia a LEFT JOIN funcionario f ON f.num_ag = a.num_ag "
                "GROUP BY a.num_ag, a.nome_ag")
register("reconcile_payroll",
         "SELECT a.num_ag, a.sal_total, p.sal_total_calc, CAST(CAST(p.sal_total_calc AS DECIMAL(18,2)) "
         "- COALESCE(CAST(a.sal_total AS DECIMAL(18,2)), 0) AS DOUBLE) AS diferenca "
         f"FROM agencia a JOIN ({_PAYROLL_SQL}) p ON a.num_ag = p.num_ag "
         "WHERE CAST(p.sal_total_calc AS DECIMAL(18,2)) - COALESCE(CAST(a.sal_total AS DECIMAL(18,2)), 0) <> 0")(
    lambda fx: Q.reconcile_payroll(fx.bank()))

register("role_drift",
         "SELECT u.matricula, u.username, u.role, f.cargo FROM usuario u JOIN funcionario f "
         "ON u.matricula = f.matricula WHERE u.role <> f.cargo AND NOT (u.role = 'admin' AND f.cargo = 'gerente')")(
    lambda fx: Q.role_drift(fx.bank()))

_HEX = "'^[0-9a-f]{64}$'"
register("unhashed_secrets",
         f"SELECT 'funcionario' AS tabela, matricula AS chave FROM funcionario WHERE NOT regexp_matches(senha, {_HEX}) "
         f"UNION ALL SELECT 'conta', CAST(num_conta AS VARCHAR) FROM conta WHERE NOT regexp_matches(senha, {_HEX}) "
         f"UNION ALL SELECT 'usuario', username FROM usuario WHERE NOT regexp_matches(senha, {_HEX})")(
    lambda fx: Q.unhashed_secrets(fx.bank()))


# ------------------------------------------------------------------- access

register("visible_accounts",
         "SELECT u.username, u.role, 'extrato' AS screen, 'conta' AS scope, tc.num_conta, CAST(NULL AS INT) AS num_ag FROM usuario u "
         "JOIN titularidade_conta tc ON tc.cpf_cliente = u.cpf WHERE u.role = 'client' "
         "UNION ALL SELECT u.username, u.role, CASE WHEN u.role = 'caixa' THEN 'extrato' ELSE 'saldos' END, 'agencia', CAST(NULL AS INT), f.num_ag FROM usuario u "
         "JOIN funcionario f ON f.matricula = u.matricula WHERE u.role IN ('caixa', 'atendente') "
         "UNION ALL SELECT u.username, u.role, 'gerencia', 'conta', c.num_conta, CAST(NULL AS INT) FROM usuario u "
         "JOIN conta c ON c.matricula_gerente = u.matricula WHERE u.role = 'gerente' "
         "UNION ALL SELECT username, role, 'extrato', 'todas', CAST(NULL AS INT), CAST(NULL AS INT) FROM usuario "
         "WHERE role = 'admin'")(
    lambda fx: N.visible_accounts(fx.bank()))

register("statements_for",
         "SELECT u.username, 'conta' AS scope, t.num_conta, t.num_transacao, t.tipo, t.data_hora, t.valor FROM usuario u "
         "JOIN titularidade_conta tc ON tc.cpf_cliente = u.cpf JOIN transacao t ON t.num_conta = tc.num_conta "
         "WHERE u.role = 'client' "
         "UNION ALL SELECT u.username, 'agencia', t.num_conta, t.num_transacao, t.tipo, t.data_hora, t.valor "
         "FROM usuario u JOIN funcionario f ON f.matricula = u.matricula JOIN conta c ON c.num_ag = f.num_ag "
         "JOIN transacao t ON t.num_conta = c.num_conta WHERE u.role = 'caixa' "
         "UNION ALL SELECT CAST(NULL AS STRING), 'todas', t.num_conta, t.num_transacao, t.tipo, t.data_hora, t.valor "
         "FROM transacao t WHERE EXISTS (SELECT 1 FROM usuario WHERE role = 'admin')")(
    lambda fx: N.statements_for(fx.bank(), fx.bank().usuario))

_REQ_COLS = "r.seq, r.solicitante, r.conta_origem, r.conta_destino, r.valor, r.num_trans_origem, r.num_trans_destino"
AUTHORIZE_SQL = (
    f"SELECT {_REQ_COLS}, CASE WHEN u.role IS NULL THEN 'USER_NOT_FOUND' "
    "WHEN u.role IN ('gerente', 'atendente') THEN 'ROLE_NOT_ALLOWED' "
    "WHEN u.role = 'client' AND NOT EXISTS (SELECT 1 FROM titularidade_conta tc "
    "     WHERE tc.num_conta = r.conta_origem AND tc.cpf_cliente = u.cpf) THEN 'NOT_HOLDER' "
    "WHEN u.role = 'caixa' AND (f.num_ag IS NULL OR o.num_ag IS NULL OR f.num_ag <> o.num_ag) THEN 'BRANCH_MISMATCH' "
    "WHEN r.valor IS NULL OR r.valor <= 0 THEN 'INVALID_AMOUNT' "
    "WHEN r.conta_origem = r.conta_destino THEN 'SAME_ACCOUNT' "
    "WHEN o.num_conta IS NULL OR d.num_conta IS NULL THEN 'UNKNOWN_ACCOUNT' END AS reason "
    "FROM transfer_req r LEFT JOIN usuario u ON u.username = r.solicitante "
    "LEFT JOIN funcionario f ON f.matricula = u.matricula "
    "LEFT JOIN conta o ON o.num_conta = r.conta_origem LEFT JOIN conta d ON d.num_conta = r.conta_destino")
register("authorize", AUTHORIZE_SQL)(lambda fx: N.authorize(fx.bank(), fx.view("transfer_req")))


# ------------------------------------------------------- scalar helpers (H)

register("format_dates",
         "SELECT num_conta, num_transacao, tipo, strftime(data_hora, '%d/%m/%Y') AS data_hora, valor FROM transacao")(
    lambda fx: format_dates(R.v_statement(fx.bank())))

_MASK_SQL = ("CASE WHEN {c} IS NULL OR {c} = '' THEN '' "
             "WHEN length(regexp_replace({c}, '[^0-9]', '', 'g')) = 11 THEN "
             "substr(regexp_replace({c}, '[^0-9]', '', 'g'), 1, 3) || '.' || "
             "substr(regexp_replace({c}, '[^0-9]', '', 'g'), 4, 3) || '.' || "
             "substr(regexp_replace({c}, '[^0-9]', '', 'g'), 7, 3) || '-' || "
             "substr(regexp_replace({c}, '[^0-9]', '', 'g'), 10, 2) ELSE {c} END")
_SHOWN_PHONE = "'(' || substr(telefone, 1, 2) || ') ' || substr(telefone, 3)"
register("normalize_identity",
         f"SELECT cpf_cliente, telefone, {_MASK_SQL.format(c='cpf_cliente')} AS cpf_fmt, "
         f"regexp_replace({_MASK_SQL.format(c='cpf_cliente')}, '[^0-9]', '', 'g') AS cpf_limpo, "
         f"substr(regexp_replace({_SHOWN_PHONE}, '[^0-9]', '', 'g'), 1, 11) AS telefone_limpo "
         "FROM telefone_cliente")(
    lambda fx: _normalize_identity(fx))


def _normalize_identity(fx: Fixture):
    from ledgerlake.functions.formatting import normalize_identity

    shown = fx.bank().telefone_cliente.select(
        "cpf_cliente", "telefone", X.cpf_mask("cpf_cliente").alias("cpf_fmt"),
        X.cpf_mask("cpf_cliente").alias("cpf_limpo"),
        F.concat(F.lit("("), F.substring("telefone", 1, 2), F.lit(") "),
                 F.substring("telefone", F.lit(3), F.char_length("telefone"))).alias("telefone_limpo"))
    # Masked CPFs and formatted phones (as typed on the screens) normalised back at ingest.
    return normalize_identity(shown, cpf_cols=("cpf_limpo",), phone_cols=("telefone_limpo",))


def _hash_secrets(fx: Fixture):
    from ledgerlake.functions.formatting import hash_secrets

    return hash_secrets(fx.bank().conta.select("num_conta", F.col("senha").alias("senha_hash")), ("senha_hash",))


register("hash_secrets", "SELECT num_conta, sha256(senha) AS senha_hash FROM conta")(_hash_secrets)


# ------------------------------------------------------------------- ledger

from ledgerlake.operators import ledger as K  # noqa: E402

_DEBIT_SQL = _in_list(DEBIT_KINDS)
_CREDIT_SQL = _in_list(CREDIT_KINDS)
_REJECT_SQL = ("COALESCE(x.tipo IN ({d}) AND ({bal} - x.v < a.floor), FALSE)")
_NEWBAL_SQL = ("CASE WHEN {rej} THEN {bal} WHEN x.tipo IN ({d}) THEN {bal} - x.v "
               "WHEN x.tipo IN ({c}) THEN {bal} + x.v ELSE {bal} END")


def _step(bal: str) -> tuple[str, str]:
    rej = _REJECT_SQL.format(d=_DEBIT_SQL, bal=bal)
    return rej, _NEWBAL_SQL.format(rej=rej, d=_DEBIT_SQL, c=_CREDIT_SQL, bal=bal)


_R1, _B1 = _step("a.s0")
_RN, _BN = _step("s.bal")
POST_SQL = f"""
, x AS (SELECT id_transacao, num_conta, tipo, valor, CAST(valor AS DECIMAL(18,2)) AS v,
              row_number() OVER (PARTITION BY num_conta ORDER BY id_transacao) AS rn FROM transacao),
a AS (SELECT num_conta, CAST(saldo AS DECIMAL(18,2)) AS s0, tipo_conta,
             CASE WHEN tipo_conta = 'conta especial' THEN -CAST(COALESCE(limite_credito, 0) AS DECIMAL(18,2))
                  ELSE CAST(0 AS DECIMAL(18,2)) END AS floor FROM conta),
steps AS (
  SELECT x.num_conta, x.rn, x.id_transacao, {_R1} AS rej, {_B1} AS bal
  FROM x JOIN a ON a.num_conta = x.num_conta WHERE x.rn = 1
  UNION ALL
  SELECT x.num_conta, x.rn, x.id_transacao, {_RN}, {_BN}
  FROM steps s JOIN x ON x.num_conta = s.num_conta AND x.rn = s.rn + 1 JOIN a ON a.num_conta = x.num_conta)
SELECT x.id_transacao, x.num_conta, x.tipo, x.valor,
       CASE WHEN NOT s.rej THEN 'ACCEPTED' WHEN a.tipo_conta = 'conta especial' THEN 'CREDIT_LIMIT_EXCEEDED'
            ELSE 'INSUFFICIENT_FUNDS' END AS status, CAST(s.bal AS DOUBLE) AS saldo_apos
FROM steps s JOIN x ON x.id_transacao = s.id_transacao JOIN a ON a.num_conta = s.num_conta
UNION ALL
SELECT x.id_transacao, x.num_conta, x.tipo, x.valor, 'UNKNOWN_ACCOUNT', CAST(NULL AS DOUBLE)
FROM x WHERE NOT EXISTS (SELECT 1 FROM conta c WHERE c.num_conta = x.num_conta)
"""


def _post_oracle() -> str:
    base = oracle_with("SELECT 1", ["conta", "transacao"]).rsplit("\nSELECT 1", 1)[0]
    return "WITH RECURSIVE" + base[len("WITH"):] + POST_SQL


def _post_spark(fx: Fixture):
    b = fx.bank()
    t = b.transacao.select("id_transacao", "num_conta", "tipo", "valor")
    return K.post(b.conta, t, seq="id_transacao").decisions


register("post")(_post_spark)
ORACLE["post"] = _post_oracle()


def _post_hot_account(fx: Fixture):
    """A third of all transactions on one account, which is cut into chunks of 1,024 ids and decided by chunk summaries."""
    b = fx.bank()
    t = b.transacao.select("id_transacao", F.when(F.col("id_transacao") % 3 == 0, F.lit(P["account"])).otherwise(F.col("num_conta"))
                           .cast("int").alias("num_conta"), "tipo", "valor")
    return K.post(b.conta, t, seq="id_transacao", chunk_span=1024).decisions


register("post_hot_account")(_post_hot_account)
ORACLE["post_hot_account"] = _post_oracle().replace("FROM transacao)", "FROM (SELECT * REPLACE (CAST(CASE WHEN id_transacao % 3 = 0 "
                                                    f"THEN {P['account']} ELSE num_conta END AS INT) AS num_conta) FROM transacao) t)", 1)

register("running_balance",
         f"SELECT id_transacao, num_conta, CAST(SUM({_SIGNED_SQL}) OVER (PARTITION BY num_conta "
         "ORDER BY id_transacao ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS saldo_corrente "
         "FROM transacao")(
    lambda fx: K.running_balance(fx.bank()))

from ledgerlake.operators import transfers as K2  # noqa: E402


def _singles(b):
    return b.transacao.where(F.col("tipo") != "transferência").select(
        F.col("id_transacao").alias("seq"), "num_conta", "tipo", "valor")


def _post_transfers(fx: Fixture, mode: str = "as_written"):
    b = fx.bank()
    out, _ = K2.run_transfers(b, _singles(b), fx.view("transfer_req"), mode)
    return out


def _post_transfer_chain(fx: Fixture):
    """Every account passes money to the next one: each transfer depends on the one before it (checking accounts of 100.00)."""
    n = F.col("num_conta")
    acc = fx.bank().conta.select(n, F.lit(100.0).alias("saldo"), F.lit("conta-corrente").alias("tipo_conta"),
                                 F.lit(None).cast("double").alias("limite_credito"))
    has_next = shuffled(acc.select((n - 1).alias("num_conta")))
    req = acc.join(has_next, "num_conta", "left_semi").select(
        n.cast("long").alias("seq"), n.alias("conta_origem"), (n + 1).alias("conta_destino"),
        (F.lit(40.0) + n.cast("long") * 7919 % 50).alias("valor"))
    done, _ = K2.post_transfers(acc, K2.build_legs(None, req))
    return K2.decisions(done)


register("post_transfer_chain")(_post_transfer_chain)
# As written, both accounts are debited, so only the balance that the transfer before leaves matters.
ORACLE["post_transfer_chain"] = "WITH RECURSIVE" + oracle_with("SELECT 1", ["conta"]).rsplit("\nSELECT 1", 1)[0][len("WITH"):] + """
, t AS (SELECT CAST(num_conta AS BIGINT) AS seq, 40 + CAST(num_conta AS BIGINT) * 7919 % 50 AS v FROM conta c
        WHERE EXISTS (SELECT 1 FROM conta n WHERE n.num_conta = c.num_conta + 1)),
r AS (SELECT seq, TRUE AS ok, 100 - v AS rest FROM t WHERE NOT EXISTS (SELECT 1 FROM t p WHERE p.seq = t.seq - 1)
  UNION ALL SELECT t.seq, t.v <= r.rest, CASE WHEN t.v <= r.rest THEN 100 - t.v ELSE 100 END FROM r JOIN t ON t.seq = r.seq + 1)
SELECT seq, 'transfer' AS kind, CASE WHEN ok THEN 'ACCEPTED' ELSE 'INSUFFICIENT_FUNDS' END AS status FROM r
"""
register("post_transfers")(_post_transfers)
register("post_transfers_double_entry")(lambda fx: _post_transfers(fx, "double_entry"))


# ------------------------------------------------------------------ changes

from ledgerlake.operators import changes as I  # noqa: E402
from ledgerlake.schema import CLIENTE  # noqa: E402

_CLIENTE_COLS = [f.name for f in CLIENTE.fields]


def _apply_updates(fx: Fixture):
    return I.apply_updates(fx.bank().cliente, fx.view("cliente_changes"), ["cpf"], ["bairro", "cidade"])


register("apply_updates",
         "SELECT " + ", ".join(
             f"CASE WHEN l.set_{c} THEN l.new_{c} ELSE c.{c} END AS {c}" if c in ("bairro", "cidade") else f"c.{c}"
             for c in _CLIENTE_COLS)
         + " FROM cliente c LEFT JOIN (SELECT cpf, "
           "max_by(bairro, seq) FILTER (WHERE bairro IS NOT NULL) AS new_bairro, "
           "bool_or(bairro IS NOT NULL) AS set_bairro, "
           "max_by(cidade, seq) FILTER (WHERE cidade IS NOT NULL) AS new_cidade, "
           "bool_or(cidade IS NOT NULL) AS set_cidade FROM cliente_changes GROUP BY cpf) l ON l.cpf = c.cpf")(
    _apply_updates)

register("upsert_contacts",
         "SELECT cpf_cliente, telefone, descricao FROM telefone_cliente UNION ALL "
         "SELECT r.cpf_cliente, r.telefone, r.descricao FROM (SELECT *, row_number() OVER "
         "(PARTITION BY cpf_cliente, telefone ORDER BY seq) AS rn FROM telefone_req) r "
         "WHERE r.rn = 1 AND NOT EXISTS (SELECT 1 FROM telefone_cliente t "
         "WHERE t.cpf_cliente = r.cpf_cliente AND t.telefone = r.telefone)")(
    lambda fx: I.upsert_contacts(fx.bank().telefone_cliente, fx.view("telefone_req"), ["cpf_cliente", "telefone"]))

register("delete_rows",
         "SELECT nome_completo, matricula_func, data_nascimento, parentesco, idade FROM dependente d "
         "WHERE NOT EXISTS (SELECT 1 FROM dependente k WHERE k.seq % 10 = 0 "
         "AND k.matricula_func = d.matricula_func AND k.nome_completo = d.nome_completo)")(
    lambda fx: I.delete_rows(fx.bank().dependente,
                             fx.view("dependente").where("seq % 10 = 0").select("matricula_func", "nome_completo")))

register("cascade_users",
         "SELECT * FROM usuario u WHERE NOT EXISTS (SELECT 1 FROM cliente c WHERE c.cpf = u.cpf "
         "AND CAST(c.rg_numero AS BIGINT) % 9 = 0) AND NOT EXISTS (SELECT 1 FROM funcionario f "
         "WHERE f.matricula = u.matricula AND CAST(f.cep AS BIGINT) % 5 = 0)")(
    lambda fx: I.cascade_users(fx.bank().usuario,
                               fx.bank().cliente.where("CAST(rg_numero AS BIGINT) % 9 = 0"),
                               fx.bank().funcionario.where("CAST(cep AS BIGINT) % 5 = 0")))

register("sync_users",
         "SELECT row_number() OVER (ORDER BY src, ord) AS id, username, nome, senha, role, cpf, matricula FROM ("
         "SELECT 0 AS src, matricula AS ord, matricula AS username, nome_completo AS nome, senha, cargo AS role, "
         "CAST(NULL AS VARCHAR) AS cpf, matricula FROM funcionario UNION ALL "
         "SELECT 1, c.cpf, c.cpf, c.nome_completo, COALESCE(s.s, 'hashsenha123'), 'client', c.cpf, CAST(NULL AS VARCHAR) "
         "FROM cliente c LEFT JOIN (SELECT tc.cpf_cliente AS cpf, arg_min(co.senha, co.num_conta) AS s "
         "FROM titularidade_conta tc JOIN conta co ON co.num_conta = tc.num_conta GROUP BY tc.cpf_cliente) s "
         "ON s.cpf = c.cpf UNION ALL "
         "SELECT 2, '', 'Admin', 'Administrador DBA', sha256('Root'), 'admin', CAST(NULL AS VARCHAR), "
         "CAST(NULL AS VARCHAR)) u")(
    lambda fx: I.sync_users(fx.bank()))


def _next_numbers(fx: Fixture):
    t = fx.bank().transacao
    cut = X.as_of_literal(AS_OF)
    req = t.where(F.col("data_hora") >= cut).select(F.col("id_transacao").alias("seq"), "num_conta")
    return I.assign_next(req, t.where(F.col("data_hora") < cut)).select("seq", "num_conta", "num_transacao")


register("next_numbers",
         "SELECT r.seq, r.num_conta, CAST(COALESCE(m.mx, 0) + row_number() OVER (PARTITION BY r.num_conta "
         "ORDER BY r.seq) AS INT) AS num_transacao FROM (SELECT id_transacao AS seq, num_conta FROM transacao "
         f"WHERE data_hora >= {TS}) r LEFT JOIN (SELECT num_conta, max(num_transacao) AS mx FROM transacao "
         f"WHERE data_hora < {TS} GROUP BY num_conta) m ON m.num_conta = r.num_conta")(_next_numbers)


def _global_numbers(fx: Fixture):
    b = fx.bank()
    req = b.cliente.select(F.col("rg_numero").cast("long").alias("seq"), "cpf")
    return I.assign_global(req, I.next_account_base(b.conta).scalar(), out="num_conta_nova")


register("global_numbers",
         "SELECT seq, cpf, (SELECT CASE WHEN COALESCE(max(num_conta), 0) = 0 THEN 50501 ELSE max(num_conta) END "
         "FROM conta) + row_number() OVER (ORDER BY seq) AS num_conta_nova FROM "
         "(SELECT CAST(rg_numero AS BIGINT) AS seq, cpf FROM cliente) r")(
    _global_numbers)

register("account_terms",
         "SELECT num_conta, tipo_conta, CASE WHEN tipo_conta = 'poupança' THEN CAST(0.5 AS DOUBLE) END AS taxa_juros, "
         "CASE WHEN tipo_conta = 'conta especial' THEN CAST(1000.0 AS DOUBLE) END AS limite_credito FROM conta")(
    lambda fx: I.conform_account_terms(fx.bank().conta.select(
        "num_conta", "tipo_conta", F.lit(0.5).cast("double").alias("taxa_juros"),
        F.lit(1000.0).cast("double").alias("limite_credito"))))

# Every hundredth part is stored before, all others are requests. The limit is reached at the seq of the
# accepted request that takes the last free slot.
register("accept_dependents",
         "WITH e AS (SELECT * FROM dependente WHERE seq % 100 = 0), r AS (SELECT * FROM dependente WHERE seq % 100 <> 0), "
         "have AS (SELECT matricula_func, count(*) AS n FROM e GROUP BY matricula_func), "
         "rr AS (SELECT r.*, NOT EXISTS (SELECT 1 FROM e WHERE e.matricula_func = r.matricula_func "
         "  AND e.nome_completo = r.nome_completo) AND row_number() OVER "
         "  (PARTITION BY r.matricula_func, r.nome_completo ORDER BY r.seq) = 1 AS fresh, "
         "  5 - COALESCE(h.n, 0) AS free FROM r LEFT JOIN have h ON h.matricula_func = r.matricula_func), "
         "k AS (SELECT rr.*, CASE WHEN fresh THEN row_number() OVER (PARTITION BY matricula_func, fresh ORDER BY seq) END "
         "  AS rk FROM rr), full_at AS (SELECT matricula_func, seq AS s FROM k WHERE fresh AND rk = free), "
         "d AS (SELECT k.*, CASE WHEN free <= 0 OR k.seq > f.s THEN 'DEPENDENT_LIMIT' WHEN NOT fresh THEN 'DUPLICATE_KEY' END "
         "  AS reason FROM k LEFT JOIN full_at f ON f.matricula_func = k.matricula_func) "
         "SELECT nome_completo, matricula_func, data_nascimento, parentesco, idade, seq, reason IS NULL AS accepted, reason "
         "FROM d")(
    lambda fx: I.accept_dependents(fx.view("dependente").where("seq % 100 = 0"),
                                   fx.view("dependente").where("seq % 100 <> 0")))


def _accept_holders(fx: Fixture):
    out, _ = I.accept_holders(fx.bank(), fx.view("holder_req"))
    return out


register("accept_holders")(_accept_holders)


def _holder_chain(fx: Fixture):
    """Every order as a request for a customer and an account, each shared with the request before or after it: one chain
    over all orders, broken where the price in cents is a multiple of 1,001 (no account asked for)."""
    orders = fx.spark.read.parquet(f"{fx.sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    n = F.col("_grank") - 1
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    asked = I.global_rank(orders, "o_orderkey").select(
        F.col("o_orderkey").cast("long").alias("seq"), F.floor((n + 1) / 2).cast("long").alias("cliente"),
        F.when(cents % 1001 != 0, F.floor(n / 2).cast("long")).alias("conta"))
    out, _ = I.greedy_unique(asked, "seq", [["cliente"], ["conta"]])
    return out.select("seq", "cliente", "conta", "accepted", "_clash").withColumnRenamed("_clash", "clash")


# A request shares its customer (even n) or its account (odd n) with the one before it. Without the shared key a run
# starts anew; inside a run every other request is accepted.
register("holder_chain",
         "SELECT seq, cliente, conta, place % 2 = 0 AS accepted, CAST(CASE WHEN place % 2 = 1 THEN CASE WHEN n % 2 = 0 THEN 0 ELSE 1 END END AS INT) "
         "AS clash FROM (SELECT *, n - max(CASE WHEN starts THEN n END) OVER (ORDER BY n) AS place FROM "
         "(SELECT *, n = 0 OR (n % 2 = 1 AND (conta IS NULL OR lag(conta) OVER (ORDER BY n) IS NULL)) AS starts FROM "
         "(SELECT CAST(o_orderkey AS BIGINT) AS seq, n, (n + 1) // 2 AS cliente, CASE WHEN CAST(round(o_totalprice * 100) AS BIGINT) % 1001 <> 0 "
         "THEN n // 2 END AS conta FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders))))")(
    _holder_chain)


# ---------------------------------------------------------------- streaming

from ledgerlake.sources.fixture import stream_view  # noqa: E402
from ledgerlake.streaming import posting as L  # noqa: E402
from ledgerlake.streaming import transfers as L3  # noqa: E402
from ledgerlake.streaming.staging import staged_ranges  # noqa: E402


def _post_stream_stateful(fx: Fixture):
    src = stream_view(fx.spark, fx.sf_dir, "transacao", drop=("num_transacao",)).withColumnRenamed("id_transacao", "seq")
    return L.run_to_table(L.post_stream(src, fx.bank().conta), "post-stream")


def _post_stream(fx: Fixture):
    src = stream_view(fx.spark, fx.sf_dir, "transacao", drop=("num_transacao",)).withColumnRenamed("id_transacao", "seq")
    out = L.post_stream_versioned(src, fx.bank().conta)
    return fx.spark.read.parquet(f"{out}/decisions").select("seq", "num_conta", "tipo", "valor", "status", "saldo_apos")


def payroll_changes(fx: Fixture):
    """Employee change log from the supplier table: hire everyone, then move some, then dismiss some."""
    f = fx.bank().funcionario.withColumn("_k", F.col("cep").cast("long"))
    hire = f.select((F.col("_k") * 3).alias("seq"), F.lit("I").alias("op"),
                    F.lit(None).cast("int").alias("old_num_ag"), F.lit(None).cast("double").alias("old_salario"),
                    F.col("num_ag").alias("new_num_ag"), F.col("salario").alias("new_salario"))
    moved = f.where("_k % 4 = 0")
    move = moved.select((F.lit(1 << 40) + F.col("_k") * 3 + 1).alias("seq"), F.lit("U").alias("op"),
                        F.col("num_ag").alias("old_num_ag"), F.col("salario").alias("old_salario"),
                        ((F.col("num_ag") + 1) % 25).cast("int").alias("new_num_ag"),
                        (F.col("salario") + 100).alias("new_salario"))
    fire = f.where("_k % 9 = 0").select(
        (F.lit(2 << 40) + F.col("_k") * 3 + 2).alias("seq"), F.lit("D").alias("op"),
        F.when(F.col("_k") % 4 == 0, ((F.col("num_ag") + 1) % 25).cast("int")).otherwise(F.col("num_ag")).alias("old_num_ag"),
        F.when(F.col("_k") % 4 == 0, F.col("salario") + 100).otherwise(F.col("salario")).alias("old_salario"),
        F.lit(None).cast("int").alias("new_num_ag"), F.lit(None).cast("double").alias("new_salario"))
    return hire.unionByName(move).unionByName(fire)


def _payroll_stream(fx: Fixture):
    cdc = payroll_changes(fx)
    folder = L.scratch_path(fx.spark, "payroll-stream")
    for staged in staged_ranges(cdc, "seq", [1 << 40, 2 << 40], "payroll-cdc"):
        src = fx.spark.readStream.schema(cdc.schema).parquet(staged)
        out = L.run_to_table(L.payroll_stream(src), "payroll-stream", mode="complete", folder=folder)
    return out


def _payroll_replayed(fx: Fixture):
    """The same change log with records delivered again: every fifth in its own batch, every third in the batch after."""
    from ledgerlake.streaming.payroll import payroll_totals, run_payroll

    cdc, span = payroll_changes(fx), 1 << 40
    sent = cdc.withColumn("at", F.col("seq"))
    sent = (sent.unionByName(sent.where("seq % 5 = 0")).unionByName(sent.where("seq % 3 = 0").withColumn("at", F.col("seq") + span)))
    folder = L.scratch_path(fx.spark, "payroll-replayed")
    for staged in staged_ranges(sent, "at", [span, 2 * span, 3 * span], "payroll-replayed"):
        out = run_payroll(fx.spark.readStream.schema(sent.schema).parquet(staged).drop("at"), folder)
    return payroll_totals(fx.spark, out)


def transfer_requests(fx: Fixture):
    """Singles and transfers as one request stream schema, in arrival order."""
    b = fx.bank()
    singles = _singles(b).select("seq", F.lit("single").alias("kind"), "num_conta", "tipo", "valor",
                                 F.lit(None).cast("string").alias("solicitante"),
                                 F.lit(None).cast("int").alias("conta_origem"),
                                 F.lit(None).cast("int").alias("conta_destino"))
    tr = fx.view("transfer_req").select("seq", F.lit("transfer").alias("kind"), F.lit(None).cast("int").alias("num_conta"),
                                        F.lit("transferência").alias("tipo"), "valor", "solicitante",
                                        "conta_origem", "conta_destino")
    return singles.unionByName(tr)


def _post_transfers_stream(fx: Fixture):
    req = transfer_requests(fx)
    mid = req.agg(F.percentile_approx("seq", 0.5)).collect()[0][0]
    folder = L.scratch_path(fx.spark, "transfer-stream")
    for staged in staged_ranges(req, "seq", [int(mid)], "transfer-req"):
        src = fx.spark.readStream.schema(req.schema).parquet(staged)
        out = L3.post_transfers_stream(fx.bank(), src, folder=folder)
    return fx.spark.read.parquet(f"{out}/decisions").select("seq", "kind", "status", "batch")


def _post_stream_state(fx: Fixture):
    """State store v2, with the transactions' numbers."""
    from ledgerlake.streaming.stateful import post_stream_state, rocksdb

    src = stream_view(fx.spark, fx.sf_dir, "transacao", drop=("num_transacao",)).withColumnRenamed("id_transacao", "seq")
    src = src.withColumn("num_transacao", F.col("seq").cast("int"))  # a number of its own for every transaction
    with rocksdb(fx.spark):
        return L.run_to_table(post_stream_state(src, fx.bank().conta), "post-stream-state")


register("post_stream_state")(_post_stream_state)
ORACLE["post_stream_state"] = f"SELECT id_transacao AS seq, num_conta, tipo, valor, status, saldo_apos FROM ({ORACLE['post']}) p"
register("post_stream")(_post_stream)
register("post_stream_stateful")(_post_stream_stateful)
for _name in ("post_stream", "post_stream_stateful"):  # the same rule as the batch form, with id_transacao named seq
    ORACLE[_name] = f"SELECT id_transacao AS seq, num_conta, tipo, valor, status, saldo_apos FROM ({ORACLE['post']}) p"
register("payroll_stream",
         "WITH d AS (SELECT num_ag, CAST(salario AS DECIMAL(18, 2)) AS s FROM funcionario UNION ALL "
         "SELECT num_ag, -CAST(salario AS DECIMAL(18, 2)) FROM funcionario WHERE CAST(cep AS BIGINT) % 4 = 0 UNION ALL "
         "SELECT CAST((num_ag + 1) % 25 AS INT), CAST(salario + 100 AS DECIMAL(18, 2)) FROM funcionario "
         "WHERE CAST(cep AS BIGINT) % 4 = 0 UNION ALL "
         "SELECT CASE WHEN CAST(cep AS BIGINT) % 4 = 0 THEN CAST((num_ag + 1) % 25 AS INT) ELSE num_ag END, "
         "-CAST(CASE WHEN CAST(cep AS BIGINT) % 4 = 0 THEN salario + 100 ELSE salario END AS DECIMAL(18, 2)) FROM funcionario "
         "WHERE CAST(cep AS BIGINT) % 9 = 0) "
         "SELECT num_ag, CAST(SUM(s) AS DOUBLE) AS sal_total FROM d GROUP BY num_ag")(_payroll_stream)
register("payroll_replayed")(_payroll_replayed)
ORACLE["payroll_replayed"] = ORACLE["payroll_stream"]
register("post_transfers_stream")(_post_transfers_stream)


# ------------------------------------------------- composite requests

from ledgerlake.operators import requests as RQ  # noqa: E402


def _cust(fx: Fixture):
    return fx.raw("customer")


def open_account_requests(fx: Fixture):
    """One request per customer: existing customers in their own or another branch, new customers (a CPF asked for twice,
    in two branches), and a known customer's CPF that has no registration; every fourth requester is an admin."""
    k = F.col("c_custkey")
    new_cpf, later = k % 3 == 0, k % 3 == 1
    shared = F.lpad((F.floor(k / 6) + 10 ** 9).cast("string"), 11, "0")
    return _cust(fx).select(
        k.cast("long").alias("seq"),
        F.when(new_cpf | (later & (k % 5 == 0)), shared).otherwise(F.lpad(k.cast("string"), 11, "0")).alias("cpf"),
        F.when(new_cpf, F.col("c_name")).alias("nome_completo"),
        F.when(new_cpf, F.lit("1990-01-01").cast("date")).alias("data_nascimento"),
        F.lit("poupança").alias("tipo_conta"), F.col("c_acctbal").alias("saldo_inicial"),
        F.md5(F.col("c_name")).alias("senha_hash"),
        F.when(k % 20 == 0, F.col("c_nationkey")).otherwise((F.col("c_nationkey") + 1) % 25).cast("int").alias("num_ag"),
        F.lit(0.5).alias("taxa_juros"), F.lit(None).cast("double").alias("limite_credito"),
        F.when(k % 4 == 0, F.lit("admin")).otherwise(F.lit("gerente")).alias("requester_role"),
        F.when(k % 8 == 0, F.lit(None)).otherwise(F.lit("MAT1004")).alias("requester_matricula"))


def registration_requests(fx: Fixture):
    """One request per customer: known CPFs, new ones, user names asked for twice, and malformed CPFs."""
    k = F.col("c_custkey")
    return _cust(fx).select(
        k.cast("long").alias("seq"),
        F.when(k % 2 == 0, F.lpad(k.cast("string"), 11, "0")).when(k % 35 == 5, F.lit("12"))
        .otherwise(F.lpad((k + 5 * 10 ** 8).cast("string"), 11, "0")).alias("cpf"),
        F.col("c_name").alias("nome_completo"), F.lit("1985-05-05").cast("date").alias("data_nascimento"),
        F.concat(F.lit("user"), F.when(k % 9 == 0, k - 2).otherwise(k).cast("string")).alias("username"),
        F.col("c_name").alias("senha"),
        F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("(85) 9"), F.lpad(k.cast("string"), 8, "0")).alias("telefone"))


def employee_requests(fx: Fixture):
    """One hire per supplier (every ninth below the salary floor) and one edit per stored employee (every fifth with a new secret)."""
    k = F.col("s_suppkey")
    hires = fx.raw("supplier").select(
        k.cast("long").alias("seq"), F.lit("hire").alias("op"), F.lit(None).cast("string").alias("matricula"),
        F.concat(F.lit("Novo "), F.col("s_name")).alias("nome_completo"), F.lit("caixa").alias("cargo"),
        F.lit("feminino").alias("genero"), F.lit("1991-01-01").cast("date").alias("data_nascimento"),
        F.when(k % 9 == 0, F.lit(1000.0)).otherwise(F.lit(2300.0) + F.abs(F.col("s_acctbal"))).alias("salario"),
        F.col("s_nationkey").alias("num_ag"), F.md5(F.col("s_name")).alias("senha_hash"))
    e = F.col("cep").cast("long")
    edits = fx.bank().funcionario.select(
        (e + 10 ** 9).alias("seq"), F.lit("edit").alias("op"), "matricula", "nome_completo",
        "cargo", "genero", "data_nascimento", (F.col("salario") + 10).alias("salario"),
        ((F.col("num_ag") + F.when(e % 4 == 0, 1).otherwise(0)) % 25).cast("int").alias("num_ag"),
        F.when(e % 5 == 0, F.md5(F.col("matricula"))).otherwise(F.lit("")).alias("senha_hash"))
    return hires.unionByName(edits)


def promotion_requests(fx: Fixture):
    """Per client: to manager, then to admin (by an admin, or by a manager, who may not), and once more to manager."""
    u = fx.bank().usuario.where("role = 'client'").select(F.col("id").cast("long").alias("id_usuario"))
    i = F.col("id_usuario")
    step = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return u.select("id_usuario", step.alias("k")).select(
        (i * 3 + F.col("k")).alias("seq"), "id_usuario",
        F.when(F.col("k") == 1, F.lit("admin")).otherwise(F.lit("gerente")).alias("novo_cargo"),
        F.when((F.col("k") == 0) & (i % 11 == 0), i).otherwise(F.lit(1)).cast("long").alias("requester_id"),
        F.when(i % 2 == 0, F.lit("admin")).otherwise(F.lit("gerente")).alias("requester_role"))


def dependent_requests(fx: Fixture):
    """One new name per part for three employees and some unknown ones, then one rename and one removal per stored name."""
    k = F.col("p_partkey").cast("long")
    adds = fx.raw("part").select(
        k.alias("seq"), F.lit("add").alias("op"),
        F.when(k % 11 == 0, F.lit("MAT9999999")).otherwise(F.concat(F.lit("MAT"), (1008 + k % 3).cast("string"))).alias("matricula_func"),
        F.lit(None).cast("string").alias("nome_antigo"),
        F.when(k % 4 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("nome_completo"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k % 4000).cast("int")).alias("data_nascimento"),
        F.when(k % 17 == 0, F.lit("primo")).otherwise(F.lit("filho(a)")).alias("parentesco"))
    stored = fx.view("dependente")
    edits = stored.select(
        (F.col("seq") + 10 ** 9).alias("seq"), F.when(F.col("seq") % 5 == 0, F.lit("delete")).otherwise(F.lit("edit")).alias("op"),
        "matricula_func", F.col("nome_completo").alias("nome_antigo"),
        F.concat(F.col("nome_completo"), F.lit(" Jr")).alias("nome_completo"), "data_nascimento", "parentesco")
    return adds.unionByName(edits)


def fee_requests(fx: Fixture):
    """One fee per order; the authoriser is named by user name, matricula or CPF, and is sometimes the requester or a client."""
    k = F.col("o_orderkey")
    who = (F.when(k % 10 == 0, F.lit("MAT1002")).when(k % 10 == 3, F.lpad(F.col("o_custkey").cast("string"), 11, "0"))
           .when(k % 10 == 7, F.lit("nobody")).otherwise(F.lit("MAT1005")))
    return fx.raw("orders").select(
        k.cast("long").alias("seq"), (50501 + F.col("o_custkey")).cast("int").alias("num_conta"),
        F.round(F.col("o_totalprice") / 1000, 2).alias("valor"), F.lit("MAT1002").alias("requester_matricula"),
        who.alias("authorizer_username"))


def _open(fx: Fixture):
    return RQ.open_accounts(fx.bank(), open_account_requests(fx), AS_OF)


def _registered(fx: Fixture):
    return RQ.register_customers(fx.bank(), registration_requests(fx), AS_OF)


def _of(make, part: str):
    return lambda fx: make(fx).decisions if part == "decisions" else make(fx).rows[part]


for _name, _make, _parts in (
        ("open_accounts", _open, ("conta", "titularidade_conta", "cliente", "transacao")),
        ("register_customers", _registered, ("conta", "titularidade_conta", "cliente", "email_cliente", "telefone_cliente",
                                             "usuario", "transacao")),
        ("apply_employees", lambda fx: RQ.apply_employees(fx.bank(), employee_requests(fx)), ("funcionario", "usuario", "agencia")),
        ("apply_promotions", lambda fx: RQ.apply_promotions(fx.bank(), promotion_requests(fx)), ("funcionario", "usuario")),
        ("apply_dependents", lambda fx: RQ.apply_dependents(fx.bank(), dependent_requests(fx), AS_OF), ("dependente",)),
        ("post_fees", lambda fx: RQ.post_fees(fx.bank(), fee_requests(fx), AS_OF), ("transacao", "conta"))):
    register(_name)(_of(_make, "decisions"))
    for _part in _parts:
        register(f"{_name}_{_part}")(_of(_make, _part))
from ledgerlake.plans.change_oracles import change_oracles  # noqa: E402

ORACLE.update(change_oracles())


def _versioned_bank(fx: Fixture):
    """The bank as version 1, the account openings of a batch as version 2 (accounts, holders, customers and log at once),
    read back through that version: every account with its balance, holders and log rows."""
    from ledgerlake.sources.snapshots import commit, read_bank

    root = L.scratch_path(fx.spark, "versions")
    whole = fx.bank()
    first = commit(fx.spark, root, {t: getattr(whole, t) for t in TABLES}, base=0, batch=("load", 0))
    made = RQ.open_accounts(read_bank(fx.spark, root, first), open_account_requests(fx), AS_OF).rows
    second = commit(fx.spark, root, appends={t: made[t] for t in ("conta", "titularidade_conta", "cliente", "transacao")},
                    base=first, batch=("openings", 0))
    b = read_bank(fx.spark, root, second)
    holders = b.titularidade_conta.groupBy("num_conta").agg(F.count(F.lit(1)).alias("titulares"))
    log = b.transacao.groupBy("num_conta").agg(F.count(F.lit(1)).alias("transacoes"))
    none = F.lit(0).cast("long")
    return (b.conta.join(holders, "num_conta", "left").join(log, "num_conta", "left")
            .select("num_conta", "saldo", "tipo_conta", F.coalesce("titulares", none).alias("titulares"),
                    F.coalesce("transacoes", none).alias("transacoes")))


register("versioned_bank")(_versioned_bank)
_MADE = {t: f"({ORACLE[f'open_accounts_{t}']})" for t in ("conta", "titularidade_conta", "transacao")}
ORACLE["versioned_bank"] = oracle_with(
    f"SELECT c.num_conta, c.saldo, c.tipo_conta, COALESCE(h.n, 0) AS titulares, COALESCE(t.n, 0) AS transacoes "
    f"FROM (SELECT num_conta, saldo, tipo_conta FROM conta UNION ALL SELECT num_conta, saldo, tipo_conta FROM {_MADE['conta']}) c "
    f"LEFT JOIN (SELECT num_conta, count(*) AS n FROM (SELECT num_conta FROM titularidade_conta UNION ALL "
    f"SELECT num_conta FROM {_MADE['titularidade_conta']}) GROUP BY num_conta) h ON h.num_conta = c.num_conta "
    f"LEFT JOIN (SELECT num_conta, count(*) AS n FROM (SELECT num_conta FROM transacao UNION ALL "
    f"SELECT num_conta FROM {_MADE['transacao']}) GROUP BY num_conta) t ON t.num_conta = c.num_conta")

# Fees: the checks before the posting rule, then the recursion of ``post`` over what passes them.
_FEES = """
, fee AS (SELECT CAST(o_orderkey AS BIGINT) AS seq, CAST(50501 + o_custkey AS INT) AS num_conta, (CAST(round(o_totalprice * 100) AS BIGINT) + 500) // 1000 / 100.0 AS valor,
    CASE o_orderkey % 10 WHEN 0 THEN 'MAT1002' WHEN 3 THEN lpad(CAST(o_custkey AS VARCHAR), 11, '0') WHEN 7 THEN 'nobody'
         ELSE 'MAT1005' END AS who FROM orders),
names AS (SELECT 'n' AS k, username AS v, id, matricula FROM usuario UNION ALL SELECT 'n', matricula, id, matricula FROM usuario
    UNION ALL SELECT 'c', cpf, id, matricula FROM usuario),
asked AS (SELECT DISTINCT who FROM fee),
staff AS (SELECT who, arg_min(COALESCE(matricula, ''), id) AS matricula FROM asked JOIN names
    ON (k = 'n' AND v = who) OR (k = 'c' AND v = regexp_replace(who, '[^0-9]', '', 'g')) GROUP BY who),
judged AS (SELECT f.*, CASE WHEN COALESCE(s.matricula, '') = '' THEN 'AUTHORIZER_NOT_EMPLOYEE'
    WHEN s.matricula = 'MAT1002' THEN 'SELF_AUTHORIZATION'
    WHEN NOT EXISTS (SELECT 1 FROM conta c WHERE c.num_conta = f.num_conta) THEN 'UNKNOWN_ACCOUNT'
    WHEN f.valor IS NULL OR f.valor <= 0 THEN 'INVALID_AMOUNT' END AS why FROM fee f LEFT JOIN staff s ON s.who = f.who),
due AS (SELECT seq AS id_transacao, num_conta, 'pagamento' AS tipo, valor FROM judged WHERE why IS NULL)"""


def _fee_oracle(tail: str) -> str:
    base = oracle_with("SELECT 1", ["conta", "usuario"]).rsplit("\nSELECT 1", 1)[0]
    posted = POST_SQL.replace("FROM transacao)", "FROM due)", 1)
    cut = posted.index("\nSELECT x.id_transacao")
    return f"WITH RECURSIVE{base[len('WITH'):]}{_FEES}{posted[:cut]},\ndone AS ({posted[cut:]})\n{tail}"


ORACLE["post_fees"] = _fee_oracle("SELECT id_transacao AS seq, status, saldo_apos FROM done "
                                  "UNION ALL SELECT seq, why, CAST(NULL AS DOUBLE) FROM judged WHERE why IS NOT NULL")
ORACLE["post_fees_conta"] = _fee_oracle(
    "SELECT c.* REPLACE (CAST(CAST(c.saldo AS DECIMAL(18,2)) - COALESCE(p.v, 0) AS DOUBLE) AS saldo) FROM conta c LEFT JOIN "
    "(SELECT num_conta, SUM(CAST(valor AS DECIMAL(18,2))) AS v FROM done WHERE status = 'ACCEPTED' GROUP BY num_conta) p "
    "ON p.num_conta = c.num_conta")


# ------------------------------------------------------ more inventory items

from ledgerlake.sources.tables import conform  # noqa: E402

register("accounts_per_branch",
         "SELECT tc.cpf_cliente, c.num_ag, COUNT(*) AS n_contas FROM titularidade_conta tc "
         "JOIN conta c ON c.num_conta = tc.num_conta GROUP BY tc.cpf_cliente, c.num_ag")(
    lambda fx: R.accounts_per_branch(fx.bank()))

register("dependents_per_employee",
         "SELECT matricula_func, COUNT(*) AS n_dependentes FROM dependente GROUP BY matricula_func")(
    lambda fx: R.dependents_per_employee(fx.bank()))

register("lookup",
         "SELECT f.matricula, f.nome_completo, f.num_ag FROM funcionario f "
         "WHERE f.matricula IN (SELECT matricula_gerente FROM conta)")(
    lambda fx: R.lookup(fx.bank().funcionario, fx.bank().conta.select(F.col("matricula_gerente").alias("matricula")))
    .select("matricula", "nome_completo", "num_ag"))

register("conform_insert",
         "SELECT CAST(50501 + 100000000 + c_custkey AS INT) AS num_conta, CAST(0.0 AS DOUBLE) AS saldo, "
         "md5(c_name) AS senha, 'conta-corrente' AS tipo_conta, CAST(NULL AS DOUBLE) AS taxa_juros, "
         "CAST(NULL AS DOUBLE) AS limite_credito, CAST(NULL AS DATE) AS data_aniversario_contrato, "
         "CAST(c_nationkey AS INT) AS num_ag, 'MAT1004' AS matricula_gerente FROM customer")(
    lambda fx: conform(fx.raw("customer").select(
        (F.lit(50501 + 100000000) + F.col("c_custkey")).alias("NUM_CONTA"), F.md5("c_name").alias("senha"),
        F.lit("conta-corrente").alias("tipo_conta"), F.col("c_nationkey").alias("num_ag"),
        F.lit("MAT1004").alias("matricula_gerente")), "conta"))

register("first_by_key",
         "SELECT cpf_cliente, arg_min(telefone, telefone) AS telefone, arg_min(descricao, telefone) AS descricao "
         "FROM telefone_cliente GROUP BY cpf_cliente")(
    lambda fx: R.first_by_key(fx.bank().telefone_cliente, ["cpf_cliente"], "telefone",
                              ["cpf_cliente", "telefone", "descricao"]))


# ------------------------------------------- planted violations, bulk forms

def _schema_dirty_oracle() -> str:
    table, key = "conta", ["num_conta"]
    rk = "CAST(num_conta AS VARCHAR)"
    rules = [(f"not_null:{f.name}", f"{f.name} IS NULL") for f in TABLES[table].fields if not f.nullable]
    rules += [(f"enum:{c}", f"{c} IS NOT NULL AND {c} NOT IN ({_in_list(d)})")
              for c, d in ENUM_COLUMNS.get(table, {}).items()]
    rules += [(f"length:{c}", f"length({c}) > {n}") for c, n in MAX_LENGTHS.get(table, {}).items()]
    return " UNION ALL ".join(
        f"SELECT 'conta' AS tabela, {rk} AS row_key, '{name}' AS rule, 'db' AS origem FROM conta_dirty WHERE {cond}"
        for name, cond in rules)


register("check_schema_dirty", _schema_dirty_oracle())(
    lambda fx: Q.check_schema(fx.view("conta_dirty"), "conta", ["num_conta"]))

register("customer_activity_count_all_30",
         "SELECT tc.cpf_cliente, t.num_conta, COUNT(t.id_transacao) AS total FROM transacao t "
         "JOIN titularidade_conta tc ON t.num_conta = tc.num_conta JOIN conta c ON t.num_conta = c.num_conta "
         f"WHERE c.tipo_conta = 'conta-corrente' AND t.data_hora >= {TS} - INTERVAL 30 DAY "
         "GROUP BY tc.cpf_cliente, t.num_conta")(
    lambda fx: R.customer_activity_count(fx.bank(), None, AS_OF, 30))

register("customer_activity_volume_all_30",
         "SELECT tc.cpf_cliente, t.num_conta, CAST(SUM(CAST(t.valor AS DECIMAL(18,2))) AS DOUBLE) AS volume "
         "FROM transacao t JOIN titularidade_conta tc ON t.num_conta = tc.num_conta "
         f"WHERE t.data_hora >= {TS} - INTERVAL 30 DAY GROUP BY tc.cpf_cliente, t.num_conta")(
    lambda fx: R.customer_activity_volume(fx.bank(), None, AS_OF, 30))


def cash_requests(fx: Fixture):
    """Deposits and withdrawals entered by staff: the orders of kinds 0 and 1, requester by order key."""
    o = fx.raw("orders").where("o_orderkey % 6 IN (0, 1)")
    return o.select(F.col("o_orderkey").alias("seq"),
                    F.when(F.col("o_orderkey") % 97 == 0, F.lit("Admin"))
                    .otherwise(F.concat(F.lit("MAT"), (1001 + F.col("o_orderkey") % 13).cast("string"))).alias("solicitante"),
                    (50501 + F.col("o_custkey")).cast("int").alias("num_conta"),
                    F.when(F.col("o_orderkey") % 6 == 0, F.lit("saque")).otherwise(F.lit("depósito")).alias("tipo"),
                    F.col("o_totalprice").alias("valor"))


register("authorize_cash",
         "SELECT r.seq, r.solicitante, r.num_conta, r.tipo, r.valor, CASE WHEN u.role IS NULL THEN 'USER_NOT_FOUND' "
         "WHEN u.role NOT IN ('caixa', 'admin') THEN 'ROLE_NOT_ALLOWED' "
         "WHEN r.valor IS NULL OR r.valor <= 0 THEN 'INVALID_AMOUNT' "
         "WHEN c.num_conta IS NULL THEN 'UNKNOWN_ACCOUNT' "
         "WHEN u.role = 'caixa' AND (f.num_ag IS NULL OR f.num_ag <> c.num_ag) THEN 'BRANCH_MISMATCH' END AS reason "
         "FROM (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 97 = 0 THEN 'Admin' "
         "      ELSE 'MAT' || CAST(1001 + o_orderkey % 13 AS VARCHAR) END AS solicitante, "
         "      CAST(50501 + o_custkey AS INT) AS num_conta, "
         "      CASE WHEN o_orderkey % 6 = 0 THEN 'saque' ELSE 'depósito' END AS tipo, o_totalprice AS valor "
         "      FROM orders WHERE o_orderkey % 6 IN (0, 1)) r "
         "LEFT JOIN usuario u ON u.username = r.solicitante LEFT JOIN funcionario f ON f.matricula = u.matricula "
         "LEFT JOIN conta c ON c.num_conta = r.num_conta")(
    lambda fx: N.authorize_cash(fx.bank(), cash_requests(fx)))


def _post_incremental(fx: Fixture):
    """Post the log in two batches split at half the largest id: batch 2 runs against the balances
    and the accepted log left by batch 1, and must decide exactly as one pass over the whole log."""
    b = fx.bank()
    t = b.transacao.select("id_transacao", "num_transacao", "num_conta", "tipo", "valor")
    # One aggregate value (not data) fetched once, so the split is a literal that reaches the scan.
    cut = int(t.agg(F.max("id_transacao")).collect()[0][0] // 2)
    from ledgerlake.session import cut_lineage

    # Batch 1's decisions feed both the new balances and the existing log: materialise them once.
    first = K.Posting(cut_lineage(K.post(b.conta, t.where(F.col("id_transacao") < cut), seq="id_transacao").decisions))
    after = K.balances_after(b.conta, first)
    second = K.post(after, t.where(F.col("id_transacao") >= cut), seq="id_transacao",
                    existing_log=first.accepted.select("num_conta", "num_transacao"))
    cols = ["id_transacao", "num_conta", "tipo", "valor", "status", "saldo_apos"]
    return first.decisions.select(*cols).unionByName(second.decisions.select(*cols))


def _cash(fx: Fixture):
    return RQ.cash_operations(fx.bank(), cash_requests(fx), AS_OF)


def _apply_transfers(fx: Fixture):
    """All transfer requests against the stored log; some bring a number, which the log or another request may have taken."""
    k = F.col("seq")
    req = fx.view("transfer_req").withColumn("valor", F.round(F.col("valor") / 1000, 2))
    req = req.withColumn("num_trans_origem", F.when(k % 5 == 0, (k % 40).cast("int"))).withColumn(
        "num_trans_destino", F.when(k % 7 == 0, (10_000 + k % 50).cast("int")))
    return K2.apply_transfers(fx.bank(), None, req, "double_entry", AS_OF)


register("apply_transfers")(_of(_apply_transfers, "decisions"))
register("apply_transfers_transacao")(_of(_apply_transfers, "transacao"))
register("apply_transfers_conta")(_of(_apply_transfers, "conta"))
register("cash_operations")(_of(_cash, "decisions"))
register("cash_operations_transacao")(_of(_cash, "transacao"))
register("cash_operations_conta")(_of(_cash, "conta"))


register("post_incremental")(_post_incremental)
ORACLE["post_incremental"] = ORACLE["post"]  # two batches give the decisions of one pass


register("ensure_admin",
         "SELECT * FROM usuario WHERE username <> 'Admin' UNION ALL "
         "SELECT (SELECT max(id) + 1 FROM usuario WHERE username <> 'Admin'), 'Admin', 'Administrador DBA', "
         "sha256('Root'), 'admin', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)")(
    lambda fx: I.ensure_admin(fx.bank().usuario.where(F.col("username") != "Admin")))


register("role_drift_dirty",
         "SELECT u.matricula, u.username, u.role, f.cargo FROM usuario_drift u JOIN funcionario f "
         "ON u.matricula = f.matricula WHERE u.role <> f.cargo AND NOT (u.role = 'admin' AND f.cargo = 'gerente')")(
    lambda fx: Q.role_drift(fx.bank().with_tables(usuario=fx.view("usuario_drift"))))


register("check_holders_dirty",
         "SELECT num_conta, COUNT(*) AS n_titulares, COUNT(DISTINCT tipo_titular) AS n_slots "
         "FROM titularidade_dirty GROUP BY num_conta "
         "HAVING COUNT(*) > 2 OR COUNT(*) > COUNT(DISTINCT tipo_titular)")(
    lambda fx: Q.check_holders(fx.bank().with_tables(titularidade_conta=fx.view("titularidade_dirty"))))
