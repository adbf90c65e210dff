"""DuckDB SQL for the change-request queries: the request batches and the rules, written out once more in SQL.

Batches come from every customer, user and supplier row. Each rule is stated over the whole batch: what arrival
order decides is a minimum or a rank, as no later request can take back an earlier one.
"""

from __future__ import annotations

from ledgerlake.sources.fixture import oracle_with

_OPEN = """
req AS (SELECT CAST(c.c_custkey AS BIGINT) AS seq, c.c_custkey % 3 = 0 AS creates,
    CASE WHEN c.c_custkey % 3 = 0 OR (c.c_custkey % 3 = 1 AND c.c_custkey % 5 = 0)
         THEN lpad(CAST(c.c_custkey // 6 + 1000000000 AS VARCHAR), 11, '0')
         ELSE lpad(CAST(c.c_custkey AS VARCHAR), 11, '0') END AS cpf,
    c.c_name, c.c_acctbal AS valor, md5(c.c_name) AS senha,
    CAST(CASE WHEN c.c_custkey % 20 = 0 THEN c.c_nationkey ELSE (c.c_nationkey + 1) % 25 END AS INT) AS num_ag,
    CASE WHEN c.c_custkey % 4 = 0 THEN 'MAT1001' ELSE 'MAT1004' END AS manager FROM customer c),
checked AS (SELECT r.*, EXISTS (SELECT 1 FROM cliente k WHERE k.cpf = r.cpf) AS known,
    CASE WHEN NOT EXISTS (SELECT 1 FROM funcionario f WHERE f.matricula = r.manager) THEN 'MANAGER_NOT_FOUND'
         WHEN r.valor < 0 THEN 'NEGATIVE_OPENING_BALANCE'
         WHEN r.creates AND EXISTS (SELECT 1 FROM cliente k WHERE k.cpf = r.cpf) THEN 'CUSTOMER_EXISTS' END AS why FROM req r),
made AS (SELECT cpf, min(seq) AS m FROM checked WHERE creates AND why IS NULL GROUP BY cpf),
held AS (SELECT DISTINCT t.cpf_cliente AS cpf, k.num_ag FROM titularidade_conta t JOIN conta k ON k.num_conta = t.num_conta),
second AS (SELECT c.* EXCLUDE (why), CASE WHEN c.why IS NOT NULL THEN c.why
    WHEN c.creates AND c.seq <> m.m THEN 'CUSTOMER_EXISTS'
    WHEN NOT c.creates AND NOT c.known AND (m.m IS NULL OR c.seq < m.m) THEN 'CUSTOMER_NOT_FOUND'
    WHEN h.cpf IS NOT NULL THEN 'ONE_ACCOUNT_PER_BRANCH' END AS why
    FROM checked c LEFT JOIN made m ON m.cpf = c.cpf LEFT JOIN held h ON h.cpf = c.cpf AND h.num_ag = c.num_ag),
third AS (SELECT * EXCLUDE (why), CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY cpf, num_ag, why IS NULL ORDER BY seq) > 1
    THEN 'ONE_ACCOUNT_PER_BRANCH' ELSE why END AS why FROM second),
opened AS (SELECT *, CASE WHEN why IS NULL THEN CAST((SELECT max(num_conta) FROM conta)
    + row_number() OVER (PARTITION BY why IS NULL ORDER BY seq) AS INT) END AS num FROM third)
"""

_REGISTER = """
req AS (SELECT CAST(c.c_custkey AS BIGINT) AS seq,
    CASE WHEN c.c_custkey % 2 = 0 THEN lpad(CAST(c.c_custkey AS VARCHAR), 11, '0') WHEN c.c_custkey % 35 = 5 THEN '12'
         ELSE lpad(CAST(c.c_custkey + 500000000 AS VARCHAR), 11, '0') END AS cpf, c.c_name,
    'user' || CAST(CASE WHEN c.c_custkey % 9 = 0 THEN c.c_custkey - 2 ELSE c.c_custkey END AS VARCHAR) AS username,
    'u' || CAST(c.c_custkey AS VARCHAR) || '@example.com' AS email,
    '859' || lpad(CAST(c.c_custkey AS VARCHAR), 8, '0') AS telefone FROM customer c),
checked AS (SELECT r.*, CASE WHEN NOT regexp_full_match(r.cpf, '[0-9]{11}') THEN 'INVALID_CPF'
    WHEN EXISTS (SELECT 1 FROM usuario u WHERE u.username = r.username OR u.cpf = r.cpf) THEN 'USER_OR_CPF_EXISTS'
    WHEN EXISTS (SELECT 1 FROM cliente k WHERE k.cpf = r.cpf) THEN 'CUSTOMER_EXISTS' END AS why FROM req r),
-- Only a user name is ever asked for twice, and by two requests at most.
second AS (SELECT * EXCLUDE (why), CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY username, why IS NULL ORDER BY seq) > 1
    THEN 'USER_OR_CPF_EXISTS' ELSE why END AS why FROM checked),
opened AS (SELECT *, CASE WHEN why IS NULL THEN row_number() OVER (PARTITION BY why IS NULL ORDER BY seq) END AS k FROM second)
"""
_NUM = "CAST((SELECT max(num_conta) FROM conta) + k AS INT)"
_USER_ID = "CAST((SELECT max(id) FROM usuario) + k AS BIGINT)"

_CUSTOMER = """cpf, c_name AS nome_completo, '' AS rg_numero, '' AS rg_orgao, '' AS rg_uf, {born} AS data_nascimento,
    CAST(NULL AS VARCHAR) AS tipo_logradouro, CAST(NULL AS VARCHAR) AS nome_logradouro, CAST(NULL AS VARCHAR) AS numero,
    CAST(NULL AS VARCHAR) AS complemento, CAST(NULL AS VARCHAR) AS bairro, CAST(NULL AS VARCHAR) AS cep,
    CAST(NULL AS VARCHAR) AS cidade, CAST(NULL AS VARCHAR) AS estado"""

_EMPLOYEES = """
hire AS (SELECT CAST(s.s_suppkey AS BIGINT) AS seq, 'Novo ' || s.s_name AS nome, CAST(s.s_nationkey AS INT) AS num_ag,
    CASE WHEN s.s_suppkey % 9 = 0 THEN 1000.0 ELSE 2300.0 + abs(s.s_acctbal) END AS salario, md5(s.s_name) AS senha FROM supplier s),
hired AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM hire WHERE salario >= 2286.0),
named AS (SELECT *, 'MAT' || CAST((SELECT max(CAST(substr(matricula, 4) AS BIGINT)) FROM funcionario) + k AS VARCHAR) AS matricula FROM hired),
edited AS (SELECT f.* EXCLUDE (salario, num_ag, senha), f.salario + 10 AS salario,
    CAST((f.num_ag + CASE WHEN CAST(f.cep AS BIGINT) % 4 = 0 THEN 1 ELSE 0 END) % 25 AS INT) AS num_ag,
    CASE WHEN CAST(f.cep AS BIGINT) % 5 = 0 THEN md5(f.matricula) ELSE f.senha END AS senha FROM funcionario f)
"""

_RISE = """
req AS (SELECT u.id * 3 + t.k AS seq, u.id, u.cpf, u.nome, CASE WHEN t.k = 1 THEN 'admin' ELSE 'gerente' END AS novo,
    t.k = 0 AND u.id % 11 = 0 AS oneself, u.id % 2 = 0 AS by_admin
    FROM usuario u, (SELECT unnest([0, 1, 2]) AS k) t WHERE u.role = 'client'),
first_rise AS (SELECT id, min(seq) AS s1 FROM req WHERE novo = 'gerente' AND NOT oneself GROUP BY id),
second_rise AS (SELECT r.id, min(r.seq) AS s2 FROM req r JOIN first_rise f ON f.id = r.id
    WHERE r.novo = 'admin' AND r.by_admin AND NOT r.oneself AND r.seq > f.s1 GROUP BY r.id),
risen AS (SELECT f.id, f.s1, s.s2, 'MAT' || CAST((SELECT max(CAST(substr(matricula, 4) AS BIGINT)) FROM funcionario)
    + row_number() OVER (ORDER BY f.s1) AS VARCHAR) AS matricula FROM first_rise f LEFT JOIN second_rise s ON s.id = f.id)
"""

_SQL = {
    "open_accounts": (_OPEN, "SELECT seq, COALESCE(why, 'ACCEPTED') AS status, num AS num_conta FROM opened"),
    "open_accounts_conta": (_OPEN, "SELECT num AS num_conta, valor AS saldo, senha, 'poupança' AS tipo_conta, CAST(0.5 AS DOUBLE) AS "
                            "taxa_juros, CAST(NULL AS DOUBLE) AS limite_credito, DATE '2001-07-01' AS data_aniversario_contrato, "
                            "num_ag, manager AS matricula_gerente FROM opened WHERE why IS NULL"),
    "open_accounts_titularidade_conta": (_OPEN, "SELECT num AS num_conta, cpf AS cpf_cliente, '1º titular' AS tipo_titular FROM opened "
                                         "WHERE why IS NULL"),
    "open_accounts_cliente": (_OPEN, f"SELECT {_CUSTOMER.format(born="DATE '1990-01-01'")} FROM opened WHERE why IS NULL AND creates"),
    "open_accounts_transacao": (_OPEN, "SELECT seq, 1 AS num_transacao, num AS num_conta, 'depósito' AS tipo, "
                                "TIMESTAMP '2001-07-01 00:00:00' AS data_hora, valor FROM opened WHERE why IS NULL AND valor > 0"),
    "register_customers": (_REGISTER, f"SELECT seq, COALESCE(why, 'ACCEPTED') AS status, {_NUM} AS num_conta FROM opened"),
    "register_customers_conta": (_REGISTER, f"SELECT {_NUM} AS num_conta, CAST(1000.0 AS DOUBLE) AS saldo, sha256(c_name) AS senha, "
                                 "'conta-corrente' AS tipo_conta, CAST(NULL AS DOUBLE) AS taxa_juros, CAST(NULL AS DOUBLE) AS "
                                 "limite_credito, DATE '2001-07-01' AS data_aniversario_contrato, (SELECT min(num_ag) FROM agencia) AS "
                                 "num_ag, (SELECT min(matricula) FROM funcionario WHERE cargo = 'gerente') AS matricula_gerente "
                                 "FROM opened WHERE why IS NULL"),
    "register_customers_titularidade_conta": (_REGISTER, f"SELECT {_NUM} AS num_conta, cpf AS cpf_cliente, '1º titular' AS tipo_titular "
                                              "FROM opened WHERE why IS NULL"),
    "register_customers_cliente": (_REGISTER, f"SELECT {_CUSTOMER.format(born="DATE '1985-05-05'")} FROM opened WHERE why IS NULL"),
    "register_customers_email_cliente": (_REGISTER, "SELECT cpf AS cpf_cliente, email, 'pessoal' AS descricao FROM opened WHERE why IS NULL"),
    "register_customers_telefone_cliente": (_REGISTER, "SELECT cpf AS cpf_cliente, telefone, 'celular' AS descricao FROM opened "
                                            "WHERE why IS NULL"),
    "register_customers_usuario": (_REGISTER, f"SELECT {_USER_ID} AS id, username, c_name AS nome, sha256(c_name) AS senha, 'client' AS "
                                   "role, cpf, CAST(NULL AS VARCHAR) AS matricula FROM opened WHERE why IS NULL"),
    "register_customers_transacao": (_REGISTER, f"SELECT seq, 1 AS num_transacao, {_NUM} AS num_conta, 'depósito' AS tipo, "
                                     "TIMESTAMP '2001-07-01 00:00:00' AS data_hora, CAST(1000.0 AS DOUBLE) AS valor FROM opened "
                                     "WHERE why IS NULL"),
    "apply_employees": (_EMPLOYEES, "SELECT seq, 'ACCEPTED' AS status, matricula FROM named UNION ALL "
                        "SELECT seq, 'SALARY_BELOW_FLOOR', CAST(NULL AS VARCHAR) FROM hire WHERE salario < 2286.0 UNION ALL "
                        "SELECT CAST(cep AS BIGINT) + 1000000000, 'ACCEPTED', CAST(NULL AS VARCHAR) FROM funcionario"),
    "apply_employees_funcionario": (_EMPLOYEES, "SELECT matricula, nome_completo, senha, tipo_logradouro, nome_logradouro, numero, "
                                    "complemento, bairro, cidade, estado, cep, cargo, genero, data_nascimento, salario, num_ag FROM edited "
                                    "UNION ALL SELECT matricula, nome, senha, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'caixa', "
                                    "'feminino', DATE '1991-01-01', salario, num_ag FROM named"),
    "apply_employees_usuario": (_EMPLOYEES, "SELECT u.id, u.username, COALESCE(e.nome_completo, u.nome) AS nome, "
                                "CASE WHEN CAST(e.cep AS BIGINT) % 5 = 0 THEN e.senha ELSE u.senha END AS senha, "
                                "COALESCE(e.cargo, u.role) AS role, u.cpf, u.matricula FROM usuario u "
                                "LEFT JOIN edited e ON e.matricula = u.matricula UNION ALL "
                                "SELECT CAST((SELECT max(id) FROM usuario) + k AS BIGINT), matricula, nome, senha, 'caixa', "
                                "CAST(NULL AS VARCHAR), matricula FROM named"),
    "apply_employees_agencia": (_EMPLOYEES, "SELECT a.num_ag, a.nome_ag, CAST(a.sal_total + COALESCE(d.d, 0) AS DOUBLE) AS sal_total, "
                                "a.cidade FROM agencia a LEFT JOIN (SELECT num_ag, sum(CAST(s AS DECIMAL(18, 2))) AS d FROM ("
                                "SELECT num_ag, salario AS s FROM edited UNION ALL SELECT num_ag, salario FROM named UNION ALL "
                                "SELECT num_ag, -salario FROM funcionario) x GROUP BY num_ag) d ON d.num_ag = a.num_ag"),
    "apply_promotions": (_RISE, "SELECT r.seq, CASE WHEN r.oneself THEN 'SELF_PROMOTION' WHEN r.seq = f.s1 OR r.seq = s.s2 "
                         "THEN 'ACCEPTED' ELSE 'NOT_ALLOWED' END AS status FROM req r LEFT JOIN first_rise f ON f.id = r.id "
                         "LEFT JOIN second_rise s ON s.id = r.id"),
    "apply_promotions_usuario": (_RISE, "SELECT u.id, u.username, u.nome, u.senha, CASE WHEN r.s2 IS NOT NULL THEN 'admin' WHEN r.s1 IS "
                                 "NOT NULL THEN 'gerente' ELSE u.role END AS role, u.cpf, COALESCE(r.matricula, u.matricula) AS matricula "
                                 "FROM usuario u LEFT JOIN risen r ON r.id = u.id"),
    "apply_promotions_funcionario": (_RISE, "SELECT matricula, nome_completo, senha, tipo_logradouro, nome_logradouro, numero, complemento, "
                                     "bairro, cidade, estado, cep, cargo, genero, data_nascimento, salario, num_ag FROM funcionario UNION ALL "
                                     "SELECT r.matricula, u.nome, 'hashsenha123', k.tipo_logradouro, k.nome_logradouro, k.numero, "
                                     "k.complemento, k.bairro, k.cidade, k.estado, k.cep, 'gerente', 'não-binário', k.data_nascimento, "
                                     "CAST(3000.0 AS DOUBLE), 1 FROM risen r JOIN usuario u ON u.id = r.id JOIN cliente k ON k.cpf = u.cpf"),
}


def change_oracles() -> dict[str, str]:
    return {name: oracle_with(f"WITH {ctes.strip()}\n{body}") for name, (ctes, body) in _SQL.items()}
