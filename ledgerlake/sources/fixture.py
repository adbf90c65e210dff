"""The driver's TPC-H-like tables seen as a bank.

One dictionary of view specs feeds both engines: Spark builds each view with
DataFrame joins plus ``selectExpr`` over the column expressions below, and the
DuckDB oracle gets the very same expressions as leading CTEs. Every
expression is written in the common subset of both SQL dialects.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.schema import Bank
from ledgerlake.session import shuffled

# Parameters of the fixture reports.
AS_OF = "2001-07-01 00:00:00"
PARAMS = {
    "branch": 7,
    "employee_branch": 15,
    "city": "ASIA",
    "coholder_cpf": "00000000011",
    "activity_cpf": "00000000033",
    "manager": "MAT1004",
    "account": 50512,
}

# Fixed schemas of the driver's tables (no inference at read time).
RAW_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
}
RAW_TABLES = list(RAW_SCHEMAS)
FEW_ROWS = ("region", "nation")  # tables that do not grow with the data


@dataclass(frozen=True)
class View:
    """SELECT <cols> FROM <sources joined> [WHERE <where>]."""

    sources: list[tuple[str, str, str | None, str]]  # (raw table, alias, join condition, join type)
    cols: list[tuple[str, str]]  # (output name, expression)
    where: str | None = None


@dataclass(frozen=True)
class UnionView:
    parts: list[View] = field(default_factory=list)


def _cpf(key: str) -> str:
    return f"lpad(CAST({key} AS STRING), 11, '0')"


def _mat(num: str) -> str:
    return f"'MAT' || CAST({num} AS STRING)"


def _digest(a: str, b: str) -> str:
    # A 64-hex-character secret (two md5 digests), the shape of a SHA-256 hex digest.
    return f"md5({a}) || md5(CAST({b} AS STRING))"


_CARGO = "CASE {k} % 3 WHEN 0 THEN 'gerente' WHEN 1 THEN 'atendente' ELSE 'caixa' END"
_GENERO = "CASE {k} % 3 WHEN 0 THEN 'masculino' WHEN 1 THEN 'feminino' ELSE 'não-binário' END"
_PARENTESCO = "CASE {k} % 3 WHEN 0 THEN 'filho(a)' WHEN 1 THEN 'cônjuge' ELSE 'genitor(a)' END"


def _funcionario(salary: str) -> View:
    return View(
        sources=[("supplier", "s", None, "inner")],
        cols=[
            ("matricula", _mat("1001 + s.s_suppkey")),
            ("nome_completo", "s.s_name"),
            ("senha", _FUNC_SENHA),
            ("tipo_logradouro", "'Rua'"),
            ("nome_logradouro", "'Rua ' || CAST(s.s_suppkey % 97 AS STRING)"),
            ("numero", "CAST(s.s_suppkey % 1000 AS STRING)"),
            ("complemento", "CAST(NULL AS STRING)"),
            ("bairro", "'Centro'"),
            ("cidade", "CAST(NULL AS STRING)"),
            ("estado", "'CE'"),
            ("cep", "lpad(CAST(s.s_suppkey AS STRING), 8, '0')"),
            ("cargo", _CARGO.format(k="s.s_suppkey")),
            ("genero", _GENERO.format(k="(s.s_suppkey + s.s_nationkey)")),
            ("data_nascimento", "DATE '1960-01-01' + CAST((s.s_suppkey * 397) % 14000 AS INT)"),
            ("salario", salary),
            ("num_ag", "CAST(s.s_nationkey AS INT)"),
        ],
    )


def _dependente(modulus: int) -> View:
    return View(
        sources=[("part", "p", None, "inner")],
        cols=[
            ("nome_completo", "p.p_name"),
            ("matricula_func", _mat(f"1001 + p.p_partkey % {modulus}")),
            ("data_nascimento", "DATE '1985-01-01' + CAST(p.p_partkey % 5000 AS INT)"),
            ("parentesco", _PARENTESCO.format(k="p.p_partkey")),
            ("idade", "CAST(NULL AS INT)"),
            ("seq", "CAST(p.p_partkey AS BIGINT)"),
        ],
    )


_CONTA_TIPO = ("CASE c.c_mktsegment WHEN 'BUILDING' THEN 'poupança' "
               "WHEN 'MACHINERY' THEN 'conta especial' ELSE 'conta-corrente' END")
_CONTA_SENHA = f"CASE WHEN c.c_custkey % 11 = 3 THEN 'hashsenha123' ELSE {_digest('c.c_name', 'c.c_custkey')} END"
_FUNC_SENHA = f"CASE WHEN s.s_suppkey % 7 = 5 THEN 'hashsenha123' ELSE {_digest('s.s_name', 's.s_suppkey')} END"
_TIPO_TX = ("CASE o.o_orderkey % 6 WHEN 0 THEN 'saque' WHEN 1 THEN 'depósito' WHEN 2 THEN 'pagamento' "
            "WHEN 3 THEN 'estorno' WHEN 4 THEN 'transferência' ELSE 'PIX' END")

VIEWS: dict[str, View | UnionView] = {
    "agencia": View(
        sources=[("nation", "n", None, "inner"), ("region", "r", "n.n_regionkey = r.r_regionkey", "inner")],
        cols=[
            ("num_ag", "CAST(n.n_nationkey AS INT)"),
            ("nome_ag", "n.n_name"),
            ("sal_total", "CAST(0.0 AS DOUBLE)"),
            ("cidade", "r.r_name"),
        ],
    ),
    "funcionario": _funcionario("CAST(2286.0 AS DOUBLE) + abs(s.s_acctbal)"),
    "funcionario_dirty": _funcionario("s.s_acctbal"),
    "dependente": _dependente(7),
    "dependente_dirty": _dependente(1500),
    "cliente": View(
        sources=[("customer", "c", None, "inner"),
                 ("nation", "n", "c.c_nationkey = n.n_nationkey", "inner"),
                 ("region", "r", "n.n_regionkey = r.r_regionkey", "inner")],
        cols=[
            ("cpf", _cpf("c.c_custkey")),
            ("nome_completo", "c.c_name"),
            ("rg_numero", "CAST(c.c_custkey AS STRING)"),
            ("rg_orgao", "'SSP'"),
            ("rg_uf", "'CE'"),
            ("data_nascimento", "DATE '1940-01-01' + CAST((c.c_custkey * 7919) % 22000 AS INT)"),
            ("tipo_logradouro", "'Avenida'"),
            ("nome_logradouro", "n.n_name"),
            ("numero", "CAST(c.c_custkey % 500 AS STRING)"),
            ("complemento", "CAST(NULL AS STRING)"),
            ("bairro", "c.c_mktsegment"),
            ("cep", "lpad(CAST(c.c_custkey AS STRING), 8, '0')"),
            ("cidade", "r.r_name"),
            ("estado", "'CE'"),
        ],
    ),
    "telefone_cliente": UnionView([
        View(sources=[("customer", "c", None, "inner")],
             cols=[("cpf_cliente", _cpf("c.c_custkey")),
                   ("telefone", "'88' || lpad(CAST(c.c_custkey AS STRING), 9, '0')"),
                   ("descricao", "'celular'")]),
        View(sources=[("customer", "c", None, "inner")],
             cols=[("cpf_cliente", _cpf("c.c_custkey")),
                   ("telefone", "'85' || lpad(CAST(c.c_custkey AS STRING), 9, '0')"),
                   ("descricao", "'fixo'")],
             where="c.c_custkey % 3 = 0"),
    ]),
    "email_cliente": View(
        sources=[("customer", "c", None, "inner")],
        cols=[("cpf_cliente", _cpf("c.c_custkey")),
              ("email", "'cliente' || CAST(c.c_custkey AS STRING) || '@example.com'"),
              ("descricao", "'pessoal'")],
    ),
    "conta": View(
        sources=[("customer", "c", None, "inner")],
        cols=[
            ("num_conta", "CAST(50501 + c.c_custkey AS INT)"),
            ("saldo", "c.c_acctbal"),
            ("senha", _CONTA_SENHA),
            ("tipo_conta", _CONTA_TIPO),
            ("taxa_juros", "CASE WHEN c.c_mktsegment = 'BUILDING' THEN CAST(0.5 AS DOUBLE) END"),
            ("limite_credito", "CASE WHEN c.c_mktsegment = 'MACHINERY' THEN CAST(1000.0 AS DOUBLE) END"),
            ("data_aniversario_contrato", "DATE '2000-01-01' + CAST(c.c_custkey % 365 AS INT)"),
            ("num_ag", "CAST(c.c_nationkey AS INT)"),
            ("matricula_gerente", _mat("1001 + 3 * (c.c_custkey % 4)")),
        ],
    ),
    "titularidade_conta": UnionView([
        View(sources=[("customer", "c", None, "inner")],
             cols=[("num_conta", "CAST(50501 + c.c_custkey AS INT)"),
                   ("cpf_cliente", _cpf("c.c_custkey")),
                   ("tipo_titular", "'1º titular'")]),
        View(sources=[("customer", "c", None, "inner"),
                      ("customer", "c2", "c2.c_custkey = c.c_custkey + 1", "inner")],
             cols=[("num_conta", "CAST(50501 + c.c_custkey AS INT)"),
                   ("cpf_cliente", _cpf("c2.c_custkey")),
                   ("tipo_titular", "'2º titular'")],
             where="c.c_custkey % 5 = 0"),
    ]),
    "transacao": View(
        sources=[("orders", "o", None, "inner")],
        cols=[
            ("id_transacao", "CAST(o.o_orderkey AS BIGINT)"),
            ("num_transacao", "CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS INT)"),
            ("num_conta", "CAST(50501 + o.o_custkey AS INT)"),
            ("tipo", _TIPO_TX),
            ("data_hora", "o.o_orderdate"),
            ("valor", "o.o_totalprice"),
        ],
    ),
    "usuario": UnionView([
        View(sources=[("region", "r", None, "inner")],
             cols=[("id", "CAST(1 AS BIGINT)"), ("username", "'Admin'"), ("nome", "'Administrador DBA'"),
                   ("senha", _digest("'Admin'", "'Root'")), ("role", "'admin'"),
                   ("cpf", "CAST(NULL AS STRING)"), ("matricula", "CAST(NULL AS STRING)")],
             where="r.r_regionkey = 0"),
        View(sources=[("supplier", "s", None, "inner")],
             cols=[("id", "CAST(2 + s.s_suppkey AS BIGINT)"), ("username", _mat("1001 + s.s_suppkey")),
                   ("nome", "s.s_name"), ("senha", _FUNC_SENHA),
                   ("role", _CARGO.format(k="s.s_suppkey")),
                   ("cpf", "CAST(NULL AS STRING)"), ("matricula", _mat("1001 + s.s_suppkey"))]),
        View(sources=[("customer", "c", None, "inner")],
             cols=[("id", "CAST(1000000000 + c.c_custkey AS BIGINT)"), ("username", _cpf("c.c_custkey")),
                   ("nome", "c.c_name"), ("senha", _CONTA_SENHA), ("role", "'client'"),
                   ("cpf", _cpf("c.c_custkey")), ("matricula", "CAST(NULL AS STRING)")]),
    ]),
    # Request batch: transfers (one per order of kind 4), with planted unknown
    # requesters, unknown destinations and non-holder requesters.
    "transfer_req": View(
        sources=[("orders", "o", None, "inner")],
        cols=[
            ("seq", "CAST(o.o_orderkey AS BIGINT)"),
            ("solicitante", f"CASE WHEN o.o_orderkey % 60 = 4 THEN {_cpf('o.o_custkey + 1')} "
                            f"WHEN o.o_orderkey % 60 = 10 THEN 'desconhecido' ELSE {_cpf('o.o_custkey')} END"),
            ("conta_origem", "CAST(50501 + o.o_custkey AS INT)"),
            ("conta_destino", "CASE WHEN o.o_orderkey % 60 = 16 THEN 1 ELSE CAST(50501 + o.o_orderkey % 120 AS INT) END"),
            ("valor", "o.o_totalprice"),
            ("num_trans_origem", "CAST(NULL AS INT)"),
            ("num_trans_destino", "CAST(NULL AS INT)"),
        ],
        where="o.o_orderkey % 6 = 4",
    ),
}

# More request batches derived from the driver's tables (changes and holders).
VIEWS.update({
    "cliente_changes": UnionView([
        View(sources=[("customer", "c", None, "inner")],
             cols=[("seq", "CAST(c.c_custkey AS BIGINT)"), ("cpf", _cpf("c.c_custkey")),
                   ("bairro", "'Novo ' || c.c_mktsegment"), ("cidade", "CAST(NULL AS STRING)")],
             where="c.c_custkey % 7 = 0"),
        View(sources=[("customer", "c", None, "inner")],
             cols=[("seq", "CAST(c.c_custkey + 100000000 AS BIGINT)"), ("cpf", _cpf("c.c_custkey")),
                   ("bairro", "CAST(NULL AS STRING)"), ("cidade", "'SOBRAL'")],
             where="c.c_custkey % 14 = 0"),
    ]),
    "telefone_req": UnionView([
        View(sources=[("customer", "c", None, "inner")],
             cols=[("seq", "CAST(c.c_custkey AS BIGINT)"), ("cpf_cliente", _cpf("c.c_custkey")),
                   ("telefone", "'88' || lpad(CAST(c.c_custkey AS STRING), 9, '0')"), ("descricao", "'novo'")],
             where="c.c_custkey % 4 = 0"),
        View(sources=[("customer", "c", None, "inner")],
             cols=[("seq", "CAST(c.c_custkey + 100000000 AS BIGINT)"), ("cpf_cliente", _cpf("c.c_custkey")),
                   ("telefone", "'87' || lpad(CAST(c.c_custkey AS STRING), 9, '0')"), ("descricao", "'recado'")],
             where="c.c_custkey % 4 = 0"),
        View(sources=[("customer", "c", None, "inner")],
             cols=[("seq", "CAST(c.c_custkey + 200000000 AS BIGINT)"), ("cpf_cliente", _cpf("c.c_custkey")),
                   ("telefone", "'87' || lpad(CAST(c.c_custkey AS STRING), 9, '0')"), ("descricao", "'repetido'")],
             where="c.c_custkey % 8 = 0"),
    ]),
    # Holder inserts: customer c asks for a holder slot on the account of customer (7c + 3) % 97.
    "holder_req": View(
        sources=[("customer", "c", None, "inner"),
                 ("customer", "c2", "c2.c_custkey = (c.c_custkey * 7 + 3) % 97", "inner")],
        cols=[("seq", "CAST(c.c_custkey AS BIGINT)"),
              ("num_conta", "CAST(50501 + c2.c_custkey AS INT)"),
              ("cpf_cliente", _cpf("c.c_custkey")),
              ("tipo_titular", "CASE WHEN c.c_custkey % 2 = 0 THEN '2º titular' ELSE '1º titular' END")],
    ),
})

# A dirty copy of the accounts with planted schema violations (for the integrity checks).
_conta_cols = dict(VIEWS["conta"].cols)
_conta_cols["tipo_conta"] = f"CASE WHEN c.c_custkey % 13 = 0 THEN 'conta salario' ELSE {_CONTA_TIPO} END"
_conta_cols["matricula_gerente"] = (f"CASE WHEN c.c_custkey % 17 = 0 THEN CAST(NULL AS STRING) "
                                    f"ELSE {_mat('1001 + 3 * (c.c_custkey % 4)')} END")
_conta_cols["senha"] = f"CASE WHEN c.c_custkey % 19 = 0 THEN repeat('x', 300) ELSE {_CONTA_SENHA} END"
VIEWS["conta_dirty"] = View(sources=VIEWS["conta"].sources, cols=list(_conta_cols.items()))

# Users whose role drifted from their employee row: some managers promoted to admin (the allowed pair),
# some attendants recorded as tellers (a real disagreement).
_drift_parts = list(VIEWS["usuario"].parts)
_emp_cols = dict(_drift_parts[1].cols)
_emp_cols["role"] = ("CASE WHEN s.s_suppkey % 6 = 0 THEN 'admin' WHEN s.s_suppkey % 6 = 1 THEN 'caixa' "
                     f"ELSE {_CARGO.format(k='s.s_suppkey')} END")
_drift_parts[1] = View(sources=_drift_parts[1].sources, cols=list(_emp_cols.items()))
VIEWS["usuario_drift"] = UnionView(_drift_parts)

# Holdings with planted violations: a third holder on accounts of customers divisible by 10, and a
# second '1º titular' on accounts of customers divisible by 15 (slot used twice).
VIEWS["titularidade_dirty"] = UnionView(list(VIEWS["titularidade_conta"].parts) + [
    View(sources=[("customer", "c", None, "inner"), ("customer", "c3", "c3.c_custkey = c.c_custkey + 2", "inner")],
         cols=[("num_conta", "CAST(50501 + c.c_custkey AS INT)"), ("cpf_cliente", _cpf("c3.c_custkey")),
               ("tipo_titular", "'2º titular'")],
         where="c.c_custkey % 10 = 0"),
    View(sources=[("customer", "c", None, "inner"), ("customer", "c4", "c4.c_custkey = c.c_custkey + 3", "inner")],
         cols=[("num_conta", "CAST(50501 + c.c_custkey AS INT)"), ("cpf_cliente", _cpf("c4.c_custkey")),
               ("tipo_titular", "'1º titular'")],
         where="c.c_custkey % 15 = 0"),
])

BANK_TABLES = ["agencia", "funcionario", "dependente", "cliente", "telefone_cliente", "email_cliente",
               "conta", "titularidade_conta", "transacao", "usuario"]


# ---------------------------------------------------------------- DuckDB side

def _view_sql(v: View) -> str:
    cols = ", ".join(f"{expr} AS {name}" for name, expr in v.cols)
    table, alias, _, _ = v.sources[0]
    frm = f"{table} {alias}"
    for table, alias, cond, how in v.sources[1:]:
        frm += f" {'LEFT' if how == 'left' else 'INNER'} JOIN {table} {alias} ON {cond}"
    where = f" WHERE {v.where}" if v.where else ""
    return f"SELECT {cols} FROM {frm}{where}"


def view_sql(name: str) -> str:
    v = VIEWS[name]
    if isinstance(v, UnionView):
        return " UNION ALL ".join(_view_sql(p) for p in v.parts)
    return _view_sql(v)


def oracle_with(body: str, views: list[str] | None = None) -> str:
    """Prefix ``body`` with the fixture views as CTEs (only those it names)."""
    names = views if views is not None else [n for n in VIEWS if _mentions(body, n)]
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({view_sql(n)})" for n in names)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


def _mentions(body: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", body) is not None


# ----------------------------------------------------------------- Spark side

class Fixture:
    """Lazily built fixture views over one directory of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    _raw_cache: dict

    def raw(self, name: str) -> DataFrame:
        cache = self.__dict__.setdefault("_raw_cache", {})
        if name not in cache:
            cache[name] = self.spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        return cache[name]

    def _build(self, v: View) -> DataFrame:
        table, alias, _, _ = v.sources[0]
        df = self.raw(table).alias(alias)
        for table, alias, cond, how in v.sources[1:]:
            side = self.raw(table).alias(alias)
            df = df.join(side if table in FEW_ROWS else shuffled(side), F.expr(cond), how)
        if v.where:
            df = df.where(v.where)
        return df.selectExpr(*[f"{expr} AS {name}" for name, expr in v.cols])

    def view(self, name: str) -> DataFrame:
        v = VIEWS[name]
        if isinstance(v, UnionView):
            return reduce(DataFrame.unionByName, [self._build(p) for p in v.parts])
        return self._build(v)

    def bank(self) -> Bank:
        tables = {n: (lambda n=n: self.view(n)) for n in BANK_TABLES}
        tables["dependente"] = lambda: self.view("dependente").drop("seq")
        return Bank(**tables)


def fixture_bank(spark: SparkSession, sf_dir: str) -> Bank:
    return Fixture(spark, sf_dir).bank()


def stream_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream (one micro-batch per file; the folder holds one file per table)."""
    d = sf_dir.rstrip("/")
    return (spark.readStream.schema(RAW_SCHEMAS[name]).option("basePath", d)
            .option("maxFilesPerTrigger", 1).parquet(f"{d}/{name}*.parquet"))


def stream_view(spark: SparkSession, sf_dir: str, name: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """A single-source fixture view over a file stream (stateless expressions only)."""
    v = VIEWS[name]
    if isinstance(v, UnionView) or len(v.sources) != 1:
        raise ValueError(f"{name} is not a single-source view")
    table, alias, _, _ = v.sources[0]
    df = stream_raw(spark, sf_dir, table).alias(alias)
    if v.where:
        df = df.where(v.where)
    return df.selectExpr(*[f"{expr} AS {n}" for n, expr in v.cols if n not in drop])
