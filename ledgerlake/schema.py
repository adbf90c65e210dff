"""Table schemas, enum domains and the ``Bank`` snapshot container."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Enum domains in declaration (rank) order, as the bank schema
# declares them. ORDER BY on these columns sorts by this rank, not by text.
CARGO = ["gerente", "atendente", "caixa"]
GENERO = ["masculino", "feminino", "não-binário"]
PARENTESCO = ["filho(a)", "cônjuge", "genitor(a)"]
TIPO_CONTA = ["conta-corrente", "poupança", "conta especial"]
TIPO_TITULAR = ["1º titular", "2º titular"]
TIPO_TRANSACAO = ["saque", "depósito", "pagamento", "estorno", "transferência", "PIX"]
ROLE = ["client", "atendente", "caixa", "gerente", "admin"]

# Posting rules of the balance trigger.
DEBIT_KINDS = ["saque", "pagamento", "transferência", "PIX"]
CREDIT_KINDS = ["depósito", "estorno"]
SALARY_FLOOR = 2286.00
MAX_DEPENDENTS = 5
MAX_HOLDERS = 2

# Defaults used by the self-registration and promotion flows.
DEFAULT_PASSWORD_LITERAL = "hashsenha123"
FIRST_ACCOUNT_NUMBER = 50502
FIRST_MATRICULA_NUMBER = 1000
REGISTRATION_DEPOSIT = 1000.00
PROMOTION_SALARY = 3000.00

MONEY = T.DecimalType(18, 2)


def _s(name: str, typ: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, typ, nullable)


_ADDRESS = [
    _s("tipo_logradouro", T.StringType()),
    _s("nome_logradouro", T.StringType()),
    _s("numero", T.StringType()),
    _s("complemento", T.StringType()),
    _s("bairro", T.StringType()),
]

AGENCIA = T.StructType([
    _s("num_ag", T.IntegerType(), False),
    _s("nome_ag", T.StringType(), False),
    _s("sal_total", T.DoubleType()),
    _s("cidade", T.StringType(), False),
])

FUNCIONARIO = T.StructType([
    _s("matricula", T.StringType(), False),
    _s("nome_completo", T.StringType(), False),
    _s("senha", T.StringType(), False),
    *_ADDRESS,
    _s("cidade", T.StringType()),
    _s("estado", T.StringType()),
    _s("cep", T.StringType()),
    _s("cargo", T.StringType(), False),
    _s("genero", T.StringType(), False),
    _s("data_nascimento", T.DateType(), False),
    _s("salario", T.DoubleType(), False),
    _s("num_ag", T.IntegerType(), False),
])

DEPENDENTE = T.StructType([
    _s("nome_completo", T.StringType(), False),
    _s("matricula_func", T.StringType(), False),
    _s("data_nascimento", T.DateType(), False),
    _s("parentesco", T.StringType(), False),
    _s("idade", T.IntegerType()),
])

CLIENTE = T.StructType([
    _s("cpf", T.StringType(), False),
    _s("nome_completo", T.StringType(), False),
    _s("rg_numero", T.StringType(), False),
    _s("rg_orgao", T.StringType(), False),
    _s("rg_uf", T.StringType(), False),
    _s("data_nascimento", T.DateType(), False),
    *_ADDRESS,
    _s("cep", T.StringType()),
    _s("cidade", T.StringType()),
    _s("estado", T.StringType()),
])

TELEFONE_CLIENTE = T.StructType([
    _s("cpf_cliente", T.StringType(), False),
    _s("telefone", T.StringType(), False),
    _s("descricao", T.StringType()),
])

EMAIL_CLIENTE = T.StructType([
    _s("cpf_cliente", T.StringType(), False),
    _s("email", T.StringType(), False),
    _s("descricao", T.StringType()),
])

CONTA = T.StructType([
    _s("num_conta", T.IntegerType(), False),
    _s("saldo", T.DoubleType()),
    _s("senha", T.StringType(), False),
    _s("tipo_conta", T.StringType(), False),
    _s("taxa_juros", T.DoubleType()),
    _s("limite_credito", T.DoubleType()),
    _s("data_aniversario_contrato", T.DateType()),
    _s("num_ag", T.IntegerType(), False),
    _s("matricula_gerente", T.StringType(), False),
])

TITULARIDADE = T.StructType([
    _s("num_conta", T.IntegerType(), False),
    _s("cpf_cliente", T.StringType(), False),
    _s("tipo_titular", T.StringType(), False),
])

TRANSACAO = T.StructType([
    _s("id_transacao", T.LongType(), False),
    _s("num_transacao", T.IntegerType(), False),
    _s("num_conta", T.IntegerType(), False),
    _s("tipo", T.StringType(), False),
    _s("data_hora", T.TimestampNTZType(), False),
    _s("valor", T.DoubleType(), False),
])

USUARIO = T.StructType([
    _s("id", T.LongType(), False),
    _s("username", T.StringType(), False),
    _s("nome", T.StringType(), False),
    _s("senha", T.StringType(), False),
    _s("role", T.StringType(), False),
    _s("cpf", T.StringType()),
    _s("matricula", T.StringType()),
])

TABLES: dict[str, T.StructType] = {
    "agencia": AGENCIA,
    "funcionario": FUNCIONARIO,
    "dependente": DEPENDENTE,
    "cliente": CLIENTE,
    "telefone_cliente": TELEFONE_CLIENTE,
    "email_cliente": EMAIL_CLIENTE,
    "conta": CONTA,
    "titularidade_conta": TITULARIDADE,
    "transacao": TRANSACAO,
    "usuario": USUARIO,
}

# Keys and references, used by the integrity validators.
PRIMARY_KEYS: dict[str, list[list[str]]] = {
    "agencia": [["num_ag"]],
    "funcionario": [["matricula"]],
    "dependente": [["matricula_func", "nome_completo"]],
    "cliente": [["cpf"]],
    "telefone_cliente": [["cpf_cliente", "telefone"]],
    "email_cliente": [["cpf_cliente", "email"]],
    "conta": [["num_conta"]],
    "titularidade_conta": [["num_conta", "cpf_cliente"], ["num_conta", "tipo_titular"]],
    "transacao": [["id_transacao"], ["num_conta", "num_transacao"]],
    "usuario": [["id"], ["username"], ["cpf"], ["matricula"]],
}

FOREIGN_KEYS: list[tuple[str, list[str], str, list[str]]] = [
    ("funcionario", ["num_ag"], "agencia", ["num_ag"]),
    ("dependente", ["matricula_func"], "funcionario", ["matricula"]),
    ("telefone_cliente", ["cpf_cliente"], "cliente", ["cpf"]),
    ("email_cliente", ["cpf_cliente"], "cliente", ["cpf"]),
    ("conta", ["num_ag"], "agencia", ["num_ag"]),
    ("conta", ["matricula_gerente"], "funcionario", ["matricula"]),
    ("titularidade_conta", ["num_conta"], "conta", ["num_conta"]),
    ("titularidade_conta", ["cpf_cliente"], "cliente", ["cpf"]),
    ("transacao", ["num_conta"], "conta", ["num_conta"]),
    ("usuario", ["cpf"], "cliente", ["cpf"]),
    ("usuario", ["matricula"], "funcionario", ["matricula"]),
]

# Fixed value: the manager of accounts that an administrator opens.
DEFAULT_MANAGER = "MAT1001"

ENUM_COLUMNS: dict[str, dict[str, list[str]]] = {
    "funcionario": {"cargo": CARGO, "genero": GENERO},
    "dependente": {"parentesco": PARENTESCO},
    "conta": {"tipo_conta": TIPO_CONTA},
    "titularidade_conta": {"tipo_titular": TIPO_TITULAR},
    "transacao": {"tipo": TIPO_TRANSACAO},
    "usuario": {"role": ROLE},
}

# VARCHAR/CHAR limits of the bank schema.
MAX_LENGTHS: dict[str, dict[str, int]] = {
    "agencia": {"nome_ag": 100, "cidade": 100},
    "funcionario": {"matricula": 20, "nome_completo": 150, "senha": 255, "tipo_logradouro": 30,
                    "nome_logradouro": 100, "numero": 10, "complemento": 50, "bairro": 50,
                    "cidade": 100, "estado": 2, "cep": 8},
    "dependente": {"nome_completo": 150, "matricula_func": 20},
    "cliente": {"cpf": 11, "nome_completo": 150, "rg_numero": 15, "rg_orgao": 20, "rg_uf": 2,
                "tipo_logradouro": 30, "nome_logradouro": 100, "numero": 10, "complemento": 50,
                "bairro": 50, "cep": 8, "cidade": 100, "estado": 2},
    "telefone_cliente": {"cpf_cliente": 11, "telefone": 11, "descricao": 30},
    "email_cliente": {"cpf_cliente": 11, "email": 254, "descricao": 30},
    "conta": {"senha": 255, "matricula_gerente": 20},
    "titularidade_conta": {"cpf_cliente": 11},
    "usuario": {"username": 50, "nome": 150, "senha": 255, "cpf": 11, "matricula": 20},
}


class Bank:
    """An immutable snapshot of the ten bank tables as DataFrames.

    Tables may be given as DataFrames or as zero-argument callables; a
    callable is resolved on first access, so a report only plans the
    tables it reads.
    """

    TABLE_NAMES = tuple(TABLES)

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        missing = set(self.TABLE_NAMES) - set(tables)
        if missing:
            raise TypeError(f"missing tables: {sorted(missing)}")
        object.__setattr__(self, "_src", dict(tables))
        object.__setattr__(self, "_cache", {})

    def __getattr__(self, name: str) -> DataFrame:
        src = self.__dict__.get("_src", {})
        if name not in src:
            raise AttributeError(name)
        cache = self.__dict__["_cache"]
        if name not in cache:
            v = src[name]
            cache[name] = v() if callable(v) and not isinstance(v, DataFrame) else v
        return cache[name]

    def __setattr__(self, name, value):
        raise AttributeError("Bank is immutable; use with_tables")

    def with_tables(self, **tables: DataFrame) -> "Bank":
        merged = dict(self.__dict__["_src"])
        merged.update(tables)
        return Bank(**merged)

    def as_dict(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in self.TABLE_NAMES}
