"""Composite requests of the bank screens (I9-I14), all-or-nothing per request.

Each handler takes the snapshot and a request batch (with arrival ``seq``)
and returns a ``Result``: one decision per request (``status`` ACCEPTED or
a reason, plus the numbers assigned) and the new rows or tables it
produces. Checks run in the screens' order; order-dependent rules (unique
keys, one account per customer per branch, the dependent limit) use the
batch operators of ``changes``; numbers are assigned to accepted requests
only, in arrival order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.exprs import age_years, money, phone_digits, sha256_hex
from ledgerlake.operators import changes as I
from ledgerlake.operators.access import authorize_cash
from ledgerlake.operators.ledger import balances_after, post
from ledgerlake.session import cut_lineage
from ledgerlake.schema import (DEFAULT_MANAGER, DEFAULT_PASSWORD_LITERAL, MAX_DEPENDENTS, PARENTESCO, PROMOTION_SALARY, REGISTRATION_DEPOSIT,
                               SALARY_FLOOR, TIPO_CONTA, Bank)

ACCEPTED = "ACCEPTED"


@dataclass
class Result:
    decisions: DataFrame
    rows: dict[str, DataFrame] = field(default_factory=dict)


def _first_reason(checks: list[tuple[F.Column, str]]) -> F.Column:
    expr = None
    for cond, name in checks:
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def _deposit_rows(accounts: DataFrame, amount_col: str, as_of) -> DataFrame:
    """Opening deposits (number 1 of a new account) as transaction requests."""
    ts = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else F.localtimestamp()
    return accounts.where(F.col(amount_col) > 0).select(
        F.col("seq").cast("long").alias("seq"), F.lit(1).alias("num_transacao"), "num_conta",
        F.lit("depósito").alias("tipo"), ts.alias("data_hora"), F.col(amount_col).cast("double").alias("valor"))


# -------------------------------------------------------------------- I9

# Columns of a new customer that a request may leave out (NULL, or empty where the table forbids NULL).
_OPTIONAL = ["rg_numero", "rg_orgao", "rg_uf", "tipo_logradouro", "nome_logradouro", "numero", "complemento", "bairro",
             "cep", "cidade", "estado", "email", "telefone", "username", "senha"]


def _filled(requests: DataFrame) -> DataFrame:
    return requests.withColumns({x: F.lit(None).cast("string") for x in _OPTIONAL if x not in requests.columns})


def _customer_rows(b: Bank, new: DataFrame) -> dict[str, DataFrame]:
    """Customer, contact and user rows of accepted new customers (``new`` has the request columns and ``seq``)."""
    c = F.col
    required = {"rg_numero", "rg_orgao", "rg_uf"}
    cliente = new.select(*[F.coalesce(c(x), F.lit("")).alias(x) if x in required else c(x) for x in b.cliente.columns])
    given = lambda x: c(x).isNotNull() & (c(x) != "")
    users = I.assign_global(new.where(given("username")), b.usuario.agg(F.coalesce(F.max("id"), F.lit(0))).scalar(), out="id")
    return {
        "cliente": cliente,
        "email_cliente": new.where(given("email")).select(c("cpf").alias("cpf_cliente"), "email", F.lit("pessoal").alias("descricao")),
        "telefone_cliente": new.where(given("telefone")).select(
            c("cpf").alias("cpf_cliente"), phone_digits("telefone").alias("telefone"), F.lit("celular").alias("descricao")),
        "usuario": users.select(c("id").cast(b.usuario.schema["id"].dataType).alias("id"), "username",
                                c("nome_completo").alias("nome"), sha256_hex("senha").alias("senha"),
                                F.lit("client").alias("role"), "cpf", F.lit(None).cast("string").alias("matricula")),
    }


def _opened(conta: DataFrame, deposits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New accounts with the balance after their deposits, and the accepted deposits."""
    posted = post(conta.select("num_conta", "saldo", "tipo_conta", "limite_credito"), deposits, seq="seq")
    rows = posted.accepted.drop("status", "saldo_apos")
    return balances_after(conta, posted).select(*conta.columns), rows


def open_accounts(b: Bank, requests: DataFrame, as_of=None) -> Result:
    """Open accounts for existing or new customers.

    ``requests``: seq, cpf, nome_completo (new customer only, else NULL),
    data_nascimento, tipo_conta, saldo_inicial, senha_hash, num_ag,
    taxa_juros, limite_credito, requester_role, requester_matricula, and
    optionally a new customer's other columns, contacts, username and senha.

    The account's manager is the requesting manager, or the fixed default
    for an admin. In arrival order, the first valid request that creates a
    CPF registers the customer; a later one, or one for a stored CPF, is a
    key error; a request that uses the CPF is accepted from then on.
    """
    c = F.col
    known = b.cliente.select("cpf", F.lit(True).alias("_known_cpf"))
    ag = b.agencia.select("num_ag", F.lit(True).alias("_known_ag"))
    mgr = b.funcionario.select(c("matricula").alias("_manager"), F.lit(True).alias("_known_mgr"))
    names = b.usuario.select("username", F.lit(True).alias("_known_user"))
    r = _filled(requests).withColumn("_manager", F.when(c("requester_role") == "gerente", c("requester_matricula"))
                                     .otherwise(F.lit(DEFAULT_MANAGER)))
    r = (r.join(known, "cpf", "left").join(ag, "num_ag", "left").join(mgr, "_manager", "left")
         .join(names, "username", "left").withColumn("_creates", c("nome_completo").isNotNull()))
    reason = _first_reason([
        (~c("requester_role").isin("gerente", "admin"), "ROLE_NOT_ALLOWED"),
        (c("_known_mgr").isNull(), "MANAGER_NOT_FOUND"),
        (~c("cpf").rlike(r"^[0-9]{11}$"), "INVALID_CPF"),
        (~c("tipo_conta").isin(TIPO_CONTA), "INVALID_TYPE"),
        (c("_known_ag").isNull(), "UNKNOWN_BRANCH"),
        (c("saldo_inicial") < 0, "NEGATIVE_OPENING_BALANCE"),
        ((c("tipo_conta") == "poupança") & ((c("taxa_juros") < 0) | (c("taxa_juros") > 100)), "INVALID_RATE"),
        ((c("tipo_conta") == "conta especial") & (c("limite_credito") < 0), "INVALID_LIMIT"),
        (c("_creates") & c("_known_cpf").isNotNull(), "CUSTOMER_EXISTS"),
        (c("_creates") & c("_known_user").isNotNull(), "USER_EXISTS"),
    ])
    r = r.withColumn("_pre", reason)
    # A new CPF has no account yet, so its creation cannot fail later: creations are settled first.
    creates, _ = I.greedy_unique(r.where(c("_pre").isNull() & c("_creates")), "seq", [["cpf"], ["username"]])
    made = creates.where("accepted").select(c("cpf").alias("_cpf"), c("seq").alias("_made"))
    lost = creates.where(~c("accepted")).select(c("seq").alias("_lost"), "_clash")
    r = r.join(made, c("cpf") == c("_cpf"), "left").join(lost, c("seq") == c("_lost"), "left")
    r = r.withColumn("_pre", F.coalesce(c("_pre"), _first_reason([
        (c("_lost").isNotNull() & (c("_clash") == 1), "USER_EXISTS"),
        (c("_lost").isNotNull(), "CUSTOMER_EXISTS"),
        (~c("_creates") & c("_known_cpf").isNull() & (c("_made").isNull() | (c("seq") < c("_made"))), "CUSTOMER_NOT_FOUND"),
    ])))
    # One account per customer per branch: stored holdings first, then arrival order in the batch.
    held = (b.titularidade_conta.join(b.conta.select("num_conta", "num_ag"), "num_conta")
            .select(c("cpf_cliente").alias("cpf"), "num_ag").distinct().withColumn("_held", F.lit(True)))
    r = r.join(held, ["cpf", "num_ag"], "left").withColumn("_pre", F.coalesce(c("_pre"), F.when(
        c("_held").isNotNull(), F.lit("ONE_ACCOUNT_PER_BRANCH"))))
    greedy, _ = I.greedy_unique(r.where(c("_pre").isNull()).drop("_clash"), "seq", [["cpf", "num_ag"]])
    ok = greedy.where("accepted").drop("accepted", "_clash")
    numbered = I.assign_global(ok, I.next_account_base(b.conta).scalar(), out="num_conta")
    numbered = I.conform_account_terms(numbered.withColumn("num_conta", c("num_conta").cast("int")))
    conta = numbered.select("num_conta", F.lit(0.0).alias("saldo"), c("senha_hash").alias("senha"), "tipo_conta",
                            "taxa_juros", "limite_credito",
                            F.lit(as_of).cast("date").alias("data_aniversario_contrato") if as_of else
                            F.current_date().alias("data_aniversario_contrato"),
                            "num_ag", c("_manager").alias("matricula_gerente"))
    holders = numbered.select("num_conta", c("cpf").alias("cpf_cliente"), F.lit("1º titular").alias("tipo_titular"))
    conta, deposits = _opened(conta, _deposit_rows(numbered, "saldo_inicial", as_of))
    none = F.lit(None).cast("int").alias("num_conta")
    decisions = (numbered.select("seq", F.lit(ACCEPTED).alias("status"), "num_conta")
                 .unionByName(r.where(c("_pre").isNotNull()).select("seq", c("_pre").alias("status"), none))
                 .unionByName(greedy.where(~c("accepted")).select("seq", F.lit("ONE_ACCOUNT_PER_BRANCH").alias("status"), none)))
    return Result(decisions, {"conta": conta, "titularidade_conta": holders, "transacao": deposits,
                              **_customer_rows(b, numbered.where("_creates"))})


# ------------------------------------------------------------------- I10

def register_customers(b: Bank, requests: DataFrame, as_of=None) -> Result:
    """Self-registration: a checking account with a 1000.00 deposit at the lowest branch
    with its first manager; refused when a required field is missing, the CPF is malformed, the
    username or CPF is known to the user table (or taken earlier in the batch), or the CPF is
    already a customer's.

    ``requests``: seq, cpf, nome_completo, data_nascimento, username, senha (plain), email,
    telefone, and optionally the customer's other columns.
    """
    c = F.col
    by_user = b.usuario.select("username", F.lit(True).alias("_u"))
    by_cpf = b.usuario.where(c("cpf").isNotNull()).select("cpf", F.lit(True).alias("_c"))
    customers = b.cliente.select("cpf", F.lit(True).alias("_cl"))
    r = (_filled(requests).join(by_user, "username", "left").join(by_cpf, "cpf", "left").join(customers, "cpf", "left"))
    empty = lambda x: c(x).isNull() | (c(x) == "")
    r = r.withColumn("_pre", _first_reason([
        (empty("nome_completo") | empty("username") | empty("cpf") | empty("senha") | c("data_nascimento").isNull(), "MISSING_FIELD"),
        (~c("cpf").rlike(r"^[0-9]{11}$"), "INVALID_CPF"),
        (c("_u").isNotNull() | c("_c").isNotNull(), "USER_OR_CPF_EXISTS"),
        (c("_cl").isNotNull(), "CUSTOMER_EXISTS"),
    ]))
    greedy, _ = I.greedy_unique(r.where(c("_pre").isNull()), "seq", [["username"], ["cpf"]])
    ok = greedy.where("accepted").drop("accepted", "_clash")
    branch = b.agencia.agg(F.min("num_ag").alias("_ag"))
    manager = b.funcionario.where(c("cargo") == "gerente").agg(F.min("matricula").alias("_mgr"))
    numbered = I.assign_global(ok, I.next_account_base(b.conta).scalar(), out="num_conta")
    numbered = numbered.withColumn("num_conta", c("num_conta").cast("int")).withColumn(
        "_ag", F.coalesce(branch.scalar(), F.lit(1))).withColumn("_mgr", F.coalesce(manager.scalar(), F.lit(DEFAULT_MANAGER)))
    conta = numbered.select("num_conta", F.lit(0.0).alias("saldo"), sha256_hex("senha").alias("senha"),
                            F.lit("conta-corrente").alias("tipo_conta"), F.lit(None).cast("double").alias("taxa_juros"),
                            F.lit(None).cast("double").alias("limite_credito"),
                            (F.lit(as_of).cast("date") if as_of else F.current_date()).alias("data_aniversario_contrato"),
                            c("_ag").cast("int").alias("num_ag"), c("_mgr").alias("matricula_gerente"))
    conta, deposits = _opened(conta, _deposit_rows(numbered.withColumn("_dep", F.lit(REGISTRATION_DEPOSIT)), "_dep", as_of))
    holders = numbered.select("num_conta", c("cpf").alias("cpf_cliente"), F.lit("1º titular").alias("tipo_titular"))
    none = F.lit(None).cast("int").alias("num_conta")
    decisions = (numbered.select("seq", F.lit(ACCEPTED).alias("status"), "num_conta")
                 .unionByName(r.where(c("_pre").isNotNull()).select("seq", c("_pre").alias("status"), none))
                 .unionByName(greedy.where(~c("accepted")).select("seq", F.lit("USER_OR_CPF_EXISTS").alias("status"), none)))
    return Result(decisions, {"conta": conta, "titularidade_conta": holders, "transacao": deposits, **_customer_rows(b, numbered)})


# ------------------------------------------------------------------- I11

_EMPLOYEE_EDITS = ["nome_completo", "tipo_logradouro", "nome_logradouro", "numero", "complemento", "bairro", "cidade",
                   "estado", "cep", "cargo", "genero", "data_nascimento", "salario", "num_ag"]


def _payroll_kept(b: Bank, funcionario: DataFrame) -> DataFrame:
    """Branches with their stored payroll moved by the change of their employees' salaries (exact decimals)."""
    paid = lambda f, sign: f.select("num_ag", (sign * money("salario")).alias("_s"))
    change = paid(funcionario, 1).unionByName(paid(b.funcionario, -1)).groupBy("num_ag").agg(F.sum("_s").alias("_d"))
    total = money("sal_total") + F.coalesce(F.col("_d"), F.lit(0).cast("decimal(18,2)"))
    return b.agencia.join(change, "num_ag", "left").withColumn("sal_total", total.cast("double")).select(*b.agencia.columns)


def apply_employees(b: Bank, requests: DataFrame) -> Result:
    """Hire (new matricula, mirrored user row with role = cargo) or edit an employee.

    ``requests``: seq, op ('hire' | 'edit'), matricula (edit), nome_completo, cargo, genero,
    data_nascimento, salario, num_ag, senha_hash (optional on edit: blank keeps the old one),
    and optionally address columns (those present are written). Editing overwrites the user's
    name and role (an admin becomes gerente again) and, with a new secret, the secret. Rows:
    funcionario, usuario (new users included), agencia with the payroll kept in step.
    """
    c = F.col
    ag = b.agencia.select("num_ag", F.lit(True).alias("_ag"))
    emp = b.funcionario.select(c("matricula"), F.lit(True).alias("_emp"))
    r = requests.join(ag, "num_ag", "left").join(emp, "matricula", "left")
    r = r.withColumn("_pre", _first_reason([
        (~c("op").isin("hire", "edit"), "INVALID_OP"),
        ((c("op") == "edit") & c("_emp").isNull(), "EMPLOYEE_NOT_FOUND"),
        (c("salario") < SALARY_FLOOR, "SALARY_BELOW_FLOOR"),
        (~c("cargo").isin("gerente", "atendente", "caixa"), "INVALID_ROLE"),
        (c("_ag").isNull(), "UNKNOWN_BRANCH"),
    ]))
    ok = r.where(c("_pre").isNull())
    hires = I.assign_global(ok.where(c("op") == "hire"), I.next_matricula_base(b.funcionario).scalar(), out="_n")
    hires = hires.withColumn("matricula", F.concat(F.lit("MAT"), c("_n").cast("string")))
    new_emp = hires.withColumn("senha", c("senha_hash")).select(*[
        c(f.name) if f.name in [*hires.columns, "senha"] else F.lit(None).cast(f.dataType).alias(f.name)
        for f in b.funcionario.schema.fields])
    edits = ok.where(c("op") == "edit").withColumn("senha", F.when(c("senha_hash") != "", c("senha_hash")))
    written = [x for x in _EMPLOYEE_EDITS if x in requests.columns]
    edits = edits.withColumns({f"set_{x}": F.lit(True) for x in written})
    funcionario = cut_lineage(I.apply_updates(b.funcionario, edits, ["matricula"], [*written, "senha"]).unionByName(new_emp))
    changed = edits.select("matricula", "seq", "senha", c("cargo").alias("role"), c("nome_completo").alias("nome"))
    first_id = b.usuario.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new_users = I.assign_global(hires.drop("_n"), first_id, out="id").select(
        c("id").cast(b.usuario.schema["id"].dataType).alias("id"), c("matricula").alias("username"),
        c("nome_completo").alias("nome"), c("senha_hash").alias("senha"), c("cargo").alias("role"),
        F.lit(None).cast("string").alias("cpf"), "matricula")
    usuario = I.apply_updates(b.usuario, changed, ["matricula"], ["role", "nome", "senha"]).unionByName(new_users)
    decisions = (ok.select("seq", F.lit(ACCEPTED).alias("status")).join(hires.select("seq", "matricula"), "seq", "left")
                 .unionByName(r.where(c("_pre").isNotNull()).select("seq", c("_pre").alias("status"),
                                                                   F.lit(None).cast("string").alias("matricula"))))
    return Result(decisions, {"funcionario": funcionario, "usuario": usuario, "agencia": _payroll_kept(b, funcionario)})


# ------------------------------------------------------------------- I12

def apply_promotions(b: Bank, requests: DataFrame) -> Result:
    """Set a user's role; mirror it on the employee row (admin is gerente there); a user
    without an employee row gets one created from the customer data (salary 3000.00, branch 1,
    'não-binário', default secret) when the customer exists.

    ``requests``: seq, id_usuario, novo_cargo, requester_id, requester_role. Screen rule:
    client -> gerente by gerente or admin; gerente -> admin by admin only; never oneself.
    Requests apply in arrival order, each to the role left by the ones before it. A user can
    rise twice at most, so the first allowed rise and the first allowed one after it are two
    minima per user.
    """
    c = F.col
    u = b.usuario.select(c("id").alias("id_usuario"), c("role").alias("_role"), "cpf", "matricula", "nome")
    r = requests.join(u, "id_usuario", "left")
    oneself = F.coalesce(c("id_usuario") == c("requester_id"), F.lit(False))
    to_manager = (c("novo_cargo") == "gerente") & c("requester_role").isin("gerente", "admin") & ~oneself
    to_admin = (c("novo_cargo") == "admin") & (c("requester_role") == "admin") & ~oneself
    first = r.where((c("_role") == "client") & to_manager).groupBy("id_usuario").agg(F.min("seq").alias("_s1"))
    r = r.join(first, "id_usuario", "left")
    manager_then = (c("_role") == "gerente") | (c("seq") > c("_s1"))
    second = r.where(manager_then & to_admin).groupBy("id_usuario").agg(F.min("seq").alias("_s2"))
    r = r.join(second, "id_usuario", "left")
    accepted = F.coalesce(c("seq") == c("_s1"), F.lit(False)) | F.coalesce(c("seq") == c("_s2"), F.lit(False))
    r = cut_lineage(r.withColumn("status", F.when(c("_role").isNull(), F.lit("USER_NOT_FOUND"))
                                 .when(oneself, F.lit("SELF_PROMOTION")).when(accepted, F.lit(ACCEPTED))
                                 .otherwise(F.lit("NOT_ALLOWED"))))
    ok = r.where(c("status") == ACCEPTED)
    last = ok.groupBy("id_usuario").agg(F.max_by("novo_cargo", "seq").alias("novo_cargo"), F.min("seq").alias("seq"),
                                        F.first("cpf").alias("cpf"), F.first("matricula").alias("matricula"),
                                        F.first("nome").alias("nome"))
    address = ["tipo_logradouro", "nome_logradouro", "numero", "complemento", "bairro", "cidade", "estado", "cep"]
    # Both roles that can be given are gerente on the employee row.
    needs_emp = last.where(c("matricula").isNull()).drop("matricula").join(b.cliente.select("cpf", *address, "data_nascimento"), "cpf")
    created = I.assign_global(needs_emp, I.next_matricula_base(b.funcionario).scalar(), out="_n").withColumn(
        "matricula", F.concat(F.lit("MAT"), c("_n").cast("string")))
    new_emp = created.select(
        "matricula", c("nome").alias("nome_completo"), F.lit(DEFAULT_PASSWORD_LITERAL).alias("senha"), *address,
        F.lit("gerente").alias("cargo"), F.lit("não-binário").alias("genero"), "data_nascimento",
        F.lit(PROMOTION_SALARY).alias("salario"), F.lit(1).alias("num_ag"))
    risen = last.where(c("matricula").isNotNull()).select("matricula", "seq", F.lit("gerente").alias("cargo"))
    funcionario = I.apply_updates(b.funcionario, risen, ["matricula"], ["cargo"]).unionByName(new_emp.select(*b.funcionario.columns))
    updates = (last.select(c("id_usuario").alias("id"), "seq", c("novo_cargo").alias("role"),
                           F.lit(None).cast("string").alias("matricula"))
               .unionByName(created.select(c("id_usuario").alias("id"), "seq", F.lit(None).cast("string").alias("role"), "matricula")))
    usuario = I.apply_updates(b.usuario, updates, ["id"], ["role", "matricula"])
    return Result(r.select("seq", "status"), {"funcionario": funcionario, "usuario": usuario,
                                              "agencia": _payroll_kept(b, funcionario)})


# ------------------------------------------------------------------- I13

# Accented letters of names and their base letters.
_ACCENTED = "ÁÀÂÃÄÅáàâãäåÉÈÊËéèêëÍÌÎÏíìîïÓÒÔÕÖóòôõöÚÙÛÜúùûüÇçÑñ"
_PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNn"
_DEP_FOLD_SCHEMA = ("kind string, seq long, status string, nome_completo string, matricula_func string, "
                    "data_nascimento date, parentesco string, idade int")


def _fold_dependents(batches):
    """Per-employee sequential pass over stored rows and requests sorted by (matricula_func, seq).

    State: the employee's current dependents by ``name_key`` (a list each, so duplicate stored keys are kept as they are)
    and their number, so a request costs the same however many dependents its employee has.
    Names are compared by ``name_key``. add: needs a name, then a free slot, then the table's rules (known
    kinship, free key, known employee). delete: removes the name (no-op if absent). edit: updates the rows with the
    old name under the same rules; without such a row nothing happens and nothing is refused.
    Emits one decision per request and, at the end of each employee, the resulting rows.
    """
    import pyarrow as pa

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.date32(), pa.string(), pa.int32()]
    columns = ["kind", "seq", "status", "nome_completo", "matricula_func", "data_nascimento", "parentesco", "idade"]
    cur, held, n = None, {}, 0  # employee, its rows by name, their number
    out: list[tuple] = []

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], columns)
        out.clear()
        return made

    def flush():
        for rows in held.values():
            for name, born, kin, age in rows:
                out.append(("row", None, None, name, cur, born, kin, age))
                if len(out) >= 10_000:
                    yield batch()

    def refused(kin, key, known, renamed=False):
        if kin not in PARENTESCO:
            return "INVALID_KINSHIP"
        if key in held and not renamed:
            return "DUPLICATE_KEY"
        return None if known else "UNKNOWN_EMPLOYEE"

    for b in batches:
        for emp, seq, op, name, born, kin, age, key, old, known in zip(*(b.column(c).to_pylist() for c in (
                "matricula_func", "seq", "op", "nome_completo", "data_nascimento", "parentesco", "idade", "name_key", "old_key",
                "known"))):
            if emp != cur:
                if cur is not None:
                    yield from flush()
                cur, held, n = emp, {}, 0
            attrs = (name, born, kin, age)
            if op == "stored":
                held.setdefault(key, []).append(attrs)
                n += 1
                continue
            status = ACCEPTED
            if op == "add":
                if not name:
                    status = "MISSING_FIELD"
                elif n >= MAX_DEPENDENTS:
                    status = "DEPENDENT_LIMIT"
                else:
                    status = refused(kin, key, known) or ACCEPTED
                if status == ACCEPTED:
                    held[key] = [attrs]
                    n += 1
            elif op == "delete":
                n -= len(held.pop(old, ()))
            elif op == "edit":
                if old in held:
                    status = "MISSING_FIELD" if name is None else refused(kin, key, known, renamed=key == old) or ACCEPTED
                    if status == ACCEPTED:
                        held[key] = [attrs] * len(held.pop(old))
            else:
                status = "INVALID_OP"
            out.append(("decision", seq, status, None, emp, None, None, None))
            if len(out) >= 10_000:
                yield batch()
    if cur is not None:
        yield from flush()
    if out:
        yield batch()


def apply_dependents(b: Bank, requests: DataFrame, as_of) -> Result:
    """Add (limit five, computed age), edit (possibly renaming the key) or delete dependents,
    in arrival order per employee, as the screen applies them one by one.

    ``requests``: seq, op ('add' | 'edit' | 'delete'), matricula_func, nome_antigo (edit/delete),
    nome_completo, data_nascimento, parentesco. The batch is hash-partitioned by employee and folded
    in ``seq`` order, at a cost in proportion to its rows; the state of one employee is its dependents
    (bounded by the limit plus any stored excess).
    """
    c = F.col
    # Names are one key whatever their case and accents, as the server collates them.
    key = lambda x: F.lower(F.translate(F.rtrim(c(x)), _ACCENTED, _PLAIN))
    known = b.funcionario.select(c("matricula").alias("_m"), F.lit(True).alias("known"))
    stored = b.dependente.select(F.lit(None).cast("long").alias("seq"), F.lit("stored").alias("op"),
                                 "matricula_func", F.lit(None).cast("string").alias("nome_antigo"),
                                 "nome_completo", "data_nascimento", "parentesco", "idade")
    reqs = requests.select(c("seq").cast("long").alias("seq"), "op", "matricula_func", "nome_antigo",
                           "nome_completo", "data_nascimento", "parentesco",
                           age_years("data_nascimento", as_of).alias("idade"))
    folded = cut_lineage(
        stored.unionByName(reqs).withColumn("name_key", key("nome_completo")).withColumn("old_key", key("nome_antigo"))
        .join(known, c("matricula_func") == c("_m"), "left").drop("_m").withColumn("known", F.coalesce("known", F.lit(False)))
        .repartition("matricula_func")
        .sortWithinPartitions("matricula_func", F.col("seq").asc_nulls_first())
        .mapInArrow(_fold_dependents, _DEP_FOLD_SCHEMA))
    decisions = folded.where(c("kind") == "decision").select("seq", "status")
    rows = folded.where(c("kind") == "row").select(*b.dependente.columns)
    return Result(decisions, {"dependente": rows})


# ------------------------------------------------------------------- I14

def post_fees(b: Bank, requests: DataFrame, as_of=None) -> Result:
    """Fees debited as 'pagamento' after checks: the authoriser is an employee user and
    not the requester; the account exists; the amount is positive. Numbers continue each
    account's sequence and are taken by accepted rows only. Rows: transacao (the accepted fees) and
    conta (all accounts with the balances after them).

    ``requests``: seq, num_conta, valor, requester_matricula, authorizer_username.
    """
    c = F.col
    # The authoriser is found by user name, matricula or CPF (digits only); of several users, the lowest id.
    u = b.usuario.select("id", c("matricula").alias("_auth_mat"), "username", "cpf", "matricula")
    keys = u.select("id", "_auth_mat", F.explode(F.array(
        F.struct(F.lit("n").alias("k"), c("username").alias("v")), F.struct(F.lit("n").alias("k"), c("matricula").alias("v")),
        F.struct(F.lit("c").alias("k"), c("cpf").alias("v")))).alias("_w")).where(c("_w.v").isNotNull())
    best = keys.groupBy("_w.k", "_w.v").agg(F.min(F.struct("id", "_auth_mat")).alias("_u"))
    asked = requests.select(c("authorizer_username").alias("_a")).distinct()
    asked = asked.select("_a", F.explode(F.array(
        F.struct(F.lit("n").alias("k"), c("_a").alias("v")),
        F.struct(F.lit("c").alias("k"), F.regexp_replace("_a", "[^0-9]", "").alias("v")))).alias("_q"))
    auth = (asked.join(best, (c("_q.k") == c("k")) & (c("_q.v") == c("v"))).groupBy("_a")
            .agg(F.min("_u").alias("_u")).select(c("_a").alias("authorizer_username"), c("_u._auth_mat").alias("_auth_mat")))
    acc = b.conta.select("num_conta", F.lit(True).alias("_acc"))
    r = requests.join(auth, "authorizer_username", "left").join(acc, "num_conta", "left")
    r = r.withColumn("_pre", _first_reason([
        (c("_auth_mat").isNull(), "AUTHORIZER_NOT_EMPLOYEE"),
        (c("_auth_mat") == c("requester_matricula"), "SELF_AUTHORIZATION"),
        (c("_acc").isNull(), "UNKNOWN_ACCOUNT"),
        (c("valor").isNull() | (c("valor") <= 0), "INVALID_AMOUNT"),
    ]))
    ts = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else F.localtimestamp()
    ok = r.where(c("_pre").isNull()).select("seq", "num_conta", F.lit("pagamento").alias("tipo"),
                                           ts.alias("data_hora"), "valor")
    posting = post(b.conta, ok, seq="seq")
    posted = posting.decisions
    numbered = I.assign_next(posting.accepted, b.transacao)
    decisions = (posted.select("seq", "status", "saldo_apos")
                 .unionByName(r.where(c("_pre").isNotNull()).select("seq", c("_pre").alias("status"),
                                                                   F.lit(None).cast("double").alias("saldo_apos"))))
    conta = balances_after(b.conta, posting).select(*b.conta.columns)
    return Result(decisions, {"transacao": numbered.drop("status", "saldo_apos"), "conta": conta})


# --------------------------------------------------- deposits and withdrawals

def cash_operations(b: Bank, requests: DataFrame, as_of=None) -> Result:
    """Deposits and withdrawals end to end: authorise (N2), post in arrival order (K1), number, new balances.

    ``requests``: seq, solicitante (username), num_conta, tipo, valor. Rows: transacao (accepted
    rows with their numbers, which continue each account's sequence) and conta (all accounts with
    the balances after the batch).
    """
    c = F.col
    auth = authorize_cash(b, requests)
    ts = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else F.localtimestamp()
    ok = auth.where(c("reason").isNull()).select(c("seq").cast("long").alias("seq"), "num_conta", "tipo", ts.alias("data_hora"), "valor")
    posted = post(b.conta, ok, seq="seq")
    numbered = I.assign_next(posted.accepted.drop("status", "saldo_apos"), b.transacao)
    decisions = posted.decisions.select("seq", "status", "saldo_apos").unionByName(
        auth.where(c("reason").isNotNull()).select(c("seq").cast("long").alias("seq"), c("reason").alias("status"),
                                                   F.lit(None).cast("double").alias("saldo_apos")))
    conta = balances_after(b.conta, posted).select(*b.conta.columns)
    return Result(decisions, {"transacao": numbered, "conta": conta})
