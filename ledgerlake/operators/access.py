"""Access rules as relations.

Visibility is returned at the grain of its scope instead of being expanded
to every (user, account) pair: a client or manager row names an account, a
teller/attendant row names a branch, an admin row names everything. That
keeps the relation linear in users + accounts; ``statements_for`` resolves
the scopes with equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.schema import Bank
from ledgerlake.session import shuffled

SCOPE_ACCOUNT = "conta"
SCOPE_BRANCH = "agencia"
SCOPE_ALL = "todas"
# Which roles have the statement screen, and the names of the screens.
STATEMENT_ROLES = ["client", "caixa", "admin"]
SCREEN_STATEMENT, SCREEN_BALANCE, SCREEN_MANAGER = "extrato", "saldos", "gerencia"


def visible_accounts(b: Bank) -> DataFrame:
    """(username, role, screen, scope, num_conta, num_ag) per visibility grant.

    client: own holdings; caixa/atendente: own branch; gerente: managed
    accounts; admin: all accounts. ``screen`` says what the role sees there:
    statements for client, caixa and admin, account numbers and balances for
    atendente, the manager's report for gerente.
    """
    u = b.usuario.select("username", "role", "cpf", "matricula")
    client = (u.where(F.col("role") == "client")
              .join(b.titularidade_conta.select(F.col("cpf_cliente").alias("cpf"), "num_conta"), "cpf")
              .select("username", "role", F.lit(SCOPE_ACCOUNT).alias("scope"), "num_conta",
                      F.lit(None).cast("int").alias("num_ag")))
    branch = (u.where(F.col("role").isin("caixa", "atendente"))
              .join(b.funcionario.select("matricula", "num_ag"), "matricula")
              .select("username", "role", F.lit(SCOPE_BRANCH).alias("scope"),
                      F.lit(None).cast("int").alias("num_conta"), "num_ag"))
    manager = (u.where(F.col("role") == "gerente")
               .join(b.conta.select(F.col("matricula_gerente").alias("matricula"), "num_conta"), "matricula")
               .select("username", "role", F.lit(SCOPE_ACCOUNT).alias("scope"), "num_conta",
                       F.lit(None).cast("int").alias("num_ag")))
    admin = (u.where(F.col("role") == "admin")
             .select("username", "role", F.lit(SCOPE_ALL).alias("scope"),
                     F.lit(None).cast("int").alias("num_conta"), F.lit(None).cast("int").alias("num_ag")))
    every = reduce(DataFrame.unionByName, [client, branch, manager, admin])
    screen = (F.when(F.col("role").isin(STATEMENT_ROLES), F.lit(SCREEN_STATEMENT))
              .when(F.col("role") == "atendente", F.lit(SCREEN_BALANCE)).otherwise(F.lit(SCREEN_MANAGER)))
    return every.select("username", "role", screen.alias("screen"), "scope", "num_conta", "num_ag")


def statements_for(b: Bank, users: DataFrame) -> DataFrame:
    """Statement rows the requested users may see (``users`` has a ``username`` column).

    Only roles with the statement screen see rows: clients those of their
    accounts, tellers those of their branch. Admins see all rows; these are
    returned once, with scope 'todas' and no username, if an admin is among
    the users, instead of once per admin.
    """
    grants = (visible_accounts(b).where(F.col("screen") == SCREEN_STATEMENT)
              .join(users.select("username").distinct(), "username", "left_semi"))
    t = b.transacao.select("num_conta", "num_transacao", "tipo", "data_hora", "valor")
    by_account = grants.where(F.col("scope") == SCOPE_ACCOUNT).select("username", "scope", "num_conta").join(t, "num_conta")
    # Each transaction gets its branch first, so that only the result holds a row per teller and transaction. Rows are dealt
    # anew before they multiply: by account and number, or an account with many of them would be one task's.
    of_branch = (t.join(b.conta.select("num_conta", "num_ag"), "num_conta").where("num_ag is not null")
                 .repartition("num_conta", "num_transacao"))
    tellers = grants.where(F.col("scope") == SCOPE_BRANCH).select("username", "scope", "num_ag")
    by_branch = of_branch.join(F.broadcast(tellers), "num_ag")
    admin = grants.where(F.col("scope") == SCOPE_ALL).agg(F.max(F.lit(1))).scalar()
    by_all = (t.where(admin == 1).withColumn("scope", F.lit(SCOPE_ALL))
              .withColumn("username", F.lit(None).cast("string")))
    cols = ["username", "scope", "num_conta", "num_transacao", "tipo", "data_hora", "valor"]
    return reduce(DataFrame.unionByName, [x.select(*cols) for x in (by_account, by_branch, by_all)])


def authorize(b: Bank, requests: DataFrame) -> DataFrame:
    """Who may move money from which account, as a reason per transfer request.

    Order of checks: requester unknown; role without money movement
    (gerente, atendente); client not a holder of the origin; caixa outside
    own branch; amount not positive; same account; unknown origin or
    destination account.
    ``reason`` is NULL when the request may proceed to posting.
    """
    u = b.usuario.select(F.col("username").alias("solicitante"), "role", F.col("cpf").alias("u_cpf"),
                         F.col("matricula").alias("u_matricula"))
    holders = b.titularidade_conta.select(F.col("num_conta").alias("conta_origem"),
                                          F.col("cpf_cliente").alias("u_cpf"), F.lit(True).alias("is_holder"))
    emp = b.funcionario.select(F.col("matricula").alias("u_matricula"), F.col("num_ag").alias("emp_ag"))
    orig = b.conta.select(F.col("num_conta").alias("conta_origem"), F.col("num_ag").alias("orig_ag"))
    dest = b.conta.select(F.col("num_conta").alias("conta_destino"), F.lit(True).alias("dest_exists"))
    # All of these grow with the bank, and account numbers alone are small as files.
    r = (requests.join(shuffled(u), "solicitante", "left")
         .join(shuffled(holders), ["conta_origem", "u_cpf"], "left")
         .join(shuffled(emp), "u_matricula", "left")
         .join(shuffled(orig), "conta_origem", "left")
         .join(shuffled(dest), "conta_destino", "left"))
    reason = (F.when(F.col("role").isNull(), F.lit("USER_NOT_FOUND"))
              .when(F.col("role").isin("gerente", "atendente"), F.lit("ROLE_NOT_ALLOWED"))
              .when((F.col("role") == "client") & F.col("is_holder").isNull(), F.lit("NOT_HOLDER"))
              .when((F.col("role") == "caixa") & (F.col("emp_ag").isNull() | F.col("orig_ag").isNull()
                                                  | (F.col("emp_ag") != F.col("orig_ag"))), F.lit("BRANCH_MISMATCH"))
              .when(F.col("valor").isNull() | (F.col("valor") <= 0), F.lit("INVALID_AMOUNT"))
              .when(F.col("conta_origem") == F.col("conta_destino"), F.lit("SAME_ACCOUNT"))
              .when(F.col("orig_ag").isNull() | F.col("dest_exists").isNull(), F.lit("UNKNOWN_ACCOUNT")))
    return r.select(*requests.columns, reason.alias("reason"))


def authorize_cash(b: Bank, requests: DataFrame) -> DataFrame:
    """N2 for deposits and withdrawals: only caixa (own branch) and admin may post them.

    ``requests``: seq, solicitante (username), num_conta, tipo, valor. Order of checks:
    requester unknown; role other than caixa/admin; amount not positive; account unknown;
    caixa outside own branch. ``reason`` is NULL when the request may proceed to posting.
    """
    u = b.usuario.select(F.col("username").alias("solicitante"), "role", F.col("matricula").alias("u_matricula"))
    emp = b.funcionario.select(F.col("matricula").alias("u_matricula"), F.col("num_ag").alias("emp_ag"))
    acc = b.conta.select("num_conta", F.col("num_ag").alias("acc_ag"), F.lit(True).alias("_acc"))
    r = (requests.join(u, "solicitante", "left").join(emp, "u_matricula", "left")
         .join(acc, "num_conta", "left"))
    reason = (F.when(F.col("role").isNull(), F.lit("USER_NOT_FOUND"))
              .when(~F.col("role").isin("caixa", "admin"), F.lit("ROLE_NOT_ALLOWED"))
              .when(F.col("valor").isNull() | (F.col("valor") <= 0), F.lit("INVALID_AMOUNT"))
              .when(F.col("_acc").isNull(), F.lit("UNKNOWN_ACCOUNT"))
              .when((F.col("role") == "caixa") & (F.col("emp_ag").isNull() | (F.col("emp_ag") != F.col("acc_ag"))),
                    F.lit("BRANCH_MISMATCH")))
    return r.select(*requests.columns, reason.alias("reason"))
