"""Change application as batch snapshot rewrites.

A change batch is a DataFrame of requests with an arrival ``seq``. Each
operator returns the new table snapshot (and, where a request can be
refused, the refusals with a reason). The reference applies requests one
by one; here the rule is applied to the whole batch with joins, partial
aggregates and windows. Where a request's fate depends on earlier accepted
requests (unique keys, per-customer-per-branch limits) the batch is solved
by rounds of per-key minima (``greedy_unique``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.exprs import trailing_number
from ledgerlake.operators.conflicts import fold_unique
from ledgerlake.operators.prefix import DEFAULT_CHUNK_SPAN, prefix_sum
from ledgerlake.schema import (DEFAULT_PASSWORD_LITERAL, FIRST_ACCOUNT_NUMBER, FIRST_MATRICULA_NUMBER,
                               MAX_DEPENDENTS, Bank)
from ledgerlake.session import cut_and_count, cut_lineage, cut_to_files, sized

# The built-in administrator row.
ADMIN_USERNAME = "Admin"
ADMIN_NAME = "Administrador DBA"
ADMIN_SECRET = "Root"


# ---------------------------------------------------------------- I1, I2, I3

def apply_updates(base: DataFrame, changes: DataFrame, key: list[str], cols: list[str],
                  seq: str = "seq") -> DataFrame:
    """Keyed update. ``changes`` has key, ``seq`` and for each column ``c`` a value ``c`` and
    an optional boolean ``set_c`` (absent = set when the value is not NULL).

    Several changes to one key apply in ``seq`` order: per column the latest
    change that sets it wins (``max_by`` in a partial aggregate).
    """
    aggs = []
    for c in cols:
        flag = F.col(f"set_{c}") if f"set_{c}" in changes.columns else F.col(c).isNotNull()
        aggs.append(F.max_by(F.col(c), F.when(flag, F.col(seq))).alias(f"_new_{c}"))
        aggs.append(F.max(flag.cast("int")).alias(f"_set_{c}"))
    latest = changes.groupBy(*key).agg(*aggs)
    j = base.join(latest, key, "left")
    out = [F.when(F.col(f"_set_{c}") == 1, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols
           else F.col(c) for c in base.columns]
    return j.select(*out)


def upsert_contacts(base: DataFrame, changes: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """Insert, or on a duplicate key rewrite the key value to itself (no change).

    The value is part of the key, so this is "append if absent"; within the
    batch the first request per key inserts, later ones hit the duplicate.
    """
    first_seq = changes.groupBy(*key).agg(F.min(seq).alias("_fseq"))
    first = (changes.join(first_seq, key).where(F.col(seq) == F.col("_fseq"))
             .select(*base.columns))
    return base.unionByName(first.join(base.select(*key), key, "left_anti"))


def delete_rows(base: DataFrame, keys: DataFrame) -> DataFrame:
    """Delete by (composite) key."""
    return base.join(keys.select(*keys.columns).distinct(), list(keys.columns), "left_anti")


def cascade_users(users: DataFrame, deleted_cpf: DataFrame | None = None,
                  deleted_matricula: DataFrame | None = None) -> DataFrame:
    """ON DELETE CASCADE of customers / employees onto the user table."""
    out = users
    if deleted_cpf is not None:
        out = out.join(deleted_cpf.select("cpf").distinct(), "cpf", "left_anti")
    if deleted_matricula is not None:
        out = out.join(deleted_matricula.select("matricula").distinct(), "matricula", "left_anti")
    return out


# ------------------------------------------------------------------ I7, I8

def assign_next(requests: DataFrame, existing: DataFrame, key: str = "num_conta", number: str = "num_transacao",
                seq: str = "seq", chunk_span: int | None = DEFAULT_CHUNK_SPAN) -> DataFrame:
    """Next number per key: existing max (or 0) + rank of the request within its key by ``seq``.

    The rank is a prefix count, so a hot key is numbered by many tasks.
    """
    mx = existing.groupBy(key).agg(F.max(number).alias("_max"))
    ranked = prefix_sum(requests, key, seq, F.lit(1).cast("long"), "_rank", inclusive=True, chunk_span=chunk_span)
    return (ranked.join(mx, key, "left")
            .withColumn(number, (F.coalesce(F.col("_max"), F.lit(0)) + F.col("_rank")).cast("int"))
            .drop("_max", "_rank"))


def global_rank(df: DataFrame, seq: str, out: str = "_grank") -> DataFrame:
    """Dense 1-based rank of ``seq`` over the whole frame without a single-partition window.

    Range-partition and sort by ``seq``, tag rows with their partition and
    position (``monotonically_increasing_id``), count rows per partition (a
    table with one row per partition), turn the counts into offsets, and add
    the offset to the position. The offsets table is bounded by the number
    of partitions, so it is broadcast.
    """
    tagged = (df.repartitionByRange(seq).sortWithinPartitions(seq)
              .withColumn("_mid", F.monotonically_increasing_id()))
    # Materialised once, so the counts and the positions come from one partitioning.
    tagged = cut_lineage(tagged.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("_off") + F.col("_pos") + 1)
            .drop("_mid", "_part", "_pos", "_off"))


def assign_global(requests: DataFrame, current_max: Column | int, seq: str = "seq", out: str = "num") -> DataFrame:
    """I8: table-wide next numbers ``current_max + rank(seq)`` (gap-free, in arrival order)."""
    ranked = global_rank(requests, seq)
    base = current_max if isinstance(current_max, Column) else F.lit(current_max)
    return ranked.withColumn(out, base + F.col("_grank")).drop("_grank")


def next_account_base(conta: DataFrame) -> DataFrame:
    """Base for new account numbers: max(num_conta), or one below the first number when empty or 0."""
    return conta.agg(F.max("num_conta").alias("_m")).select(
        F.when(F.coalesce(F.col("_m"), F.lit(0)) == 0, F.lit(FIRST_ACCOUNT_NUMBER - 1))
        .otherwise(F.col("_m")).cast("long").alias("_base"))


def next_matricula_base(funcionario: DataFrame) -> DataFrame:
    """Base for new employee ids: max of the number after 'MAT' (or 1000)."""
    return funcionario.agg(F.coalesce(F.max(trailing_number("matricula")), F.lit(FIRST_MATRICULA_NUMBER))
                           .cast("long").alias("_base"))


# ---------------------------------------------------------------------- I15

def conform_account_terms(df: DataFrame) -> DataFrame:
    """Interest rate only for savings, credit limit only for special accounts, else NULL."""
    return (df.withColumn("taxa_juros", F.when(F.col("tipo_conta") == "poupança", F.col("taxa_juros")))
            .withColumn("limite_credito", F.when(F.col("tipo_conta") == "conta especial", F.col("limite_credito"))))


# ----------------------------------------------------------- greedy

MERGE_EVERY = 8
PATIENCE = 8  # rounds before deep chains are decided by conflict components
ROUND_ROWS = 100_000  # a round that leaves more rows pending than this has to settle a tenth of them, or it was the last
FOLD_ROWS = 1_000_000  # rows of a component that one task folds at a time


class _Decided:
    """Decided rows of many rounds: parts are merged by size class, so plans stay short and rows are rewritten seldom."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def add(self, part: DataFrame, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(part)
        if len(self.levels[level]) == MERGE_EVERY:
            merged = cut_to_files(reduce(DataFrame.unionByName, self.levels[level]))
            self.levels[level] = []
            self.add(merged, level + 1)

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [p for level in self.levels for p in level])


def greedy_unique(requests: DataFrame, seq: str, keys: list[list[str]], patience: int = PATIENCE,
                  fold_rows: int = FOLD_ROWS, clashes: bool = True) -> tuple[DataFrame, int]:
    """Accept requests in ``seq`` order, refusing any that shares a key with an earlier accepted one.

    ``keys`` is a list of key column groups; NULL key parts never clash.
    One key group needs no rounds: the smallest ``seq`` per value wins.
    Otherwise, per round: among pending rows accept those minimal in ``seq``
    on every key they hold, refuse pending rows sharing a key with a newly
    accepted row, and carry on with the rest. A round touches pending rows
    only: per key, a partial aggregate and a distinct of newly taken values,
    joined back, and a cut by files. What ``patience`` rounds leave
    pending lies in deep chains and is decided by conflict components (see
    ``conflicts.fold_unique``), which counts as a round; with many rows
    pending, a round that settles few of them ends the rounds. Returns (requests
    with boolean ``accepted`` and, unless ``clashes`` is false, ``_clash``,
    the index of the first key that an earlier accepted request holds; rounds).
    """
    ids = [f"_k{i}" for i in range(len(keys))]
    cur = requests
    for name, k in zip(ids, keys):
        valid = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in k])
        cur = cur.withColumn(name, F.when(valid, F.struct(*[F.col(c) for c in k])))
    if len(keys) == 1:
        mins = cur.where("_k0 is not null").groupBy("_k0").agg(F.min(seq).alias("_min"))
        won = F.col("_k0").isNull() | (F.col("_min") == F.col(seq))
        out = cur.join(mins, "_k0", "left").withColumn("accepted", won)
        return out.withColumn("_clash", F.when(~won, F.lit(0))).drop("_k0", "_min"), 1
    pending, left = cut_and_count(cur)
    decided, rounds = _Decided(), 0
    decided.add(pending.where("false").withColumn("accepted", F.lit(True)))
    total, deep = left, False
    while left:
        rounds += 1
        if rounds > patience or deep:
            decided.add(fold_unique(pending, seq, ids, fold_rows))
            break
        step, minimal = pending, F.lit(True)
        for k in ids:
            mins = pending.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(seq).alias(f"_min{k}"))
            step = step.join(mins, k, "left")
            minimal = minimal & (F.col(k).isNull() | (F.col(f"_min{k}") == F.col(seq)))
        step = step.withColumn("accepted", minimal).drop(*[f"_min{k}" for k in ids])
        gone = F.lit(False)
        for k in ids:
            taken = step.where(F.col("accepted") & F.col(k).isNotNull()).select(k, F.lit(True).alias(f"_t{k}"))
            step = step.join(sized(taken, left), k, "left")
            gone = gone | F.col(f"_t{k}").isNotNull()
        step = step.withColumn("_gone", gone & ~F.col("accepted")).drop(*[f"_t{k}" for k in ids])
        step = cut_to_files(step)
        done = F.col("accepted") | F.col("_gone")
        decided.add(step.where(done).drop("_gone"))
        pending = step.where(~done).drop("accepted", "_gone")
        before, left = left, pending.count()
        deep = left > ROUND_ROWS and before - left < 0.1 * before
    out = decided.rows()
    if clashes:
        first, held = F.lit(None).cast("int"), out.where("accepted")
        held = sized(held, total)  # a union of files, whose hints end there
        for i, k in reversed(list(enumerate(ids))):
            out = out.join(held.where(F.col(k).isNotNull()).select(k, F.col(seq).alias(f"_w{i}")), k, "left")
            first = F.when(F.col(f"_w{i}") < F.col(seq), F.lit(i)).otherwise(first)
        out = out.withColumn("_clash", F.when(~F.col("accepted"), first)).drop(*[f"_w{i}" for i in range(len(ids))])
    return out.drop(*ids), rounds


def accept_holders(b: Bank, requests: DataFrame, seq: str = "seq") -> tuple[DataFrame, int]:
    """Holder inserts under "one account per customer per branch" and the two holder slots.

    ``requests``: seq, num_conta, cpf_cliente, tipo_titular. Rows clashing
    with stored holdings or without parent rows are refused first; the rest
    are accepted greedily in arrival order on the keys (cpf, branch) and
    (account, slot); the primary key (account, cpf) is implied by the first.
    """
    acc = b.conta.select("num_conta", "num_ag")
    r = requests.join(acc, "num_conta", "left")
    stored = b.titularidade_conta.join(acc, "num_conta")
    used_branch = stored.select("cpf_cliente", "num_ag").distinct().withColumn("_ub", F.lit(True))
    used_slot = stored.select("num_conta", "tipo_titular").distinct().withColumn("_us", F.lit(True))
    known_cpf = b.cliente.select(F.col("cpf").alias("cpf_cliente")).distinct().withColumn("_kc", F.lit(True))
    # The primary key (account, cpf) needs no check of its own: the same account is in the same
    # branch, so a repeated (account, cpf) is already a repeated (cpf, branch), stored or in the batch.
    r = (r.join(used_branch, ["cpf_cliente", "num_ag"], "left").join(used_slot, ["num_conta", "tipo_titular"], "left")
         .join(known_cpf, "cpf_cliente", "left"))
    # Order of the server: enum value (never NULL), BEFORE INSERT trigger (branch rule), then keys.
    known_slot = F.coalesce(F.col("tipo_titular").isin("1º titular", "2º titular"), F.lit(False))
    reason = (F.when(~known_slot, F.lit("INVALID_SLOT"))
              .when(F.col("_ub").isNotNull(), F.lit("ONE_ACCOUNT_PER_BRANCH"))
              .when(F.col("num_ag").isNull(), F.lit("UNKNOWN_ACCOUNT"))
              .when(F.col("_kc").isNull(), F.lit("UNKNOWN_CUSTOMER"))
              .when(F.col("_us").isNotNull(), F.lit("SLOT_TAKEN")))
    r = r.withColumn("_pre", reason)
    live, rounds = greedy_unique(r.where(F.col("_pre").isNull()), seq,
                                 [["cpf_cliente", "num_ag"], ["num_conta", "tipo_titular"]])
    # Of two taken keys the branch rule is reported: an earlier accepted request of the customer in the branch.
    live = live.withColumn("reason", F.when(F.col("accepted"), F.lit(None)).when(F.col("_clash") == 0, F.lit("ONE_ACCOUNT_PER_BRANCH"))
                           .otherwise(F.lit("SLOT_TAKEN")))
    out_cols = list(requests.columns) + ["accepted", "reason"]
    refused = r.where(F.col("_pre").isNotNull()).withColumn("accepted", F.lit(False)).withColumn("reason", F.col("_pre"))
    return live.select(*out_cols).unionByName(refused.select(*out_cols)), rounds


def accept_dependents(existing: DataFrame, requests: DataFrame, seq: str = "seq",
                      limit: int = MAX_DEPENDENTS) -> DataFrame:
    """Add dependents one by one: first the limit, then the key (matricula_func, nome_completo).

    Only accepted requests use a slot. Until the limit is reached, the first
    request of each name that is not stored is accepted and any other is a
    duplicate; from then on every request is over the limit.
    """
    have = existing.groupBy("matricula_func").agg(F.count(F.lit(1)).alias("_have"))
    stored_keys = existing.select("matricula_func", "nome_completo").distinct().withColumn("_dupe", F.lit(True))
    first_seq = requests.groupBy("matricula_func", "nome_completo").agg(F.min(seq).alias("_fseq"))
    r = (requests.join(stored_keys, ["matricula_func", "nome_completo"], "left")
         .join(first_seq, ["matricula_func", "nome_completo"], "left").join(have, "matricula_func", "left")
         .withColumn("_new", F.col("_dupe").isNull() & (F.col(seq) == F.col("_fseq")))
         .withColumn("_free", limit - F.coalesce(F.col("_have"), F.lit(0))))
    slots = prefix_sum(r.where("_new"), "matricula_func", seq, F.lit(1).cast("long"), "_rank", inclusive=True)
    full = slots.where(F.col("_rank") == F.col("_free")).select("matricula_func", F.col(seq).alias("_full"))
    ranked = slots.select("matricula_func", F.col(seq).alias("_s"), "_rank").withColumnRenamed("matricula_func", "_m")
    r = (r.join(full, "matricula_func", "left")
         .join(ranked, (F.col("matricula_func") == F.col("_m")) & (F.col(seq) == F.col("_s")), "left"))
    over = (F.col("_free") <= 0) | (F.col(seq) > F.col("_full"))
    reason = (F.when(F.coalesce(over, F.lit(False)), F.lit("DEPENDENT_LIMIT")).when(~F.col("_new"), F.lit("DUPLICATE_KEY")))
    return r.select(*requests.columns, reason.isNull().alias("accepted"), reason.alias("reason"))


# ---------------------------------------------------------------------- I5

def ensure_admin(users: DataFrame, secret_digest: Column | None = None) -> DataFrame:
    """Make sure the fixed administrator row exists (anti-join on its username, then union);
    a missing row gets the next id (table max + 1)."""
    spark = users.sparkSession
    secret = secret_digest if secret_digest is not None else F.sha2(F.lit(ADMIN_SECRET), 256)
    next_id = users.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
    row = spark.range(1).select(next_id.cast("long").alias("id"), F.lit(ADMIN_USERNAME).alias("username"),
                                F.lit(ADMIN_NAME).alias("nome"), secret.alias("senha"), F.lit("admin").alias("role"),
                                F.lit(None).cast("string").alias("cpf"), F.lit(None).cast("string").alias("matricula"))
    missing = row.join(users.select("username"), "username", "left_anti")
    return users.unionByName(missing.select(*users.columns))


# ---------------------------------------------------------------------- I4

def sync_users(b: Bank, default_secret_digest: F.Column | None = None) -> DataFrame:
    """I4 + I5: the user directory built from employees, customers and the fixed admin.

    Employees come first (role = cargo), then customers (secret of their
    lowest-numbered account, else the fixed default), then the admin; a row
    is kept only if none of username, cpf, matricula was taken by an earlier
    row (INSERT IGNORE). Ids are assigned in that order.
    """
    emp = b.funcionario.select(
        F.lit(0).alias("_src"), F.col("matricula").alias("_ord"),
        F.col("matricula").alias("username"), F.col("nome_completo").alias("nome"), "senha",
        F.col("cargo").alias("role"), F.lit(None).cast("string").alias("cpf"), "matricula")
    secret = (b.titularidade_conta.join(b.conta.select("num_conta", "senha"), "num_conta")
              .groupBy(F.col("cpf_cliente").alias("cpf")).agg(F.min_by("senha", "num_conta").alias("_s")))
    cli = (b.cliente.select("cpf", F.col("nome_completo").alias("nome")).join(secret, "cpf", "left")
           .select(F.lit(1).alias("_src"), F.col("cpf").alias("_ord"), F.col("cpf").alias("username"), "nome",
                   F.coalesce("_s", F.lit(DEFAULT_PASSWORD_LITERAL)).alias("senha"), F.lit("client").alias("role"),
                   "cpf", F.lit(None).cast("string").alias("matricula")))
    admin_secret = default_secret_digest if default_secret_digest is not None else F.sha2(F.lit(ADMIN_SECRET), 256)
    admin = b.agencia.sparkSession.range(1).select(
        F.lit(2).alias("_src"), F.lit("").alias("_ord"), F.lit(ADMIN_USERNAME).alias("username"),
        F.lit(ADMIN_NAME).alias("nome"), admin_secret.alias("senha"), F.lit("admin").alias("role"),
        F.lit(None).cast("string").alias("cpf"), F.lit(None).cast("string").alias("matricula"))
    rows = emp.unionByName(cli).unionByName(admin)
    ranked = global_rank(rows.withColumn("_key", F.struct("_src", "_ord")), "_key", "_seq").drop("_key")
    kept, _ = greedy_unique(ranked, "_seq", [["username"], ["cpf"], ["matricula"]], clashes=False)
    kept = kept.where("accepted")
    return (global_rank(kept, "_seq", "id")
            .select("id", "username", "nome", "senha", "role", "cpf", "matricula"))
