"""Versions of the bank: all tables of a batch or none, replays, writers that race, folders and expiry."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import reports as R
from ledgerlake.schema import TABLES
from ledgerlake.sources import snapshots as S
from ledgerlake.sources.tables import write_bank
from tests.seed import seed_bank


@pytest.fixture
def root(spark):
    at = tempfile.mkdtemp(prefix="ledgerlake-versions-")
    b = seed_bank(spark)
    assert S.commit(spark, at, {name: getattr(b, name) for name in TABLES}) == 1
    return at


def _dying(df):
    """Rows whose computation fails in the middle of the write."""
    return df.withColumn("saldo", F.when(F.col("num_conta") > 0, F.raise_error(F.lit("executor lost")).cast("double")))


def test_version_equals_the_bank(spark, root):
    b, v = seed_bank(spark), S.read_bank(spark, root)
    for name in TABLES:
        rows = getattr(v, name).select(*TABLES[name].names)
        assert rows.schema.names == TABLES[name].names
        assert sorted(map(str, rows.collect())) == sorted(map(str, getattr(b, name).select(*TABLES[name].names).collect()))
    plan = R.activity_count(v, "2026-06-10 00:00:00", 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ano_mes" in plan


def test_a_run_killed_between_two_tables_leaves_the_old_version(spark, root):
    b = S.read_bank(spark, root)
    raised = b.cliente.withColumn("cidade", F.lit("Nova"))
    with pytest.raises(Exception, match="executor lost"):
        S.commit(spark, root, {"cliente": raised, "conta": _dying(b.conta)}, base=1, batch=("desk", 1))
    assert S.versions(spark, root) == [1]
    now = S.read_bank(spark, root)
    assert now.cliente.where("cidade = 'Nova'").count() == 0 and now.conta.count() == b.conta.count()
    # The same batch, repeated, commits once.
    good = {"cliente": raised, "conta": b.conta.withColumn("saldo", F.lit(1.0))}
    assert S.commit(spark, root, good, base=1, batch=("desk", 1)) == 2
    assert S.commit(spark, root, good, base=1, batch=("desk", 1)) == 2
    assert S.versions(spark, root) == [1, 2]
    now = S.read_bank(spark, root)
    assert now.cliente.where("cidade <> 'Nova'").count() == 0 and now.conta.where("saldo <> 1").count() == 0
    assert S.read_bank(spark, root, 1).cliente.where("cidade = 'Nova'").count() == 0


def test_second_writer_from_the_same_version_is_refused(spark, root):
    b = S.read_bank(spark, root)
    assert S.commit(spark, root, {"conta": b.conta}, base=1, batch=("one", 0)) == 2
    with pytest.raises(S.VersionTaken):
        S.commit(spark, root, {"conta": b.conta}, base=1, batch=("two", 0))
    with pytest.raises(S.VersionTaken):  # a race that the check before the writes does not see
        S._publish(spark, root, {"version": 2, "tables": {}, "writers": {}})
    assert S.manifest(spark, root)["writers"] == {"one": 0}
    assert not [f for f in os.listdir(f"{root}/manifests") if f.startswith("_draft")]
    with pytest.raises(ValueError):
        S.commit(spark, root, {"conta": b.conta}, {"conta": b.conta})
    with pytest.raises(ValueError):
        S.commit(spark, root, {"nothing": b.conta})


def test_appends_compact_and_expire(spark, root):
    b = S.read_bank(spark, root)
    n = b.transacao.count()
    more = b.transacao.limit(1)
    for i in range(3):
        S.commit(spark, root, appends={"transacao": more.withColumn("id_transacao", F.lit(1000 + i))}, batch=("log", i))
    assert S.read_bank(spark, root).transacao.count() == n + 3 and S.read_bank(spark, root, 2).transacao.count() == n + 1
    assert len(S.manifest(spark, root)["tables"]["transacao"]) == 4
    assert S.compact(spark, root) == 4 and S.compact(spark, root, most=3) == 5
    assert len(S.manifest(spark, root)["tables"]["transacao"]) == 1
    assert S.expire(spark, root, keep=1) == [1, 2, 3, 4] and S.versions(spark, root) == [5]
    now = S.read_bank(spark, root)
    assert now.transacao.count() == n + 3 and now.conta.count() == b.conta.count()
    assert len(os.listdir(f"{root}/data/transacao")) == 1
    assert S.manifest(spark, root)["writers"] == {"log": 2}


def test_log_has_few_files_a_month(spark):
    rows = spark.range(3000).select(
        F.col("id").cast("int").alias("id_transacao"), F.lit(1).alias("num_transacao"), (F.col("id") % 50 + 61000).cast("int").alias("num_conta"),
        F.lit("saque").alias("tipo"), F.expr("timestamp_ntz'2020-01-05 00:00:00' + make_interval(0, cast(id % 30 as int))").alias("data_hora"),
        F.lit(1.0).alias("valor")).repartition(16)
    at = tempfile.mkdtemp(prefix="ledgerlake-months-")
    write_bank(seed_bank(spark).with_tables(transacao=rows), at)
    files = [f for _, _, fs in os.walk(f"{at}/transacao") for f in fs if f.endswith(".parquet")]
    assert 30 <= len(files) <= 30 + 8  # a month, and one more for each border between two tasks
