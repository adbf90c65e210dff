"""Streaming operators equal their batch counterparts (1 batch = n batches)."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import ledger as K
from ledgerlake.operators.reports import branch_payroll
from ledgerlake.plans.catalog import QUERIES, _post_transfers, payroll_changes
from ledgerlake.sources.fixture import Fixture
from ledgerlake.streaming import posting as L
from ledgerlake.streaming.payroll import payroll_totals, run_payroll
from ledgerlake.streaming.staging import staged_ranges
from tests.staging import stage_in_order

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_post_stream_three_batches_equals_batch(spark):
    b = Fixture(spark, SF).bank()
    t = b.transacao.select(F.col("id_transacao").alias("seq"), "num_conta", "tipo", "valor")
    staged = stage_in_order(t, "seq", [500, 1000], "test-post")
    src = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(staged)
    got = {r["seq"]: (r["status"], r["saldo_apos"]) for r in L.run_to_table(L.post_stream(src, b.conta), "t").collect()}
    exp = {r["seq"]: (r["status"], r["saldo_apos"]) for r in K.post(b.conta, t, seq="seq").decisions.collect()}
    assert got == exp


def test_payroll_stream_equals_recomputation(spark):
    fx = Fixture(spark, SF)
    got = {r["num_ag"]: r["sal_total"] for r in QUERIES["payroll_stream"](spark, SF).collect()}
    cdc = payroll_changes(fx)
    final = (cdc.where("op = 'I'").select(F.col("seq"), F.col("new_num_ag").alias("num_ag"),
                                          F.col("new_salario").alias("salario")))
    assert got  # every branch with a change appears
    b = fx.bank()
    moved = b.funcionario.withColumn("_k", F.col("cep").cast("long"))
    after = (moved.where("_k % 9 <> 0")
             .withColumn("num_ag", F.when(F.col("_k") % 4 == 0, ((F.col("num_ag") + 1) % 25).cast("int"))
                         .otherwise(F.col("num_ag")))
             .withColumn("salario", F.when(F.col("_k") % 4 == 0, F.col("salario") + 100).otherwise(F.col("salario"))))
    exp = {r["num_ag"]: r["sal_total_calc"] for r in branch_payroll(b.with_tables(funcionario=after)).collect()}
    for ag, v in got.items():
        assert abs(v - exp[ag]) < 1e-6, (ag, v, exp[ag])
    assert final is not None


def test_transfer_stream_equals_batch(spark):
    got = {r["seq"]: r["status"] for r in QUERIES["post_transfers_stream"](spark, SF).collect()}
    exp = {r["seq"]: r["status"] for r in _post_transfers(Fixture(spark, SF)).collect()}
    assert got == exp


def test_versioned_post_stream_three_batches_equals_batch(spark):
    b = Fixture(spark, SF).bank()
    t = b.transacao.select(F.col("id_transacao").alias("seq"), "num_conta", "tipo", "valor")
    staged = stage_in_order(t, "seq", [500, 1000], "test-post-v")
    src = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(staged)
    out = L.post_stream_versioned(src, b.conta)
    dec = spark.read.parquet(f"{out}/decisions")
    assert sorted({r["batch"] for r in dec.select("batch").distinct().collect()}) == [0, 1, 2]
    got = {r["seq"]: (r["status"], r["saldo_apos"]) for r in dec.collect()}
    exp = {r["seq"]: (r["status"], r["saldo_apos"]) for r in K.post(b.conta, t, seq="seq").decisions.collect()}
    assert got == exp


def test_post_stream_stops_and_resumes(spark, tmp_path):
    """The first run ends after the first files; the second continues in the same folder, with its balances and numbers."""
    b = Fixture(spark, SF).bank()
    t = b.transacao.select(F.col("id_transacao").alias("seq"), "num_conta", "num_transacao", "tipo", "valor")
    again = t.where("seq < 500 and seq % 7 = 0").withColumn("seq", F.col("seq") + 100_000)  # numbers used before
    source, folder = f"{tmp_path}/source", f"{tmp_path}/stream"
    t.where("seq < 700").coalesce(1).write.parquet(source)
    src = spark.readStream.schema(t.schema).parquet(source)
    first = L.post_stream_versioned(src, b.conta, folder=folder)
    assert spark.read.parquet(f"{first}/decisions").count() == t.where("seq < 700").count()
    t.where("seq >= 700").unionByName(again).coalesce(1).write.mode("append").parquet(source)
    out = L.post_stream_versioned(src, b.conta, folder=folder)
    got = {r["seq"]: (r["status"], r["saldo_apos"]) for r in spark.read.parquet(f"{out}/decisions").collect()}
    exp = {r["seq"]: (r["status"], r["saldo_apos"]) for r in K.post(b.conta, t.unionByName(again), seq="seq").decisions.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in exp.items()}
    assert {k: v for k, v in got.items() if v[0] != "DUPLICATE_NUMBER"} == {k: v for k, v in exp.items() if v[0] != "DUPLICATE_NUMBER"}
    assert any(v[0] == "DUPLICATE_NUMBER" for v in got.values())


def test_ranges_are_one_batch_each_and_written_in_parallel(spark):
    rows = spark.range(0, 1000).select(F.col("id").alias("seq")).repartition(6)
    folder = L.scratch_path(spark, "test-ranges")
    seen = []
    for path in staged_ranges(rows, "seq", [300, 800], "test-ranges"):
        src = spark.readStream.schema(rows.schema).parquet(path)
        q = (src.writeStream.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True)
             .foreachBatch(lambda df, i: seen.append((i, df.count(), df.agg(F.min("seq")).first()[0], df.rdd.getNumPartitions()))).start())
        q.awaitTermination()
    assert [s[:3] for s in seen] == [(0, 300, 0), (1, 500, 300), (2, 200, 800)]
    assert all(s[3] > 1 for s in seen)


def test_payroll_with_repeated_records(spark):
    """Records repeated in their own batch, in later batches and after a restart count once."""
    cols = "seq long, op string, old_num_ag int, old_salario double, new_num_ag int, new_salario double"
    first = [(i, "I", None, None, i % 3, 100.25 + i) for i in range(5000)]
    second = [(5000 + i, "U", i % 3, 100.25 + i, 1, 7.5) for i in range(0, 5000, 7)] + [(9999, "D", 1, 7.5, None, None)]
    again = first[100:200] + second[:50]
    odd = [(None, "I", None, None, 1, 2.0), (20_000, "I", None, None, None, 5.0), (20_001, "I", None, None, 2, None), (20_002, "x", 1, 1.0, 1, 1.0)]
    folder, source = L.scratch_path(spark, "test-payroll"), L.scratch_path(spark, "test-payroll-in")
    for part in (first + first[:10], second + first[4000:], again + odd + odd[:1], second):
        spark.createDataFrame(part, cols).repartition(4).write.mode("append").parquet(source)
        out = run_payroll(spark.readStream.schema(cols).parquet(source), folder)
    exp = {}
    for _, _, old, was, new, now in first + second + odd[:1] * 2:
        for ag, delta in ((old, -was if was else None), (new, now)):
            if ag is not None and delta is not None:
                exp[ag] = exp.get(ag, 0) + round(delta * 100)
    assert {r["num_ag"]: r["sal_total"] for r in payroll_totals(spark, out).collect()} == {k: v / 100 for k, v in exp.items()}
    assert len(spark.read.parquet(f"{out}/sums").select("batch").distinct().collect()) == 4
