"""Transaction numbers end to end: transfers against the stored log, and the registry between micro-batches."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import ledger as K
from ledgerlake.operators import transfers as K2
from ledgerlake.plans.catalog import QUERIES
from ledgerlake.sources.fixture import Fixture
from ledgerlake.streaming import posting as L
from ledgerlake.streaming.registry import numbers_before, segments, write_numbers
from ledgerlake.streaming.transfers import post_transfers_stream

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_segments_cover_every_batch_once():
    for fan in (2, 3, 16):
        for n in range(200):
            covered = [i for level, k in segments(n, fan) for i in range(k * fan**level, (k + 1) * fan**level)]
            assert sorted(covered) == list(range(n))
            assert len(segments(n, fan)) <= (fan - 1) * (1 if n < fan else 8)


def test_registry_reads_own_buckets_only(spark, tmp_path):
    out, seen = str(tmp_path), set()
    for batch in range(7):
        rows = [(batch * 10 + i, i) for i in range(10)]
        taken = spark.createDataFrame(rows, "num_conta int, num_transacao int")
        write_numbers(taken, out, batch, fan=2)
        write_numbers(taken, out, batch, fan=2)  # a replayed batch
        seen |= set(rows)
        one = spark.createDataFrame([(rows[3][0],)], "num_conta int")
        found = numbers_before(one, out, batch + 1, fan=2)
        got = [tuple(r) for r in found.collect()]
        assert rows[3] in got and set(got) <= seen and len(got) == len(set(got)) and len(got) < len(seen)
        everything = numbers_before(taken.select("num_conta").unionByName(spark.range(100).selectExpr("cast(id as int) num_conta")), out, batch + 1, fan=2)
        assert {tuple(r) for r in everything.collect()} == seen
    files = numbers_before(one, out, 7, fan=2).inputFiles()
    assert all("bucket=" in f for f in files)
    write_numbers(spark.createDataFrame([], "num_conta int, num_transacao int"), out, 7, fan=2)
    assert numbers_before(one, out, 8, fan=2).count() > 0


def test_stored_numbers_are_refused_in_run_transfers(spark):
    b = Fixture(spark, SF).bank()
    req = Fixture(spark, SF).view("transfer_req").withColumn("valor", F.round(F.col("valor") / 1000, 2))
    free, _ = K2.run_transfers(b, None, req, "double_entry")
    ok = {r["seq"] for r in free.where("status = 'ACCEPTED'").collect()}
    assert ok
    numbered = req.withColumn("num_trans_origem", F.lit(77))
    log = req.select(F.col("conta_origem").alias("num_conta"), F.lit(77).alias("num_transacao")).distinct()
    assert K2.run_transfers(b, None, numbered, "double_entry", log)[0].where("status = 'DUPLICATE_NUMBER'").count() > 0
    assert not ok & {r["seq"] for r in K2.run_transfers(b, None, numbered, "double_entry", log)[0].where("status = 'ACCEPTED'").collect()}


def test_transfers_end_to_end(spark):
    b = Fixture(spark, SF).bank()
    decisions = {r["seq"]: r["status"] for r in QUERIES["apply_transfers"](spark, SF).collect()}
    rows = QUERIES["apply_transfers_transacao"](spark, SF).collect()
    stored = {(r["num_conta"], r["num_transacao"]) for r in b.transacao.collect()}
    new = [(r["num_conta"], r["num_transacao"]) for r in rows]
    assert len(set(new)) == len(new) and not set(new) & stored
    accepted = {s for s, why in decisions.items() if why == "ACCEPTED"}
    assert {r["seq"] for r in rows} == accepted and len(rows) == 2 * len(accepted) and accepted
    assert "DUPLICATE_NUMBER" in decisions.values()
    moved = {}
    for r in rows:
        moved[r["num_conta"]] = round(moved.get(r["num_conta"], 0) + (r["valor"] if r["sub"] else -r["valor"]), 2)
    before = {r["num_conta"]: r["saldo"] for r in b.conta.collect()}
    after = {r["num_conta"]: r["saldo"] for r in QUERIES["apply_transfers_conta"](spark, SF).collect()}
    assert after.keys() == before.keys()
    assert all(after[k] is None if v is None else abs(after[k] - v - moved.get(k, 0)) < 0.005 for k, v in before.items())


def test_numbers_in_the_transfer_stream(spark, tmp_path):
    """Three batches refuse the numbers of earlier ones and of the stored log, as one batch of the operator does."""
    b = Fixture(spark, SF).bank()
    k = F.col("seq")
    req = Fixture(spark, SF).view("transfer_req").select(
        "seq", F.lit("transfer").alias("kind"), F.lit(None).cast("int").alias("num_conta"), F.lit("transferência").alias("tipo"),
        F.round(F.col("valor") / 1000, 2).alias("valor"), "solicitante", "conta_origem", "conta_destino", F.lit(None).cast("int").alias("num_transacao"),
        F.when(k % 4 == 0, (k % 3).cast("int")).alias("num_trans_origem"), F.when(k % 8 == 2, F.lit(5)).alias("num_trans_destino"))
    log = b.conta.where("num_conta % 7 = 0").select("num_conta", F.lit(5).alias("num_transacao"))
    batch, _ = K2.run_transfers(b, None, req, "double_entry", log)
    exp = {r["seq"]: r["status"] for r in batch.collect()}
    source = f"{tmp_path}/source"
    marks = [0, *req.approxQuantile("seq", [0.3, 0.7], 0.0), 1 << 40]
    for lo, hi in zip(marks, marks[1:]):
        req.where((k > lo) & (k <= hi)).coalesce(1).write.mode("append").parquet(source)
        src = spark.readStream.schema(req.schema).parquet(source)
        out = post_transfers_stream(b, src, "double_entry", folder=f"{tmp_path}/stream", log=log)
    got = {r["seq"]: r["status"] for r in spark.read.parquet(f"{out}/decisions").collect()}
    assert got == exp and "DUPLICATE_NUMBER" in got.values()


def test_numbers_over_many_batches_equal_one_batch(spark, tmp_path):
    """Twenty batches, so the registry merges a level; every number comes again in a later batch."""
    t = (Fixture(spark, SF).bank().transacao.select(F.col("id_transacao").alias("seq"), "num_conta", "num_transacao", "tipo", "valor"))
    t = t.unionByName(t.withColumn("seq", F.col("seq") + 100_000)).where("seq % 10 < 2")
    b, source = Fixture(spark, SF).bank(), f"{tmp_path}/source"
    for part in range(18):
        lo, hi = (part * 700, part * 700 + 700) if part < 9 else (100_000 + (part - 9) * 700, 100_000 + (part - 8) * 700)
        t.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(source)
        out = L.post_stream_versioned(spark.readStream.schema(t.schema).parquet(source), b.conta, folder=f"{tmp_path}/stream")
    got = {r["seq"]: r["status"] for r in spark.read.parquet(f"{out}/decisions").collect()}
    exp = {r["seq"]: r["status"] for r in K.post(b.conta, t, seq="seq").decisions.collect()}
    assert got == exp and "DUPLICATE_NUMBER" in got.values() and os.path.isdir(f"{out}/numbers/level=1/segment=0")
