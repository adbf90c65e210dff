"""L1 on state store v2 equals K1 in one and in several batches, with numbers, and after a restart."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import ledger as K
from ledgerlake.sources.fixture import Fixture
from ledgerlake.streaming.stateful import post_stream_state, rocksdb

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _drain(stream, tmp_path):
    with rocksdb(stream.sparkSession):
        q = (stream.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").option("path", f"{tmp_path}/out")
             .format("parquet").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        assert q.exception() is None
    return stream.sparkSession.read.parquet(f"{tmp_path}/out")


def _rows(df):
    return {r["seq"]: (r["status"], r["saldo_apos"]) for r in df.collect()}


def _input(b):
    t = b.transacao.select(F.col("id_transacao").alias("seq"), "num_conta", "num_transacao", "tipo", "valor")
    again = t.where("seq % 11 = 0").withColumn("seq", F.col("seq") + 100_000)   # numbers used before in the stream
    odd = t.where("seq % 97 = 0").select((F.col("seq") + 200_000).alias("seq"), F.lit(1).alias("num_conta"), "num_transacao",
                                         F.lit("saque").alias("tipo"), "valor")
    bad = t.where("seq % 89 = 0").select((F.col("seq") + 300_000).alias("seq"), "num_conta", F.lit(None).cast("int").alias("num_transacao"),
                                         F.when(F.col("seq") % 2 == 0, F.lit("troca")).alias("tipo"), "valor")
    return t.unionByName(again).unionByName(odd).unionByName(bad)


@pytest.mark.parametrize("cuts", [[], [500, 1000, 100_300]])
def test_stream_with_state_equals_batch(spark, tmp_path, cuts):
    """Every batch is started as a query of its own: each restart continues from the stored state."""
    b = Fixture(spark, SF).bank()
    t = _input(b).cache()
    log = t.where("seq % 13 = 0 and seq < 1500").select("num_conta", (F.col("num_transacao") + 1).alias("num_transacao"))
    source = f"{tmp_path}/source"
    bounds = [-1, *cuts, 1 << 40]
    for lo, hi in zip(bounds, bounds[1:]):
        t.where((F.col("seq") > lo) & (F.col("seq") <= hi)).write.mode("append").parquet(source)
        src = spark.readStream.schema(t.schema).parquet(source)
        out = _drain(post_stream_state(src, b.conta, log=log), tmp_path)
    exp = _rows(K.post(b.conta, t, seq="seq", existing_log=log).decisions)
    got = _rows(out)
    assert got == exp
    assert {"DUPLICATE_NUMBER", "UNKNOWN_ACCOUNT", "NULL_FIELD", "INVALID_TYPE", "ACCEPTED"} <= {s for s, _ in got.values()}


@pytest.mark.parametrize("kind", ["state", "group"])
def test_neighbouring_accounts_share_one_call(spark, tmp_path, kind, monkeypatch):
    """300 accounts in two groups and rows without an account: three calls of Python, and each account decided as in the batch."""
    from ledgerlake.streaming import posting as L

    n = F.col("id")
    accounts = spark.range(1024, 1324).select(n.cast("int").alias("num_conta"), F.lit(100.0).alias("saldo"),
                                              F.when(n % 3 == 0, "conta especial").otherwise("conta-corrente").alias("tipo_conta"),
                                              F.when(n % 3 == 0, 50.0).alias("limite_credito"))
    t = spark.range(3000).select(n.alias("seq"), F.when(n % 50 != 7, 1020 + n % 300).cast("int").alias("num_conta"),
                                 F.when(n % 4 == 0, "depósito").otherwise("saque").alias("tipo"), (n % 60).cast("double").alias("valor"))
    t.write.parquet(f"{tmp_path}/source")
    src = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/source")
    if kind == "state":
        out = _drain(post_stream_state(src, accounts), tmp_path)
    else:
        calls, plain = f"{tmp_path}/calls", L._post_group
        os.mkdir(calls)

        def counted(key, pdfs, state):
            open(f"{calls}/{key[0]}", "x").close()
            yield from plain(key, pdfs, state)

        monkeypatch.setattr(L, "_post_group", counted)
        out = L.run_to_table(L.post_stream(src, accounts), "grouped", folder=f"{tmp_path}/grouped")
        assert sorted(os.listdir(calls)) == ["3", "4", "5", "None"] or len(os.listdir(calls)) <= 4
    assert _rows(out) == _rows(K.post(accounts, t, seq="seq").decisions)
