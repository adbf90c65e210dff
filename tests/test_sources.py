"""A1/A3/A4 and the month-partitioned layout."""

import os
import tempfile

from ledgerlake.operators import reports as R
from ledgerlake.sources.export import export_report
from ledgerlake.sources.tables import conform, load_written_bank, write_bank
from tests.seed import seed_bank

AS_OF = "2026-06-10 00:00:00"


def test_write_and_prune_by_month(spark):
    import datetime as dt

    b = seed_bank(spark, {"transacao": [(4, 3, 61007, "saque", dt.datetime(2020, 1, 5), 1.0)]})
    path = tempfile.mkdtemp(prefix="ledgerlake-bank-")
    write_bank(b, path)
    assert sorted(d for d in os.listdir(f"{path}/transacao") if d.startswith("ano_mes=")) == [
        "ano_mes=202001", "ano_mes=202509", "ano_mes=202605", "ano_mes=202606"]
    lb = load_written_bank(spark, path)
    df = R.activity_count(lb, AS_OF, 7)
    assert [tuple(r) for r in df.collect()] == [(61007, 1)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ano_mes" in plan and ">= 202606" in plan


def test_conform_defaults_and_export(spark):
    rows = spark.createDataFrame([(9, "x", "conta-corrente", 1, "MAT2040")],
                                 "NUM_CONTA int, senha string, tipo_conta string, num_ag int, matricula_gerente string")
    r = conform(rows, "conta").collect()[0]
    assert (r["num_conta"], r["saldo"], r["taxa_juros"]) == (9, 0.0, None)
    out = tempfile.mkdtemp(prefix="ledgerlake-export-") + "/statement"
    export_report(R.v_statement(seed_bank(spark)), out, fmt="csv", format_for_display=True)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert "05/06/2026" in text
