"""Scalar helpers."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlake.functions import exprs as X
from ledgerlake.functions.formatting import format_dates


def _one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("o")).collect()[0]["o"]


def test_cpf_helpers(spark):
    assert _one(spark, X.cpf_mask, "01234567890") == "012.345.678-90"
    assert _one(spark, X.cpf_mask, "123") == "123"
    assert _one(spark, X.cpf_mask, None) == ""
    assert _one(spark, X.digits_only, "012.345.678-90") == "01234567890"
    assert _one(spark, X.digits_only, None) == ""
    assert _one(spark, X.phone_digits, "(88) 99123-45678-99") == "88991234567"


def test_trailing_number(spark):
    assert _one(spark, X.trailing_number, "MAT1007") == 1007
    assert _one(spark, X.trailing_number, "MATx12") == 0
    assert _one(spark, X.trailing_number, "MAT 42a") == 42


def test_age_on_29_february(spark):
    """Full years, as the year-minus-month/day formula."""
    f = lambda c: X.age_years(c, "2018-02-28 00:00:00")
    assert _one(spark, f, dt.date(2000, 2, 29), "date") == 17
    g = lambda c: X.age_years(c, "2018-03-01 00:00:00")
    assert _one(spark, g, dt.date(2000, 2, 29), "date") == 18


def test_enum_rank(spark):
    from ledgerlake.schema import TIPO_CONTA

    r = lambda c: X.enum_rank(c, TIPO_CONTA)
    assert _one(spark, r, "conta especial") == 3
    assert _one(spark, r, "outra") == 0
    assert _one(spark, r, None) is None


def test_format_dates_from_schema(spark):
    df = spark.createDataFrame([(dt.date(2001, 2, 3), dt.datetime(2001, 2, 3, 10, 0), "2001-2-3", "x", None)],
                               "d date, t timestamp_ntz, data_txt string, data_bad string, other string")
    r = format_dates(df).collect()[0]
    assert (r["d"], r["t"], r["data_txt"], r["data_bad"], r["other"]) == ("03/02/2001", "03/02/2001", "03/02/2001",
                                                                         "x", None)


def test_labels(spark):
    assert _one(spark, X.label_capitalize, "depósito") == "Depósito"
    assert _one(spark, X.label_upper, "admin") == "ADMIN"


def test_normalize_identity_and_hash_secrets(spark):
    import hashlib

    from ledgerlake.functions.formatting import hash_secrets, normalize_identity

    df = spark.createDataFrame([("012.345.678-90", "(88) 99123-4567", "pw")], "cpf string, tel string, senha string")
    r = hash_secrets(normalize_identity(df, cpf_cols=("cpf",), phone_cols=("tel",)), ("senha",)).collect()[0]
    assert (r["cpf"], r["tel"], r["senha"]) == ("01234567890", "88991234567", hashlib.sha256(b"pw").hexdigest())
