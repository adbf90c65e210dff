"""Column expressions (all JVM-side built-ins; no Python UDFs).

B8 ``since``, F2 ``enum_rank``, H1-H11 scalar helpers.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.schema import CREDIT_KINDS, DEBIT_KINDS, MONEY


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_literal(as_of: str | dt.datetime | None) -> Column:
    """``NOW()`` made explicit: a timestamp_ntz literal (or the current time when None)."""
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return F.lit(as_of).cast("timestamp_ntz")


def window_start(as_of: str | dt.datetime, days: int) -> Column:
    """``as_of - INTERVAL days DAY`` as a constant (foldable, so it reaches the scan)."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")


def since(col: str | Column, as_of: str | dt.datetime, days: int) -> Column:
    """Lower bound only (``col >= as_of - n days``); later rows still count."""
    return _col(col) >= window_start(as_of, days)


def enum_rank(col: str | Column, domain: list[str]) -> Column:
    """declaration index of an ENUM value (1-based; 0 unknown; NULL stays NULL)."""
    return F.array_position(F.array(*[F.lit(v) for v in domain]), _col(col))


def ci_ai(col: str | Column) -> Column:
    """Case- and accent-insensitive view of a text column (the server's default collation)."""
    return F.collate(_col(col), "UNICODE_CI_AI")


def money(col: str | Column) -> Column:
    """REAL amount as DECIMAL(18,2) for exact sums (V1)."""
    return _col(col).cast(MONEY)


def money_out(col: str | Column) -> Column:
    return _col(col).cast("double")


def signed_amount(tipo: str | Column = "tipo", valor: str | Column = "valor") -> Column:
    """Effect of a transaction on the balance: debit kinds subtract, credit kinds add."""
    v = money(valor)
    t = _col(tipo)
    return (F.when(t.isin(DEBIT_KINDS), -v)
            .when(t.isin(CREDIT_KINDS), v)
            .otherwise(F.lit(0).cast(MONEY)))


def is_debit(tipo: str | Column = "tipo") -> Column:
    return _col(tipo).isin(DEBIT_KINDS)


def age_years(birth: str | Column, as_of: str | dt.datetime | dt.date) -> Column:
    """H7: age in full years (``TIMESTAMPDIFF(YEAR, birth, as_of)``)."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if isinstance(as_of, dt.datetime):
        as_of = as_of.date()
    return F.timestamp_diff("YEAR", _col(birth).cast("date"), F.lit(as_of)).cast("int")


def digits_only(col: str | Column) -> Column:
    """H1: keep digits (any Unicode digit); NULL or '' gives ''."""
    return F.coalesce(F.regexp_replace(_col(col), r"[^\p{Nd}]", ""), F.lit(""))


def cpf_mask(col: str | Column) -> Column:
    """H2: 000.000.000-00 when the value has 11 digits; otherwise the value as given; NULL/'' -> ''."""
    c = _col(col)
    d = F.regexp_replace(c.cast("string"), r"[^\p{Nd}]", "")
    masked = F.concat(F.substring(d, 1, 3), F.lit("."), F.substring(d, 4, 3), F.lit("."),
                      F.substring(d, 7, 3), F.lit("-"), F.substring(d, 10, 2))
    return (F.when(c.isNull() | (c == ""), F.lit(""))
            .when(F.length(d) == 11, masked)
            .otherwise(c))


def phone_digits(col: str | Column) -> Column:
    """H3: digits only, first 11."""
    return F.substring(F.regexp_replace(_col(col), r"[^\p{Nd}]", ""), 1, 11)


def date_br(col: str | Column) -> Column:
    """H4 for date/timestamp columns: dd/MM/yyyy."""
    return F.date_format(_col(col), "dd/MM/yyyy")


def text_date_br(col: str | Column) -> Column:
    """H4 for text: 'yyyy-M-d' or 'yyyy-M-d H:m:s' become dd/MM/yyyy; anything else stays as given."""
    c = _col(col)
    as_date = F.try_to_date(c, "yyyy-M-d")
    as_ts = F.try_to_timestamp(c, F.lit("yyyy-M-d H:m:s"))
    return (F.when(c.isNull() | (c == ""), F.lit(""))
            .otherwise(F.coalesce(date_br(as_date), date_br(as_ts), c)))


def sha256_hex(col: str | Column) -> Column:
    """H6: SHA-256 hex digest."""
    return F.sha2(_col(col).cast("string"), 256)


def _rest(col: str | Column, start: int) -> Column:
    """The text from character ``start`` to its end."""
    c = _col(col)
    return F.substring(c, F.lit(start), F.char_length(c))


def trailing_number(col: str | Column, start: int = 4) -> Column:
    """H9: ``CAST(SUBSTRING(col, start) AS UNSIGNED)``: leading digits after optional blanks, else 0."""
    digits = F.regexp_extract(_rest(col, start), r"^\s*([0-9]+)", 1)
    return F.when(digits == "", F.lit(0).cast("bigint")).otherwise(digits.cast("decimal(20,0)").cast("bigint"))


def label_upper(col: str | Column) -> Column:
    """Upper-case label."""
    return F.upper(_col(col))


def label_capitalize(col: str | Column) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    c = _col(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(_rest(c, 2)))
