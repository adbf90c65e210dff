"""H5 and export formatting: find the date columns of a result and render them dd/MM/yyyy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.functions.exprs import cpf_mask, date_br, text_date_br

_DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def date_columns(df: DataFrame) -> list[str]:
    """Columns typed date/timestamp, or whose name contains 'data' (V6: from the schema, not row 1)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _DATE_TYPES) or "data" in f.name.lower()]


def format_dates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """H5: format the date columns as dd/MM/yyyy text; NULL stays NULL."""
    cols = date_columns(df) if cols is None else cols
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in df.columns:
        if name in cols:
            if isinstance(types[name], _DATE_TYPES):
                e = date_br(name)
            elif isinstance(types[name], T.StringType):
                e = F.when(F.col(name).isNull(), F.lit(None)).otherwise(text_date_br(name))
            else:
                e = F.col(name)
            out.append(e.alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def mask_cpfs(df: DataFrame, cols: list[str]) -> DataFrame:
    """H2 applied to the named columns."""
    return df.select(*[cpf_mask(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def normalize_identity(df: DataFrame, cpf_cols: tuple[str, ...] = (), phone_cols: tuple[str, ...] = ()) -> DataFrame:
    """H1 + H3 at ingest: CPF columns keep digits only ('' for NULL); phone columns keep the first 11 digits."""
    from ledgerlake.functions.exprs import digits_only, phone_digits

    out = []
    for c in df.columns:
        if c in cpf_cols:
            out.append(digits_only(c).alias(c))
        elif c in phone_cols:
            out.append(phone_digits(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def hash_secrets(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """H6 at ingest: replace plain secrets by their SHA-256 hex digest."""
    from ledgerlake.functions.exprs import sha256_hex

    return df.select(*[sha256_hex(c).alias(c) if c in cols else F.col(c) for c in df.columns])
