"""A4: deliver a report: formatting is an export step, never part of the query."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlake.functions.formatting import format_dates, mask_cpfs


def export_report(df: DataFrame, path: str, fmt: str = "parquet", format_for_display: bool = False,
                  cpf_cols: tuple[str, ...] = (), partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Write ``df`` (optionally with dd/MM/yyyy dates and masked CPFs) to ``path``."""
    out = df
    if format_for_display:
        out = mask_cpfs(format_dates(out), list(cpf_cols))
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
