"""Feed a DataFrame to a file stream, range by range."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.streaming.posting import scratch_path


def staged_ranges(df: DataFrame, seq: str, cuts: list[int], name: str) -> Iterator[str]:
    """Write ``df`` in ``seq`` ranges split at ``cuts``, oldest first, to one folder; yields it after each range.

    Every range is written by all its tasks in parallel. A stream that is run
    to completion after each yield, in the same checkpoint folder, takes the
    files of one range as one micro-batch.
    """
    path = scratch_path(df.sparkSession, name)
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        low = F.lit(True) if lo is None else F.col(seq) >= lo
        high = F.lit(True) if hi is None else F.col(seq) < hi
        df.where(low & high).write.mode("append").parquet(path)
        yield path
