"""Stage a DataFrame as an ordered sequence of single files, for tests that cut a stream into micro-batches."""

import time

from pyspark.sql import functions as F

from ledgerlake.streaming.posting import scratch_path


def stage_in_order(df, seq, cuts, name):
    """One file per ``seq`` range split at ``cuts``, oldest first; with ``maxFilesPerTrigger=1`` a micro-batch each."""
    path = scratch_path(df.sparkSession, name)
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        low = F.lit(True) if lo is None else F.col(seq) >= lo
        high = F.lit(True) if hi is None else F.col(seq) < hi
        df.where(low & high).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path
