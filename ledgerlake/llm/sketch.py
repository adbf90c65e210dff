"""How often shingles occur in the whole corpus, as a table of fixed size.

All shingles of all documents are counted by the upper bits of their hash. The counters have a fixed
number (2^bits, one MB after rounding to powers of two), whatever the corpus holds, so the table can be
broadcast safely. It gives a total order of shingles, rare ones first (ties by hash): a shingle that many
documents share always ranks behind shingles whose counter is low. The order only steers which shingles
are looked at first; results do not depend on it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.wordhash import windows, words

BITS = 20
_PARTS = 64


def slots(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def shingle_counts(docs: DataFrame, kind: str, size: int, bits: int = BITS) -> np.ndarray:
    """log2 (rounded down, plus 1) of each counter, as uint8; zero where nothing was counted.

    Every task counts its documents; the counters are cut into parts that are summed by separate tasks.
    The driver gets 2^bits bytes.
    """
    per = (1 << bits) // _PARTS

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        seen = False
        for b in batches:
            for w in words(b.column(0), kind):
                sh = windows(w.hashes, size)
                row = w.row_of()
                total += np.bincount(slots(sh[row[:len(sh)] == row[size - 1:]], bits), minlength=1 << bits)
                seen = True
        if seen:
            blobs = [zlib.compress(total[i * per:(i + 1) * per].astype("<u4" if total.max() < 1 << 32 else "<u8").tobytes(), 1)
                     for i in range(_PARTS)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(_PARTS), pa.int32()),
                                              "counts": pa.array(blobs, pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1)):
                raw = zlib.decompress(blob.as_py())
                got = np.frombuffer(raw, "<u4" if len(raw) == 4 * per else "<u8").astype(np.int64)
                sums[part] = sums[part] + got if part in sums else got
        if sums:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(sums, pa.int32()),
                "levels": pa.array([np.ceil(np.log2(s + 1)).astype(np.uint8).tobytes() for s in sums.values()],
                                   pa.binary())})

    counted = docs.select("text").mapInArrow(count, "part int, counts binary")
    rows = counted.repartition(_PARTS, F.col("part")).mapInArrow(add, "part int, levels binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    for r in rows:
        out[r.part * per:(r.part + 1) * per] = np.frombuffer(r.levels, np.uint8)
    return out
