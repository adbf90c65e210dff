"""Benchmark passages in documents: a prefix-filtered containment join over item-sized windows.

Every run of ``WINDOW`` consecutive words of an item (the whole item if it is shorter) is a set of shingles that a
contaminated document must contain entirely. So one shingle per window, its rarest by the corpus-wide counts, is
a sufficient prefix: documents are joined on these shingles only. A joined shingle fixes where the window would
start (position), which must lie inside the document (length); the words there are then compared exactly.

Documents are read once. A task looks its shingles up in a Bloom filter of fixed size made from the prefix
shingles, so benchmarks of any size cost the same memory, and emits the few that pass with the words around
them; these rows meet the windows in a join on the shingle. A passage that many documents share makes many rows on
one key, which adaptive execution splits; copies of a document are searched once per row but verified alike.

Null texts have no words. Rows equal in number and text are judged together; rows that only share a number are
not. Items without words have no window. Null item numbers are ignored in lists. An empty benchmark leaves every
document clean; no documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import row_key, written
from ledgerlake.llm.sketch import BITS, shingle_counts, slots
from ledgerlake.llm.wordhash import alphabet, mix, windows, words

WINDOW = 10
SHINGLE = 3
BLOOM_BITS = 24
KIND = "alnum_lower"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered_words(text: Column) -> Column:
    """Words after lowering A-Z only."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def _shingles(h: np.ndarray, bound: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and whether each run lies in one row."""
    sh = windows(h, size)
    ok = np.ones(len(sh), bool)
    for back in range(1, size):
        cross = bound[1:-1] - back
        ok[cross[(cross >= 0) & (cross < len(sh))]] = False
    return sh, ok


def _key(sh: np.ndarray, size: int) -> np.ndarray:
    return mix(sh + np.uint64(size))


def benchmark_windows(benchmark: DataFrame, levels: np.ndarray, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, key (rarest shingle), at (its place in the window), size, window (array of words).

    One row per distinct window of an item.
    """
    shared = benchmark.sparkSession.sparkContext.broadcast(levels)

    def cut(batches):
        low = alphabet(KIND).lower
        for b in batches:
            out = []
            items = b.column("item_id").to_pylist()
            for w in words(b.column("text"), KIND):
                for r in range(w.rows):
                    lo, hi = int(w.bound[r]), int(w.bound[r + 1])
                    n = min(window, hi - lo)
                    if n == 0:
                        continue
                    k = min(shingle, n)
                    text = [w.data[w.start[i]:w.end[i]].tobytes().translate(low).decode() for i in range(lo, hi)]
                    sh = windows(w.hashes[lo:hi], k)
                    rank = shared.value[slots(sh, BITS)].astype(np.int64)
                    for i in range(hi - lo - n + 1):
                        span = range(i, i + n - k + 1)
                        at = min(span, key=lambda j: (rank[j], sh[j], j))
                        out.append((items[w.first + r], int(_key(sh[at:at + 1], k).view(np.int64)[0]), at - i, n, text[i:i + n]))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                     pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.list_(pa.string()))],
                    ["item_id", "key", "at", "size", "window"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(
        cut, "item_id string, key long, at int, size int, window array<string>")
    return rows.distinct()


def _bloom_places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - bits)
    return [keys >> shift, mix(keys) >> shift]


def key_filter(keys: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of 2^bits bits over the ``key`` column, built by the executors and merged by or."""
    def build(batches):
        bloom = np.zeros(1 << bits, bool)
        for b in batches:
            for places in _bloom_places(b.column(0).to_numpy().view(np.uint64), bits):
                bloom[places] = True
        yield pa.RecordBatch.from_pydict({"f": pa.array([np.packbits(bloom).tobytes()], pa.binary())})

    rows = keys.select("key").coalesce(8).mapInArrow(build, "f binary").toLocalIterator()
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in rows:
        out |= np.frombuffer(r.f, np.uint8)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Occurrences of item windows: doc_id, _h, item_id, start (word, from 0), size. Distinct rows."""
    spark = docs.sparkSession
    levels = shingle_counts(docs, KIND, shingle)
    grams = written(benchmark_windows(benchmark, levels, window, shingle), "windows")
    bloom = spark.sparkContext.broadcast(key_filter(grams))
    sizes = sorted(r[0] for r in grams.select(F.least(F.lit(shingle), F.col("size"))).distinct().collect())

    def search(batches):
        bits = np.unpackbits(bloom.value).view(bool)
        low = alphabet(KIND).lower
        span = int(np.log2(len(bits)))
        for b in batches:
            numbers, h = b.column("doc_id"), b.column("_h")
            for w in words(b.column("text"), KIND):
                rows, keys, places, around, left = [], [], [], [], []
                for k in sizes:
                    sh, ok = _shingles(w.hashes, w.bound, k)
                    key = _key(sh, k)
                    one, two = _bloom_places(key, span)
                    found = np.flatnonzero(ok & bits[one])
                    found = found[bits[two[found]]]
                    row = np.searchsorted(w.bound, found, "right") - 1
                    for i, r in zip(found.tolist(), row.tolist()):
                        lo, hi = max(int(w.bound[r]), i - window + k), min(int(w.bound[r + 1]), i + window)
                        rows.append(w.first + r)
                        keys.append(int(key[i].view(np.int64)))
                        places.append(i - int(w.bound[r]))
                        left.append(i - lo)
                        around.append([w.data[w.start[j]:w.end[j]].tobytes().translate(low).decode() for j in range(lo, hi)])
                if rows:
                    at = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [numbers.take(at), h.take(at), pa.array(keys, pa.int64()), pa.array(places, pa.int32()),
                         pa.array(left, pa.int32()), pa.array(around, pa.list_(pa.string()))],
                        ["doc_id", "_h", "key", "place", "before", "around"])

    near = (row_key(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "_h", "text")
            .mapInArrow(search, "doc_id long, _h long, key long, place int, before int, around array<string>"))
    met = near.join(grams, "key").where((F.col("before") >= F.col("at"))
                                        & (F.size("around") - F.col("before") >= F.col("size") - F.col("at")))
    same = F.slice("around", F.col("before") - F.col("at") + 1, F.col("size")) == F.col("window")
    return met.where(same).select("doc_id", "_h", "item_id", (F.col("place") - F.col("at")).alias("start"), "size").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: its columns, n_words, n_hit, n_items, items (sorted array), contaminated."""
    found = written(hits(docs, benchmark, window), "hits")
    spans = F.array_sort(F.collect_set(F.struct("start", "size")))
    covered = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        F.greatest(acc["end"], s["start"] + s["size"]).alias("end")), lambda acc: acc["n"])
    per_doc = written(found.groupBy("doc_id", "_h").agg(covered.cast("long").alias("_n_hit"),
                                                        F.array_sort(F.collect_set("item_id")).alias("_items")), "contaminated")
    d = row_key(docs)
    p = per_doc.withColumnsRenamed({"doc_id": "_d", "_h": "_k"})
    return (d.join(p, d["doc_id"].eqNullSafe(p["_d"]) & (d["_h"] == p["_k"]), "left")
            .select(*[d[c] for c in docs.columns],
                    F.size(lowered_words(d["text"])).cast("long").alias("n_words"),
                    F.coalesce("_n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("_items", F.expr("cast(array() as array<string>)")).alias("items"),
                    F.col("_n_hit").isNotNull().alias("contaminated")))
