"""Near-duplicate documents: a rare-first prefix join on word shingles, verified once per pair.

1. Every document becomes a set of shingle hashes (64 bits). Equal sets are one node, whatever their number.
2. Shingles are ordered rare first by corpus-wide counts. Two sets that reach the similarity share a shingle of their
   prefixes, so only prefixes are joined. Length and positional bounds drop pairs, then a suffix bound: every set
   has a bitmap with the parity of its hashes in as many slots as it has elements, and two bitmaps differ in no
   more bits than the sets do in elements. Bitmaps folded to 512 slots travel with the prefixes where needed; pairs
   that remain are held against the whole ones.
3. Remaining pairs are verified exactly, each once, on the full sets, which are read again from the texts.

The result is groups, not pairs, so pairs inside a known group need no test. Each prefix shingle's bucket is first
compared with one pivot, in time linear in the bucket; components are formed; buckets within one component are done.
The others are compared with up to ``PIVOTS`` more pivots, and what then remains is joined in full between different
components, members outside a bucket's largest component against all. So a group of thousands of near copies costs a
few stars of pairs, and no link between different groups is lost.

Lower-casing is A-Z only. Null or empty texts have no shingles and are linked with nothing. A null number is never the
smallest unless all of its group are null. Repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import SPACE_CLASS, row_key, scratch, written
from ledgerlake.llm.components import components
from ledgerlake.llm.sketch import BITS, shingle_counts, slots
from ledgerlake.llm.wordhash import mix, windows, words

KIND = "space_lower"
PIVOTS = 64
SMALL_WORDS = 8


def _row_sets(w, size: int):
    """Sorted distinct shingle hashes of each row; a shorter text is one shingle."""
    sh = windows(w.hashes, size)
    for r in range(w.rows):
        lo, hi = int(w.bound[r]), int(w.bound[r + 1])
        if hi - lo >= size:
            yield np.unique(sh[lo:hi - size + 1])
        elif hi > lo:
            yield windows(w.hashes[lo:hi], hi - lo)
        else:
            yield np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _parities(u: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each slot, packed into 64-bit words; a power of two of slots, at least n."""
    m = 1 << max(6, (len(u) - 1).bit_length())
    odd = (np.bincount((u & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def document_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, _h, a, b (128-bit signature of the set), n (its size), prefix (rarest shingles), bits, small (bits folded)."""
    levels = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, KIND, size))

    def build(batches):
        for batch in batches:
            for w in words(batch.column("text"), KIND):
                sigs, ns, prefixes, maps = [], [], [], []
                for u in _row_sets(w, size):
                    n = len(u)
                    sigs.append((mix(u).sum(dtype=np.uint64), mix(u ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)))
                    ns.append(n)
                    rare = np.argsort(levels.value[slots(u, BITS)], kind="stable")[:n - (percent * n + 99) // 100 + 1]
                    prefixes.append(_signed(u[rare]))
                    maps.append(_parities(u))
                at = slice(w.first, w.first + w.rows)
                a, b = (np.array(c, np.uint64) for c in zip(*sigs))
                ends = np.cumsum([0] + [len(p) for p in prefixes])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[at], batch.column("_h")[at], pa.array(_signed(a)), pa.array(_signed(b)),
                    pa.array(ns, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes), pa.int64())),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(m) for m in maps]), pa.int32()),
                                             pa.array(np.concatenate(maps), pa.int64())),
                    pa.array([np.bitwise_xor.reduce(m.reshape(-1, min(len(m), SMALL_WORDS))) for m in maps],
                             pa.list_(pa.int64()))],
                    ["doc_id", "_h", "a", "b", "n", "prefix", "bits", "small"])

    return (row_key(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "_h", "text")
            .mapInArrow(build, "doc_id long, _h long, a long, b long, n long, prefix array<long>, bits array<long>, small array<long>"))


def _reaches(overlap: Column, n1: Column, n2: Column, percent: int) -> Column:
    """100 * overlap >= percent * union."""
    return (100 + percent) * overlap >= percent * (n1 + n2)


def _bounds(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Length bound, and positional bound for the first shingle that both prefixes share."""
    length = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
    return length & _reaches(1 + F.least(n1 - 1 - p1, n2 - 1 - p2), n1, n2, percent)


def _folded(bits: Column, other: Column) -> Column:
    """``bits`` with half the slots if ``other`` has half as many (sets that pass the length bound differ by no more)."""
    half = (F.size(bits) / 2).cast("int")
    return F.when(F.size(bits) > F.size(other), F.zip_with(
        F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(bits)


def _suffix_bound(n1: Column, bits1: Column, n2: Column, bits2: Column, percent: int) -> Column:
    """The sets differ in at least as many elements as the bitmaps do in bits; the rest must reach the similarity."""
    apart = F.aggregate(F.zip_with(_folded(bits1, bits2), _folded(bits2, bits1), lambda u, v: F.bit_count(u.bitwiseXOR(v))),
                        F.lit(0), lambda acc, v: acc + v)
    return (100 + percent) * (n1 + n2 - apart) >= 2 * percent * (n1 + n2)


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (x < y, distinct) that pass the suffix bound and then the exact test."""
    def read(batches):
        for batch in batches:
            for w in words(batch.column("text"), KIND):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[w.first:w.first + w.rows],
                     pa.array([u.tobytes() for u in _row_sets(w, size)], pa.binary())], ["id", "u"])

    def test(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (u, v) in enumerate(zip(batch.column("ux"), batch.column("uy"))):
                u, v = (np.frombuffer(c.as_buffer(), np.uint64) for c in (u, v))
                both = len(np.intersect1d(u, v, assume_unique=True))
                good[i] = 100 * both >= percent * (len(u) + len(v) - both)
            yield batch.select(["x", "y"]).filter(pa.array(good))

    with scratch(docs.sparkSession):
        info = nodes.select("id", "n", "bits")
        p = (pairs.join(info.toDF("x", "nx", "bx"), "x").join(info.toDF("y", "ny", "by"), "y"))
        near = _suffix_bound(F.col("nx"), F.col("bx"), F.col("ny"), F.col("by"), percent)
        p = written(p.where(near).select("x", "y"), "pairs")
        wanted = p.select(F.col("x").alias("id")).unionByName(p.select(F.col("y").alias("id"))).distinct()
        rep = written(nodes.join(wanted, "id").select("id", "rep.doc_id", "rep._h"), "wanted")
        d = row_key(docs.select("doc_id", "text"))
        r = rep.withColumnsRenamed({"doc_id": "_d", "_h": "_k"})
        texts = (d.join(r, d["doc_id"].eqNullSafe(r["_d"]) & (d["_h"] == r["_k"])).select("id", "text"))
        sets = texts.mapInArrow(read, "id long, u binary").groupBy("id").agg(F.first("u").alias("u"))
        sets = written(sets, "sets")
        full = p.join(sets.toDF("x", "ux"), "x").join(sets.toDF("y", "uy"), "y")
        return written(full.mapInArrow(test, "x long, y long"), "verified", keep=True)


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, _h, n_shingles, component_id (smallest number of its group), group (a key of it)."""
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            sets = written(document_sets(docs, size, percent), "document-sets")
            rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h"))
            nodes = written(sets.where("n > 0").groupBy("a", "b").agg(
                rep.alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"),
                F.first("small").alias("small")).withColumn("id", F.monotonically_increasing_id()), "nodes", keep=True)
            rows = written(sets.select("doc_id", "_h", "a", "b", "n"), "rows", keep=True)
        postings = nodes.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
        postings = postings.select("token", F.struct("id", "n", "pos").alias("p"))
        buckets = postings.groupBy("token").agg(F.min("p").alias("pivot"), F.count("*").alias("k")).where("k > 1")
        shared = written(postings.join(buckets, "token"), "shared")
        links = known = written(postings.sparkSession.createDataFrame([], "x long, y long"), "links")
        groups = links.toDF("node", "component")
        for step in (_pivots_of_buckets, _pivots_between_components, _all_between_components):
            if shared.isEmpty():
                break
            pairs = step(shared, percent).distinct()
            pairs = written(pairs.join(known, ["x", "y"], "left_anti"), "candidates")
            known = known.unionByName(pairs)
            found = verified(pairs, nodes, docs, size, percent)
            if not found.isEmpty():
                links = links.unionByName(found)
                groups = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))
            if step is not _all_between_components:
                shared = _open_buckets(shared, groups, nodes)
        named = nodes.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn(
            "component", F.coalesce("component", "id"))
        first = written(named.groupBy("component").agg(F.min("rep.doc_id").alias("smallest")), "smallest")
        label = written(named.join(first, "component").select("a", "b", "smallest", F.col("component").alias("group")), "labels", keep=True)
        rows = written(rows, "rows", keep=True)
    out = rows.join(label, ["a", "b"], "left")
    return out.select("doc_id", "_h", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def one_of_each(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each group, the one with the smallest number; rows without shingles stay."""
    with scratch(docs.sparkSession):
        found = written(near_duplicates(docs, size, percent), "near-duplicates")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")
        kept = found.where("n_shingles > 0").groupBy("group").agg(F.min(order).alias("r")).select(
            F.coalesce("r.doc_id", F.lit(0)).alias("_d"), F.col("r._h").alias("_h"))
        kept = written(kept, "kept", keep=True).withColumnRenamed("_h", "_k").withColumnRenamed("_d", "_e")
    d = row_key(docs).withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    has_words = F.col("text").rlike(f"[^{SPACE_CLASS}]")
    one = d.where(has_words).join(kept, (F.col("_d") == F.col("_e")) & (F.col("_h") == F.col("_k"))).dropDuplicates(["_d", "_h"])
    return one.select(*docs.columns).unionByName(docs.where(~F.coalesce(has_words, F.lit(False))))


def _open_buckets(shared: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Buckets that still hold members of different components: token, p, small, component, major (the largest one).

    A pivot that was compared with its whole bucket leaves it.
    """
    g = groups.select(F.col("node").alias("_node"), "component")
    left = shared.where(F.col("p.id") != F.col("pivot.id")) if "pivot" in shared.columns else shared
    left = left.select("token", "p").join(g, F.col("p.id") == F.col("_node"), "left").select(
        "token", "p", F.coalesce("component", "p.id").alias("component"))
    left = written(left, "members")
    sizes = left.groupBy("token", "component").agg(F.count("*").alias("c"))
    state = sizes.groupBy("token").agg(F.max(F.struct("c", "component"))["component"].alias("major"), F.count("*").alias("k"))
    bits = nodes.select(F.col("id").alias("_id"), "small")
    return written(left.join(state.where("k > 1").drop("k"), "token").join(bits, F.col("p.id") == F.col("_id")).drop("_id"),
                   "shared")


def _pivots_of_buckets(shared: DataFrame, percent: int) -> DataFrame:
    """Every member with its bucket's pivot."""
    near = shared.where((F.col("p.id") != F.col("pivot.id"))
                        & _bounds(F.col("p.n"), F.col("p.pos"), F.col("pivot.n"), F.col("pivot.pos"), percent))
    return near.select(*_pair(F.col("p.id"), F.col("pivot.id")))


def _met(rows: DataFrame, others: DataFrame, percent: int, once: Column) -> DataFrame:
    """Pairs of different components in a bucket that pass all bounds; ``others`` has q, other and other_small."""
    met = rows.join(others, "token").where(
        (F.col("component") != F.col("other")) & once
        & _bounds(F.col("p.n"), F.col("p.pos"), F.col("q.n"), F.col("q.pos"), percent)
        & _suffix_bound(F.col("p.n"), F.col("small"), F.col("q.n"), F.col("other_small"), percent))
    return met.select(*_pair(F.col("p.id"), F.col("q.id")))


def _pivots_between_components(shared: DataFrame, percent: int) -> DataFrame:
    """Every member with up to ``PIVOTS`` members of its bucket, the smallest of each slot, of other components."""
    slot = F.pmod(F.xxhash64("p.id"), F.lit(PIVOTS))
    pivots = shared.groupBy("token", slot.alias("slot")).agg(F.min(F.struct("p", "component", "small")).alias("v"))
    pivots = pivots.select("token", F.col("v.p").alias("q"), F.col("v.component").alias("other"), F.col("v.small").alias("other_small"))
    return _met(shared, pivots, percent, F.lit(True))


def _all_between_components(shared: DataFrame, percent: int) -> DataFrame:
    """All pairs of a bucket whose components differ: members outside its largest component against all."""
    minor = shared.where("component <> major").select(
        "token", F.col("p").alias("q"), F.col("component").alias("other"), F.col("small").alias("other_small"))
    return _met(shared, minor, percent, (F.col("component") == F.col("major")) | (F.col("p.id") < F.col("q.id")))
