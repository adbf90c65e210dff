"""SimHash near duplicates by meet-in-the-middle ball hashing.

1. Every document becomes a 64-bit fingerprint: the majority bit, over all word shingles (repeats included), of their
   XXH64. Documents with equal fingerprints are one node, whatever their number.
2. Every fingerprint emits all variants within half the radius. Two fingerprints within the radius share a variant, a
   point halfway between them, so a shuffle on variants brings every such pair together.
3. All members of a bucket lie in a ball around its variant. Fingerprints are distinct there, so a bucket is no larger
   than the ball (65 members for radius 2), however common a text is. For an even radius any two members are within it
   of each other; for an odd one a member near the centre and any other are. So a bucket is linked by a star: its
   smallest near member with each other one. Links found from several variants are made one and verified by counting
   differing bits; components follow from the links. No link is lost: a pair's bucket holds both, joined to its star.

Lower-casing is A-Z only. Texts with fewer words than a shingle are one shingle. Null texts, and texts without words,
have fingerprint zero and are linked like any other. A null number is never the smallest unless all of its component
are null. Repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import scratch, written
from ledgerlake.llm.components import components

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 1 << 15


def fingerprint(text: str | None, size: int = 3) -> int:
    """Majority bits of the XXH64 of the text's shingles, unsigned."""
    # bytes.split() cuts at exactly the white space of the word contract: 9 to 13 and 32.
    flat = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())
    if not flat:
        return 0
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    first, past = np.append(0, gaps + 1), np.append(gaps, len(flat))
    n = max(1, len(first) - size + 1)
    if n == 1:
        first, past = first[:1], past[-1:]
    else:
        first, past = first[:n], past[size - 1:]
    view, set_bits = memoryview(flat), np.zeros(64, np.int64)
    for lo in range(0, n, _STEP):
        h = np.array([xxhash.xxh64_intdigest(view[a:b], SEED) for a, b in
                      zip(first[lo:lo + _STEP].tolist(), past[lo:lo + _STEP].tolist())], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, f (the fingerprint's bits as a signed long)."""
    def build(batches):
        for b in batches:
            f = np.array([fingerprint(t.as_py(), size) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f.view(np.int64))], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, "doc_id long, f long")


def ball(radius: int, bits: int = 64) -> list[int]:
    """Masks with at most ``radius`` set bits, as signed longs."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def _apart(u: Column, v: Column) -> Column:
    return F.bit_count(u.bitwiseXOR(v))


def near_fingerprints(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """nodes: f (distinct). Returns u, v: stars of links within ``radius`` whose components are those of all such pairs."""
    outer = (radius + 1) // 2
    masks = F.array(*[F.lit(m) for m in ball(outer)])
    sent = nodes.select("f", F.explode(masks).alias("m")).select(F.col("f").bitwiseXOR(F.col("m")).alias("variant"), "f")
    # A bucket holds distinct members of one ball: its list is bounded by len(masks).
    met = sent.groupBy("variant").agg(F.collect_list("f").alias("fs")).where(F.size("fs") > 1)
    near = F.filter("fs", lambda f: _apart(f, F.col("variant")) <= radius - outer)
    stars = met.withColumn("u", F.array_min(near)).where("u is not null")
    pairs = stars.select("u", F.explode("fs").alias("v")).where("u <> v")
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return pairs.where(_apart(F.col("u"), F.col("v")) <= radius)


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest number reachable by links)."""
    with scratch(docs.sparkSession):
        prints = written(fingerprints(docs, size), "fingerprints", keep=True)
        nodes = written(prints.groupBy("f").agg(F.min("doc_id").alias("least")), "nodes")
        links = written(near_fingerprints(nodes.select("f"), radius), "links")
        groups = components(links)
        named = nodes.join(groups.withColumnRenamed("node", "f"), "f", "left").withColumn("component", F.coalesce("component", "f"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        label = written(named.select("f", "component").join(least, "component").select("f", "component_id"), "labels", keep=True)
    return (prints.join(label, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"))
