"""Mixing sources to target weights by pivotal rounding, in DataFrame operations only.

Each source gets a target number of words; target / size of the source is the expected number of copies of
each of its documents. The integral part is given to all; the fractional part is rounded by pivotal steps:
two documents meet, word mass moves from one to the other, at random but fair on average, until one of them
holds none or all of its words. So every step settles one document and keeps the words of the pair. Buckets
of documents are folded this way, one unsettled document of each goes up a tree with a fixed fan-in, and
the root of a source rounds its last document at random. A source's words therefore differ from its target
by less than one document.

Random numbers are hashes of the seed and the two documents, so reruns agree. A source that holds most rows is
spread over its buckets. Null texts and texts without words have size 0 and take 0 words. A null source is
a source of its own, ranked last. Repeated rows are separate documents. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import n_words, row_key, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
FAN_IN = 32


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """source, source_size, target: ``share`` of all words by weight, no source above ``most`` times its own.

    The excess of capped sources is shared again by weight until none is above: with sources ordered by
    ``most * size / weight``, the capped ones come first, and the others share what is left.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    named = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    cap = F.lit(most) * F.col("source_size")
    order = Window.orderBy(F.col("_level"), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (named.withColumn("_level", cap / F.col("weight"))
              .withColumn("_rate", (F.lit(share) * F.sum("source_size").over(everything)
                                    - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(onward))
              .withColumn("_line", F.min(F.when(F.col("_rate") <= F.col("_level"), F.struct("_level", "_rate"))).over(everything)["_rate"]))
    return levels.select("source", "source_size", "n_docs",
                         F.when(F.col("_line").isNull() | (F.col("_level") <= F.col("_line")), cap)
                         .otherwise(F.col("_line") * F.col("weight")).cast("double").alias("target"))


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def _meet(acc: Column, x: Column, seed: int) -> Column:
    """One pivotal step between the open document of ``acc`` and the next one, ``x``."""
    a = acc["open"]
    up = F.least(a["size"] - a["mass"], x["mass"])      # mass that a can take from x
    down = F.least(a["mass"], x["size"] - x["mass"])    # mass that a can give to x
    rise = _unit(F.lit(seed), a["key"], x["key"]) * (up + down) < down
    moved = F.when(rise, up).otherwise(-down)
    a_settled = F.when(rise, a["size"] - a["mass"] <= x["mass"]).otherwise(a["mass"] <= x["size"] - x["mass"])

    def with_mass(item: Column, mass: Column) -> Column:
        return F.struct(item["key"].alias("key"), item["size"].alias("size"), mass.alias("mass"), item["row"].alias("row"))

    def settled(item: Column, all_of_it: Column) -> Column:
        return F.struct(item["row"].alias("row"), F.when(all_of_it, F.lit(1)).otherwise(F.lit(0)).alias("extra"))

    step = F.struct(
        F.concat(acc["done"], F.array(F.when(a_settled, settled(a, rise)).otherwise(settled(x, ~rise)))).alias("done"),
        F.when(a_settled, with_mass(x, x["mass"] - moved)).otherwise(with_mass(a, a["mass"] + moved)).alias("open"))
    return F.when(a.isNull(), F.struct(acc["done"].alias("done"), x.alias("open"))).otherwise(step)


def pivotal_rounds(items: DataFrame, seed: int, fan_in: int = FAN_IN) -> DataFrame:
    """Round ``mass`` of each item to 0 or its ``size``; returns row and extra (0 or 1).

    items: source, bucket, key (long), size (double), mass (double, strictly between 0 and size), row (struct).
    ``bucket`` numbers a source's groups from 0; each level divides it by ``fan_in``.
    """
    # Long documents meet first, so the one that stays open at the end is a short one.
    item = F.struct((-F.col("size")).alias("order"), "key", "size", "mass", "row")
    deepest = items.agg(F.max("bucket")).first()[0]
    results = []
    while deepest is not None:
        kinds = items.schema["row"].dataType.simpleString()
        start = F.struct(F.expr(f"cast(array() as array<struct<row:{kinds},extra:int>>)").alias("done"),
                         F.expr(f"cast(null as struct<key:bigint,size:double,mass:double,row:{kinds}>)").alias("open"))
        folded = written(items.groupBy("source", "bucket").agg(
            F.aggregate(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("order")), start,
                        lambda acc, x: _meet(acc, x, seed)).alias("f")),
            "pivotal")
        results.append(folded.select(F.explode("f.done").alias("d")).select("d.row", "d.extra"))
        opened = folded.select("source", F.floor(F.col("bucket") / fan_in).cast("long").alias("bucket"), "f.open.*")
        if deepest == 0:
            last = F.when(_unit(F.lit(seed), F.col("key")) * F.col("size") < F.col("mass"), 1).otherwise(0)
            results.append(opened.select("row", last.alias("extra")))
            break
        items, deepest = opened, deepest // fan_in
    out = results[0] if results else items.select("row", F.lit(0).alias("extra"))
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        most: float = MOST, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, _h, source, size, source_size, target, copies, taken: one row per row of ``docs``."""
    sizes = written(row_key(docs.select("doc_id", "source", "text"))
                    .select("doc_id", "_h", "source", n_words(F.col("text")).alias("size")), "sizes")
    targets = written(source_targets(sizes, weights, share, most), "targets")
    t = targets.withColumnRenamed("source", "_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    each = (sizes.join(t, sizes["source"].eqNullSafe(t["_s"])).drop("_s")
            .withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate)))
    row = F.struct("doc_id", "_h", "source", "size", "source_size", "target", "whole")
    open_ = (F.col("part") > 0) & (F.col("size") > 0)
    key = F.xxhash64(F.lit(seed), "doc_id", "_h", "size")
    groups = F.ceil(F.col("n_docs") / F.lit(fan_in))
    items = each.where(open_).select(
        "source", F.pmod(F.xxhash64(F.lit(seed + 1), key), groups).cast("long").alias("bucket"), key.alias("key"),
        F.col("size").cast("double").alias("size"), (F.col("part") * F.col("size")).alias("mass"), row.alias("row"))
    rounded = pivotal_rounds(items, seed, fan_in)
    both = rounded.unionByName(each.where(~open_).select(row.alias("row"), F.lit(0).alias("extra")))
    copies = (F.col("row.whole") + F.col("extra")).cast("long")
    return both.select("row.*", copies.alias("copies")).drop("whole").withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, seed: int = 42, **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0, 1 or 2 times).

    Rows equal in number, text and source are told apart by their rank, and share the copies of their key.
    """
    # Plain equality on columns without nulls: the rank's shuffle then serves the join, too.
    number, group = F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"), F.xxhash64("_h", "source")
    per_key = (mix(docs, seed, **how).groupBy(number.alias("_d"), group.alias("_g"))
               .agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies")))
    d = row_key(docs).withColumn("_d", number).withColumn("_g", group)
    d = d.withColumn("_rank", F.row_number().over(Window.partitionBy("_d", "_g").orderBy(F.lit(0))))
    taken = F.element_at("_copies", F.col("_rank")).cast("int")
    return (d.join(per_key, ["_d", "_g"]).withColumn("_n", F.explode(F.array_repeat(F.lit(0), taken)))
            .select(*[d[c] for c in docs.columns]))
