"""Conflict components: of accounts that transfers link (K2), and of requests that compete for unique keys.

Contraction: in every step each node follows the neighbour (or itself) of least random rank, and links between those
heads are the graph of the next step. A chain loses half of its nodes in a step, and ranks are kept for two steps, so a
star ends with the second. So the steps grow with the logarithm of the longest chain, and all steps together read a
small multiple of the links. A step is a minimum per node (a partial aggregate) joined back, so an account with a third
of all transfers is pre-aggregated and its join split by AQE. Every step is cut by files in the checkpoint folder. Then heads
are handed down, the smallest graph first, and every component is named by its smallest node.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.prefix import prefix_sum
from ledgerlake.session import cut_and_count, cut_to_files, shuffled


def _downward(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller end, each once, loops left out."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


CUT_EVERY = 8  # steps whose heads are handed down in one plan


def components(links: DataFrame) -> DataFrame:
    """links: u, v. Returns node, component (its smallest node) of every node that a link names; loops name none."""
    edges, left = cut_and_count(_downward(links))
    steps: list[DataFrame] = []
    while left:
        rank = lambda c: F.xxhash64(F.col(c), F.lit(len(steps) // 2))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("m"), F.min(rank("v")).alias("r"))
        heads = cut_to_files(least.select(F.col("u").alias("node"), F.when(rank("u") <= F.col("r"), F.col("u")).otherwise(F.col("m")).alias("head")))
        steps.append(heads)
        moved = edges.join(heads, F.col("u") == F.col("node")).select(F.col("head").alias("u"), "v")
        moved = moved.join(heads, F.col("v") == F.col("node")).select("u", F.col("head").alias("v"))
        edges, left = cut_and_count(_downward(moved))
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    named = steps.pop()
    while steps:
        top = named.select(F.col("node").alias("head"), F.col("head").alias("_top"))
        named = steps.pop().join(top, "head", "left").select("node", F.coalesce("_top", "head").alias("head"))
        if len(steps) % CUT_EVERY == 0:
            named = cut_to_files(named)
    return named.join(named.groupBy("head").agg(F.min("node").alias("component")), "head").select("node", "component")


def _fold_keys(batches):
    """Rows sorted by (component, seq): accept a row unless one of its keys is taken; one component's keys are held at a time."""
    component, taken = None, set()
    for pdf in batches:
        accepted = []
        for comp, keys, gone in zip(pdf["_component"], pdf["_keys"], pdf["_gone"]):
            if comp != component:
                component, taken = comp, set()
            ok = not gone and taken.isdisjoint(keys)
            if ok:
                taken.update(keys)
            accepted.append(ok)
        yield pd.DataFrame({"_seq": pdf["_seq"], "accepted": accepted})


def fold_unique(pending: DataFrame, seq: str, keys: list[str], fold_rows: int) -> DataFrame:
    """``pending`` with boolean ``accepted``: greedy acceptance in ``seq`` order, component by component.

    Requests that hold a common key value, directly or through others, form a component; components are independent
    and folded in parallel. A component is folded ``fold_rows`` rows at a time, so a task holds the keys of at most that
    many rows; between such stretches the keys taken so far are joined to the rest. Key values link by 64-bit hashes,
    where a collision could only join two components; the fold compares the values. Rows without a key are accepted.
    ``seq`` is unique and integral.
    """
    values = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.to_json(k))) for i, k in enumerate(keys)]))
    rows = pending.withColumn("_keys", values).withColumn("_nodes", F.transform("_keys", lambda x: F.xxhash64(x)))
    links = rows.select(F.explode(F.transform(F.slice("_nodes", 2, len(keys)), lambda x: F.struct(
        F.get("_nodes", 0).alias("u"), x.alias("v")))).alias("l")).select("l.u", "l.v").distinct()
    named = components(links).withColumnRenamed("node", "_node")
    rows = rows.withColumn("_node", F.get("_nodes", 0)).join(named, "_node", "left").withColumn("_component", F.coalesce("component", "_node", F.lit(0)))
    ranked = prefix_sum(rows.select(F.col(seq).alias("_seq"), "_component", "_keys"), "_component", "_seq", F.lit(1).cast("long"), "_rank")
    ranked = cut_to_files(ranked.withColumn("_stretch", F.floor((F.col("_rank") - 1) / fold_rows).cast("int")).drop("_rank"))
    last = ranked.agg(F.max("_stretch")).first()[0]
    parts: list[DataFrame] = []
    held = None  # keys that earlier stretches took
    for s in range(last + 1):
        part = ranked.where(F.col("_stretch") == s)
        if held is None:
            part = part.withColumn("_gone", F.lit(False))
        else:
            lost = part.select("_seq", F.explode("_keys").alias("_key")).join(held, "_key", "left_semi").select("_seq").distinct()
            part = part.join(shuffled(lost.withColumn("_lost", F.lit(True))), "_seq", "left").withColumn("_gone", F.col("_lost").isNotNull())
        folded = cut_to_files(part.select("_component", "_seq", "_keys", "_gone").repartition("_component")
                             .sortWithinPartitions("_component", "_seq").mapInPandas(_fold_keys, "_seq long, accepted boolean"))
        parts.append(folded)
        if s < last:
            won = ranked.where(F.col("_stretch") == s).join(folded.where("accepted"), "_seq", "left_semi")
            # Only components that go on need their keys.
            more = ranked.where(F.col("_stretch") > s).select("_component").distinct()
            fresh = won.join(more, "_component", "left_semi").select(F.explode("_keys").alias("_key"))
            held = cut_to_files(fresh if held is None else held.unionByName(fresh))
    return cut_to_files(pending.join(shuffled(reduce(DataFrame.unionByName, parts)), pending[seq] == F.col("_seq")).drop("_seq"))
