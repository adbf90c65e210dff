"""Path templates per host as a tree, judged by labelled purity, in DataFrame operations only.

Each url's path is cut into segments. Level by level, a segment (of digits or not) stays literal if it has ``LEAST_COUNT`` pages below
its parent; otherwise it becomes a wildcard of its shape (digits and letters generalised), and rare shapes the
general wildcard. Templates of the same parent are taken by their share of bad labelled pages; each joins the branch
before it unless it differs significantly from all of that branch. A branch is rejected if the share of bad pages
among its labelled ones, smoothed towards its host and the whole table, reaches ``REJECT``. Templates without labelled
pages take the share of all their siblings. Fixed rules on host and path come first.

Everything is counted by partial aggregates, so a host with a third of all urls is no heavier than others. A null
url, or one without ://, has empty host and path. Paths may be of any depth: the levels end where no node has
``LEAST_COUNT`` deeper pages, as every segment from there on is a general wildcard.
Repeated rows count as often as they occur and get the same verdict. Empty tables give no rows; without labels
nothing is rejected by the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import written
from ledgerlake.llm.html_extract import host_of

# Host and path rules with their verdicts.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

LEAST_COUNT = 20
Z = 1.96
SMOOTHING = 20.0
REJECT = 0.5


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits (ties cannot differ): its host or a subdomain of it, and a path that starts alike."""
    fits = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        ok = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        fits = F.when(ok, F.lit(rule)).otherwise(fits)
    return fits


def _shape(segment: Column) -> Column:
    """Digits to {9}, other runs of letters with digits to {a9}; literal parts such as an extension stay."""
    stem = F.regexp_replace(segment, r"[0-9]+", "9")
    return F.concat(F.lit("{"), F.regexp_replace(stem, r"[\p{L}_-]{4,}", "a"), F.lit("}"))


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with parent and template (strings of segments)."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = urls.withColumn("_parts", parts).withColumn("parent", F.lit(None).cast("string")).withColumn("template", F.lit(""))
    level = 0
    while True:
        seg = F.get("_parts", F.lit(level))
        rows = rows.withColumn("_seg", seg).withColumn("_shape", F.when(seg.isNotNull(), _shape(seg)))
        n = written(rows.where("_seg is not null").groupBy("host", "template", "_seg", "_shape").agg(
            F.count("*").alias("_n")), "children")
        shapes = n.groupBy("host", "template", "_shape").agg(F.sum("_n").alias("_of_shape"))
        literal = (n.where(F.col("_n") >= LEAST_COUNT)
                   .select(F.col("host").alias("_lh"), F.col("template").alias("_lt"), F.col("_seg").alias("_ls")))
        shaped = (shapes.where(F.col("_of_shape") >= LEAST_COUNT)
                  .select(F.col("host").alias("_sh"), F.col("template").alias("_st"), F.col("_shape").alias("_ss")))
        literal, shaped = written(literal, "literals"), written(shaped, "shapes")
        rows = (rows.join(literal, (F.col("host") == F.col("_lh")) & (F.col("template") == F.col("_lt"))
                          & (F.col("_seg") == F.col("_ls")), "left")
                .join(shaped, (F.col("host") == F.col("_sh")) & (F.col("template") == F.col("_st"))
                      & (F.col("_shape") == F.col("_ss")), "left"))
        node = F.coalesce("_ls", "_ss", F.lit("{*}"))
        more = F.col("_seg").isNotNull()
        rows = (rows.withColumn("parent", F.when(more, F.col("template")).otherwise(F.col("parent")))
                .withColumn("template", F.when(more, F.concat("template", F.lit("/"), node)).otherwise(F.col("template")))
                .drop("_ls", "_lh", "_lt", "_ss", "_sh", "_st", "_seg", "_shape"))
        rows = written(rows, "level")
        level += 1
        deeper = rows.where(F.size("_parts") > level).groupBy("host", "template").count()
        if deeper.where(F.col("count") >= LEAST_COUNT).isEmpty():
            break
    # Below such nodes no segment and no shape is frequent.
    left = F.size("_parts") - level
    rows = (rows.withColumn("parent", F.when(left > 0, F.concat("template", F.repeat(F.lit("/{*}"), left - 1))).otherwise(F.col("parent")))
            .withColumn("template", F.when(left > 0, F.concat("template", F.repeat(F.lit("/{*}"), left))).otherwise(F.col("template"))))
    return rows.drop("_parts").withColumn("parent", F.coalesce("parent", F.lit("")))


def _starts(sequence: str) -> Column:
    """Places in an ordered array of (n, b) where a new branch starts: the next differs from all of the branch so far."""
    def add(acc: Column, x: Column) -> Column:
        n = F.greatest(acc["n"], F.lit(1))
        pooled = (acc["b"] + x["b"] + 0.5) / (n + x["n"] + 1.0)
        gap = (x["b"] / x["n"] - acc["b"] / n) / F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / x["n"]))
        new = (acc["n"] > 0) & (gap >= Z)
        return F.struct(F.when(new, x["n"]).otherwise(acc["n"] + x["n"]).alias("n"),
                        F.when(new, x["b"]).otherwise(acc["b"] + x["b"]).alias("b"), (acc["i"] + 1).alias("i"),
                        F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("i"),
                    F.array().cast("array<int>").alias("starts"))
    return F.aggregate(sequence, zero, add, lambda acc: acc["starts"])


def branch_purity(rows: DataFrame) -> DataFrame:
    """host, parent, template, branch, bad_share: rows have ``bad`` (1, 0 or null for unlabelled).

    ``branch`` is null for templates without labelled pages.
    """
    leaf = written(rows.groupBy("host", "parent", "template").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("b")), "leaves")
    rate = ((F.col("b") + 0.5) / (F.col("n") + 1.0)).alias("_rate")
    ordered = leaf.where("n > 0").groupBy("host", "parent").agg(
        F.array_sort(F.collect_list(F.struct(rate, "template", "n", "b"))).alias("_all"))
    split = (ordered.withColumn("_starts", _starts("_all")).select("host", "parent", "_starts", F.posexplode("_all"))
             .select("host", "parent", F.col("col.template").alias("template"), F.col("col.n").alias("n"), F.col("col.b").alias("b"),
                     F.size(F.filter("_starts", lambda at: at <= F.col("pos"))).alias("branch")))
    none = leaf.where("n = 0").select("host", "parent", "template", "n", "b", F.lit(None).cast("int").alias("branch"))
    whole = Window.partitionBy("host", "parent")
    group = Window.partitionBy("host", "parent", "branch")
    total = lambda c: F.when(F.col("branch").isNull(), F.sum(c).over(whole)).otherwise(F.sum(c).over(group))
    host = leaf.groupBy(F.col("host").alias("_host")).agg(F.sum("n").alias("_hn"), F.sum("b").alias("_hb"))
    every = leaf.agg((F.coalesce(F.sum("b"), F.lit(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("r")).first().r or 0.0
    towards = (F.col("_hb") + SMOOTHING * F.lit(float(every))) / (F.col("_hn") + SMOOTHING)
    share = (total("b") + SMOOTHING * towards) / (total("n") + SMOOTHING)
    judged = split.unionByName(none)
    return (judged.join(host, F.col("host") == F.col("_host")).withColumn("bad_share", share)
            .select("host", "parent", "template", "branch", "bad_share"))


def judge(pages: DataFrame, labels: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, bad_share per row of ``pages`` (page_id, url).

    ``labels`` (key, bad): key is the number in the path's last segment, by which a page names its document.
    """
    rules = RULES if rules is None else rules
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = labels.select("key", "bad").where("key is not null and bad is not null").groupBy("key").agg(F.max("bad").alias("bad"))
    number = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1) as bigint)")
    rows = written(urls.withColumn("_key", number).join(known.withColumnRenamed("key", "_key"), "_key", "left").drop("_key"), "urls")
    rows = templates(rows)
    purity = written(branch_purity(rows), "purity")
    p = purity.withColumnsRenamed({"host": "_h", "parent": "_p", "template": "_t"})
    judged = rows.join(p, (rows["host"] == p["_h"]) & (rows["parent"] == p["_p"]) & (rows["template"] == p["_t"]))
    judged = judged.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    by_rule = F.element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), F.col("rule")) if rules else F.lit(None)
    method = F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(by_rule, method).alias("verdict"), "template", "bad_share")
