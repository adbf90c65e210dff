"""Text statistics and robust multivariate outliers, in DataFrame operations only.

``text_statistics`` counts, per document and inside its row (no shuffle of words): words, their characters,
symbols, repeated lines, and words in repeated three-word windows. ``robust_outliers`` transforms statistics
into a vector and estimates location and scatter per language and source by minimum covariance determinant:
concentration steps keep the ``SUPPORT`` share of rows nearest by Mahalanobis distance and refit on them, from
``STARTS`` deterministic starts; the estimate of smallest determinant is taken. Each step is one partial aggregate per
group, so a source with a third of all rows is no larger than any other. Rows whose squared distance exceeds the
chi-square limit are outliers.

Rows of groups with fewer than ``LEAST_ROWS`` usable rows are judged by all rows of their language, and those of
languages with fewer by all rows. Null languages and sources are groups of their own. Documents without words have zero statistics, fail
the base rule and take no part in the estimates. Null texts are empty. Repeated rows count as often as they
occur. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import SPACE_CLASS, written

SUPPORT = 0.75
STEPS = 4
STARTS = 2
LEAST_ROWS = 200
# Fixed value: the chi-square quantile with 5 degrees of freedom that a clean row exceeds once in a million.
LIMIT = 35.888187
# Consistency factor of the 0.75-support estimate in 5 dimensions: 0.75 / P(chi-square_7 <= 6.625680).
CONSISTENCY = 0.75 / 0.531212
# Smallest spread of each component: statistics that are constant in clean text would else reject any deviation.
# Each is small enough for a row that is odd in one component only to pass the limit.
FLOOR = (0.30, 0.10, 0.05, 0.10, 0.10)
DIM = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice: sort, keep equal neighbours, add up their reach."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twin(s: Column) -> Column:
        n = F.size(s)
        return F.transform(
            F.filter(F.transform(s, lambda x, k: F.struct(
                x["i"].alias("i"),
                (((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"]))).alias("t"))),
                lambda x: x["t"]), lambda x: x["i"])

    reach = F.aggregate(
        F.sort_array(twin(F.col("_placed"))), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"])
    return placed, reach


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    Three-word windows are compared by a 64-bit hash within one document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    base = (docs.withColumn("_w", _words(text)).withColumn("_lines", lines)
            .withColumn("_windows", F.when(F.size("_w") >= 3, F.transform(
                F.sequence(F.lit(0), F.size("_w") - 3),
                lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))))
    placed, reach = _repeat_words(F.col("_windows"))
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = base.withColumn("_placed", F.when(repeated, placed))
    return out.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_placed").isNotNull(), reach), F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed(few: int = 50, most_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < few) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))


def transformed() -> list[Column]:
    """The statistics as a vector of similar scales: log length, log mean word length, square roots of the shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log(n), F.log(chars / n), F.sqrt(F.col("n_symbols") / chars) * 4.0,
            F.sqrt(F.col("n_dup_lines") / n) * 4.0, F.sqrt(F.col("n_repeat_words") / n)]


def _factor(scale: float) -> list[tuple[str, Column]]:
    """Cholesky factor l_ij of scale * scatter with variances of at least floor, column by column from the moments s_i, s_ij and n."""
    steps: list[tuple[str, Column]] = []
    mean = lambda i: F.col(f"s{i}") / F.col("n")
    for j in range(DIM):
        for i in range(j, DIM):
            cov = (F.col(f"s{j}{i}") / F.col("n") - mean(i) * mean(j)) * scale
            if i == j:
                cov = F.greatest(cov, F.lit(FLOOR[i] ** 2))
            for k in range(j):
                cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            steps.append((f"l{i}{j}", F.sqrt(F.greatest(cov, F.lit(1e-9))) if i == j else cov / F.col(f"l{j}{j}")))
    return steps


def _estimate(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Mean and Cholesky factor per group, from sums."""
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(DIM) for j in range(i, DIM)]
    est = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    for name, value in _factor(scale):
        est = est.withColumn(name, value)
    return est.select(*keys, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(DIM)],
                      *[f"l{i}{j}" for j in range(DIM) for i in range(j, DIM)])


def _on_keys(rows: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, where null equals null; ``right`` has them with a leading underscore."""
    return reduce(lambda a, b: a & b, [rows[k].eqNullSafe(right[f"_{k}"]) for k in keys])


def _joined(rows: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` with the other columns of ``right`` (one row per key)."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    return rows.join(other, _on_keys(rows, other, keys), how).drop(*[f"_{k}" for k in keys])


def _with_distance(rows: DataFrame, est: DataFrame, keys: list[str], name: str = "d2") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution; groups that are null match null."""
    joined = _joined(rows, est, keys)
    total = F.lit(0.0)
    for i in range(DIM):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        joined = joined.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return joined.withColumn(name, total).select(*rows.columns, name)


def _levels(counts: DataFrame, names: list[str], least_rows: int) -> DataFrame:
    """Per group of all keys: _level, how many of its keys it is judged by, and _parts, the levels that its rows are needed for.

    ``counts``: the keys and _n. A level has ``least_rows`` rows, counted over everything that shares its keys; level 0 is all rows.
    """
    groups = counts.withColumn("_level", F.lit(0))
    for d in range(1, len(names) + 1):
        size = counts.groupBy(*names[:d]).agg(F.sum("_n").alias("_size"))
        groups = _joined(groups, size, names[:d]).withColumn(
            "_level", F.when(F.col("_size") >= least_rows, F.lit(d)).otherwise(F.col("_level"))).drop("_size")
    groups = written(groups, "groups")
    whole = not groups.where("_level = 0").isEmpty()
    parts, out = [F.lit(0 if whole else None).cast("int")], groups
    for d in range(1, len(names) + 1):
        need = groups.where(F.col("_level") == d).select(*names[:d]).distinct().withColumn(f"_need{d}", F.lit(d))
        out = _joined(out, need, names[:d])
        parts.append(F.col(f"_need{d}"))
    return out.select(*names, "_level", F.array_compact(F.array(*parts)).alias("_parts"))


def robust_outliers(stats: DataFrame, usable: Column, keys: tuple[str, ...] = ("lang", "source"),
                    support: float = SUPPORT, steps: int = STEPS, least_rows: int = LEAST_ROWS,
                    limit: float = LIMIT) -> DataFrame:
    """``stats`` with d2 (robust squared distance) and outlier (boolean; false where not usable).

    A row is judged by the first of: its keys, fewer of them, all rows, that has ``least_rows`` usable rows; each is
    estimated from all its usable rows. Where even all rows are fewer, they are the group.
    """
    full = [f"_g{i}" for i in range(len(keys))]
    rows = stats.withColumn("_use", usable)
    for i, x in enumerate(transformed()):
        rows = rows.withColumn(f"x{i}", x)
    for n, k in zip(full, keys):
        rows = rows.withColumn(n, F.col(k))
    rows = written(rows, "vectors")
    counts = written(rows.where("_use").groupBy(*full).agg(F.count("*").alias("_n")), "counts")
    groups = written(_levels(counts, full, least_rows), "levels")
    names = ["_level", *full]
    at_level = lambda df: df.withColumns({n: F.when(F.col("_level") > i, F.col(n)) for i, n in enumerate(full)})
    used = _joined(rows.where("_use").select(*full, *[f"x{i}" for i in range(DIM)]), groups.select(*full, "_parts"), full, "inner")
    used = written(at_level(used.withColumn("_level", F.explode("_parts")).drop("_parts")), "used")
    est = written(_starts(used, names), "estimate")
    tried = [*names, "_start"]
    for step in range(steps):
        near = _with_distance(used.withColumn("_start", F.explode(F.array(*map(F.lit, range(STARTS))))), est, tried)
        cut = written(near.groupBy(*tried).agg(F.percentile_approx("d2", support, 2000).alias("_cut")), "cut")
        nearest = _joined(near, cut, tried, "inner").where(F.col("d2") <= F.col("_cut"))
        est = written(_estimate(nearest, tried, CONSISTENCY), "estimate")
    volume = reduce(lambda a, b: a * b, [F.col(f"l{i}{i}") for i in range(DIM)])  # root of the determinant
    kept = [c for c in est.columns if c not in tried]
    best = est.groupBy(*names).agg(F.min_by(F.struct(*kept), F.struct(volume, "_start")).alias("_e")).select(*names, "_e.*")
    judged = at_level(_joined(rows, groups.select(*full, "_level"), full))
    judged = _with_distance(judged, written(best, "best"), names)
    return (judged.withColumn("outlier", F.col("_use") & F.coalesce(F.col("d2") > limit, F.lit(False)))
            .select(*stats.columns, "d2", "outlier"))


def _starts(used: DataFrame, names: list[str]) -> DataFrame:
    """Two first estimates per group: medians with median-based spreads, and the scatter of the spatial signs around them."""
    med = used.groupBy(*names).agg(*[F.percentile_approx(f"x{i}", F.array(*map(F.lit, (0.25, 0.5, 0.75))), 1000)
                                     .alias(f"q{i}") for i in range(DIM)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in range(DIM)]
    med = written(med.select(*names, *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(DIM)],
                             *[(spread[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for j in range(DIM) for i in range(j, DIM)]), "medians")
    signs = _joined(used, med, names, "inner")
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"l{i}{i}") for i in range(DIM)]
    length = F.sqrt(sum((x * x for x in z), F.lit(0.0)))
    signs = signs.withColumn("_r", F.when(length > 0, F.lit(DIM ** 0.5) / length).otherwise(F.lit(0.0)))
    signs = signs.select(*names, *[(F.col(f"m{i}") + z[i] * F.col("_r") * F.col(f"l{i}{i}")).alias(f"x{i}") for i in range(DIM)])
    return (med.withColumn("_start", F.lit(0))
            .unionByName(_estimate(signs, names, 1.0).withColumn("_start", F.lit(1))))


def quality_verdicts(docs: DataFrame, **how) -> DataFrame:
    """Statistics, base rule and method's verdict per document (doc_id, text, lang, source)."""
    stats = written(text_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text"), "statistics")
    stats = stats.withColumn("base_failed", base_failed())
    judged = robust_outliers(stats, ~F.col("base_failed"), **how)
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
