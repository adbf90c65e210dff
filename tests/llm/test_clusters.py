"""Conversation repair, SimHash balls and ns-bounds against brute force and on awkward rows."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from ledgerlake.llm.queries import QUERIES
from tests.llm.models import LOW, SPACE

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


# --- op11


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda v: " " if v is None else v
        role, text = one(role), one(text)
        how = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def cheapest(rows):
    """Shortest path over (message, place): the least (cost, audit) and its repaired messages, without spans or grammar.

    Layers hold the best entry per place; inserting is relaxed until nothing improves.
    """
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}

    def relax(layer):
        while True:
            more = dict(layer)
            for at, (cost, audit, done) in layer.items():
                for (p, to), q in step.items():
                    if p == at and to != "s":
                        new = (cost + 3, audit + "I", done + [(name[to], "")])
                        if q not in more or new[:2] < more[q][:2]:
                            more[q] = new
            if more == layer:
                return layer
            layer = more

    layer = relax({"": (0, "", [])})
    for role, text, fault in rows:
        nxt = {}
        for at, (cost, audit, done) in layer.items():
            ways = [(at, 4, "D", None)]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                for (p, to), q in step.items():
                    if p == at:
                        if role[:1] == to:
                            ways.append((q, extra, "K", role))
                        if to != "s":
                            ways.append((q, 3 + extra, "R", name[to]))
            for q, more, edit, as_role in ways:
                new = (cost + more, audit + edit, done + ([(as_role, text)] if as_role is not None else []))
                if q not in nxt or new[:2] < nxt[q][:2]:
                    nxt[q] = new
        layer = relax(nxt)
    return min((layer[p] for p in ("", "a") if p in layer), key=lambda x: x[:2])


def repair_rows(table):
    by = collections.defaultdict(list)
    for r in damaged(table):
        by[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in table}:
        rows = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, full = set(), []
        for _, _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
            seen.add((role, text))
            full.append((role, text, fault))
        turns = [r[1] for r in rows if r[1] is not None]
        count = collections.Counter(f for *_, f in full)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(full, full[1:]))
        cost, audit, done = cheapest(full)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"],
                     count["truncated"], illegal, cost, audit, digest)
    return out


def test_audits_are_the_least_of_all_edit_sequences():
    """The test's own model against an enumeration of every edit sequence with up to three insertions."""
    pattern = re.compile(r"(s?(ua)+)?")

    def enumerate_all(rows):
        found = None
        for edits in itertools.product("DKR", repeat=len(rows)):
            for gaps in itertools.product(range(4), repeat=len(rows) + 1):
                if sum(gaps) > 3:
                    continue
                audit = "".join("I" * g + e for g, e in zip(gaps, edits + ("",)))
                cost = {"I": 3, "D": 4, "K": 0, "R": 3}
                total = sum(cost[e] for e in audit)
                slots, bad, it = [], False, iter(rows)
                for e in audit:
                    role, _, fault = next(it) if e != "I" else ("", "", "")
                    if e in "KR":
                        bad |= fault in ("blank", "duplicate")
                        total += 3 * (fault == "truncated")
                    if e != "D":
                        slots.append([role[:1] or "-"] if e == "K" else ["u", "a"])
                if not bad and any(pattern.fullmatch("".join(p)) for p in itertools.product(*slots)):
                    found = min(found or (total, audit), (total, audit))
        return found

    random.seed(5)
    for _ in range(150):
        rows = [(random.choice(["system", "user", "assistant", "tool", ""]), "x", random.choice(["", "", "truncated", "blank"]))
                for _ in range(random.randrange(4))]
        assert cheapest(rows)[:2] == enumerate_all(rows), rows


def test_spans_parse_like_the_model():
    from ledgerlake.llm.conversations import best, parse

    random.seed(6)
    for n in [1, 2, 3, 7, 8, 9, 17, 60] * 12:
        rows = [(random.choice(["system", "user", "user", "assistant", "assistant", "tool"]), "x",
                 random.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(n)]
        short = {"": "-", "truncated": "t", "blank": "b", "duplicate": "d"}
        kinds = "".join((r[0] if r[0] in "sua" else "-") + short[f] for r, _, f in rows)
        assert best(parse(kinds)) == cheapest(rows)[:2]


def _repaired(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_repair_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _repaired(QUERIES["op11_conversation_repair"](spark, SF)) == repair_rows(rows)


def test_repair_awkward(spark):
    from pyspark.sql import functions as F

    from ledgerlake.llm.conversations import repair, repair_digests

    random.seed(7)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "no", "", None, " \n", "What?", "ünï 文.", "x" * 200_000]
    rows = [(random.choice([1, 2, 3, None, -5]), random.choice([None, 0, 1, 2, 3, 9, 2**62]), random.choice(roles), random.choice(texts))
            for _ in range(120)]
    rows += [(7, t, "user" if t % 2 else "assistant", f"line {t % 40}.") for t in range(900)]       # one long conversation
    rows += [(8, None, "user", "the same.")] * 300 + [(k, 0, "user", "Hi.") for k in range(100, 160)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("id", "h", "part", "k", "n", "audit", "cells", "initial", "fault", "copy", "how", "_c"):
        d = d.withColumn(name, F.lit("clash"))
    expect = repair_rows(rows)
    assert _repaired(repair_digests(d)) == expect
    # Spans of three messages, two by two: the same rows through many levels and borders.
    assert _repaired(repair_digests(d, span=3, fan_in=2)) == expect
    assert repair_digests(d.limit(0)).count() == 0
    plans, stream = repair(spark.createDataFrame([(1, 0, "assistant", "Hello.")], "conv_id long, turn long, role string, text string"))
    assert [tuple(r) for r in stream.orderBy("place").collect()] == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hello.")]
    assert plans.first().audit == "IK"


def test_long_conversation_is_cut_over_tasks(spark):
    from ledgerlake.llm.conversations import damage, messages, spans, with_duplicates

    rows = spark.range(20_000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id, '.') text")
    slim = with_duplicates(messages(damage(rows)).drop("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = spans(slim).select("part", "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r.part for r in found}) > 1 and max(r.n for r in found) <= 4096


# --- op12


def simhash(text, size=3):
    w = SPACE.findall((text or "").translate(LOW))
    grams = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_by_bits(docs, radius=2):
    """doc position: (fingerprint, smallest number reachable), comparing all distinct fingerprints."""
    prints = [simhash(t) for _, t in docs]
    distinct = np.array(sorted(set(prints)), np.uint64)
    up = list(range(len(distinct)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for k in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[k + 1:] ^ distinct[k]) <= radius) + k + 1:
            up[root(int(j))] = root(k)
    place = {int(f): k for k, f in enumerate(distinct)}
    least = {}
    for (i, _), f in zip(docs, prints):
        if i is not None:
            r = root(place[f])
            least[r] = min(least.get(r, i), i)
    return [(i, f"{f:016x}", least.get(root(place[f]))) for (i, _), f in zip(docs, prints)]


def _same(got, expect):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expect, key=key)


def test_simhash_over_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expect = near_by_bits(docs)
    assert any(r[0] != r[2] for r in expect)
    _same(QUERIES["op12_simhash_balls"](spark, SF).collect(), expect)


def test_simhash_awkward(spark, awkward):
    from ledgerlake.llm.simhash import near_duplicates

    docs = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    _same(near_duplicates(awkward).collect(), near_by_bits(docs))
    assert near_duplicates(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_balls_link_all_pairs_within_the_radius(spark, radius):
    from ledgerlake.llm.components import components
    from ledgerlake.llm.simhash import near_fingerprints

    random.seed(radius)
    prints = {random.getrandbits(64) for _ in range(60)}
    for f in list(prints):
        for _ in range(4):
            prints.add(f ^ sum(1 << b for b in random.sample(range(64), random.randrange(1, 6))))
    prints = sorted(prints)
    edges = [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= radius]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = near_fingerprints(spark.createDataFrame([(signed(f),) for f in prints], "f long"), radius)
    found = {(r.u, r.v) for r in links.collect()}
    assert found <= {tuple(sorted((signed(a), signed(b)))) for a, b in edges}
    up = {signed(f): signed(f) for f in prints}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        x, y = sorted((root(signed(a)), root(signed(b))))
        up[y] = x
    got = {r.node: r.component for r in components(links).collect()}
    assert {f: got.get(f, f) for f in up} == {f: root(f) for f in up}


# --- op13


def lloyd(rows, k=16, rounds=3):
    """(key, cluster, distance, cluster inertia, inertia, digest) by full scans over Python integers."""
    x = [(i, [math.floor(64 * float(c)) for c in v]) for i, v in rows
         if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in x if i is not None)[:k]
    centres = np.array([v for _, v in first], np.int64)
    data = np.array([v for _, v in x], np.int64)

    def nearest():
        d = np.stack([((data - c) ** 2).sum(1) for c in centres], 1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        a, _ = nearest()
        for j in set(a.tolist()):
            part = data[a == j]
            centres[j] = [int(s) // len(part) for s in part.sum(0)]
    a, d = nearest()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    return [(i, int(j), int(e), int(d[a == j].sum()), int(d.sum()), digest[j]) for (i, _), j, e in zip(x, a, d)]


def test_ns_bounds_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    _same(QUERIES["op13_ns_bounds"](spark, SF).collect(), lloyd(rows))


def test_ns_bounds_skip_distances_and_agree_with_full_scans(spark):
    """Well separated groups and many ties: the same clusters, far fewer distances than rounds x k."""
    from ledgerlake.llm.kmeans import cluster

    rng = np.random.default_rng(3)
    for middle, spread in ((rng.integers(-900, 900, (8, 6)), 4), (np.zeros((8, 6), int), 2)):
        data = np.repeat(middle, 200, 0) + rng.integers(-spread, spread + 1, (1600, 6))
        starts = data[::200].astype(np.int64)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(data.tolist())], "key long, x array<long>")
        found, history, evaluated = cluster(df, starts, 5)
        centres, same = starts.copy(), []
        for _ in range(6):
            same.append(centres.copy())
            d = ((data[:, None] - centres[None]) ** 2).sum(2)
            a = d.argmin(1)
            for j in set(a.tolist()):
                centres[j] = data[a == j].sum(0) // (a == j).sum()
        assert (history == np.array(same)).all()
        assert sorted(map(tuple, found.collect())) == [(i, int(a[i]), int(d[i, a[i]])) for i in range(len(data))]
        assert evaluated[0] == 1600 * 8 and (spread == 2 or max(evaluated[1:]) < 1600)


def test_ns_bounds_awkward(spark):
    from pyspark.sql import functions as F

    from ledgerlake.llm.kmeans import clustered

    random.seed(9)
    vec = lambda: [random.uniform(-1, 1) for _ in range(64)]
    same = vec()
    rows = [(i, vec()) for i in range(40)] + [(i, same) for i in range(50, 90)] + [(90, same)] * 5
    rows += [(200, None), (201, []), (202, vec()[:63]), (203, vec() + [0.0]), (204, [None] + vec()[1:]), (205, [float("nan")] + vec()[1:]),
             (206, [float("inf")] + vec()[1:]), (207, [-0.0] * 64), (None, vec())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [tuple(r) for r in d.collect()]
    for name in ("key", "x", "h", "j", "cluster", "last", "at", "n", "sums"):
        d = d.withColumn(name, F.lit("clash"))
    _same(clustered(d).drop("centroid").collect(), lloyd(exact))
    assert clustered(d.limit(0)).count() == 0
    few = d.where("vec_id < 5")
    _same(clustered(few).drop("centroid").collect(), lloyd([r for r in exact if r[0] is not None and r[0] < 5]))
    huge = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], "vec_id long, embedding array<float>")
    assert [r.distance for r in clustered(huge, k=1).collect()] == [2 ** 60, 2 ** 60]
