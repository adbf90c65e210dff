"""Operators on documents against brute force, on the driver's small tables and on awkward rows."""

import os
import random

import numpy as np
import pytest

from ledgerlake.llm.queries import QUERIES, tokenizer_path
from tests.llm import models

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _docs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def whole(spark):
    return _docs(spark.read.parquet(f"{SF}/documents.parquet"))


def _numbered(rows):
    """Rows of ``awkward`` whose number is unique and known, which the plain models can judge alone."""
    count = {}
    for i, _ in rows:
        count[i] = count.get(i, 0) + 1
    return [(i, t) for i, t in rows if i is not None and count[i] == 1]


# --- op1


def test_token_files_round_trip(spark, whole):
    from tokenizers import Tokenizer

    got = sorted(map(tuple, QUERIES["op1_token_files"](spark, SF).collect()))
    assert got == models.token_rows(whole, Tokenizer.from_file(tokenizer_path()))


def test_token_shards_give_sequences_without_copies(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    from ledgerlake.llm.token_files import TokenShard, encode_documents

    texts = [(i, f"some words number {i} " * (i % 40)) for i in range(300)]
    folder, manifest = encode_documents(documents(texts).coalesce(1), tokenizer_path(), str(tmp_path), seq_len=64)
    tok = Tokenizer.from_file(tokenizer_path())
    flat = [x for _, t in texts for x in tok.encode(t, add_special_tokens=False).ids + [1]]
    got = []
    for r in manifest.orderBy("shard").collect():
        shard = TokenShard(folder, r.name)
        assert len(shard) == r.n_sequences == -(-r.n_tokens // 64)
        for k in range(len(shard)):
            ids, mask = shard.sequence(k)
            assert len(ids) == len(mask) == 64 and not ids.flags.owndata and not ids.flags.writeable
            got += ids[np.array(mask.to_pylist())].tolist()
    assert got == flat


def test_token_files_awkward(spark, awkward):
    from tokenizers import Tokenizer

    from ledgerlake.llm.token_files import encode_documents, read_documents

    tok = Tokenizer.from_file(tokenizer_path())
    rows = sorted(read_documents(*encode_documents(awkward, tokenizer_path())).collect(), key=lambda r: r.start)
    assert len(rows) == awkward.count() and rows[0].doc_id is None
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    expect = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in _numbered(_docs(awkward))}
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in expect} == expect
    assert read_documents(*encode_documents(awkward.limit(0), tokenizer_path())).count() == 0


def test_encoder_memory_is_bounded_by_bytes(monkeypatch):
    """Small cache, very long words: the same ids, and neither long words nor more than the bound is remembered."""
    from ledgerlake.llm import token_files

    monkeypatch.setattr(token_files, "CACHE_BYTES", 20_000)
    enc = token_files.Encoder(tokenizer_path())
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) + " " + "ab" * (300 + i) + "-" + "q" * 400 for i in range(30)]
    for t in texts + texts:
        assert list(enc.encode([t]))[0] == np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes()
        assert enc.held < 20_000 + 40_000
    enc._forget()
    assert all(len(w) <= token_files.LONGEST_WORD for w in [*enc.words, *enc.pieces])


def test_piecewise_encoding_equals_whole_encoding():
    from ledgerlake.llm.token_files import Encoder

    enc = Encoder(tokenizer_path())
    rng = random.Random(1)
    parts = ["It's", "DON'T", "naïve", "ÀÉ", "x1y22", "''", "a<|endoftext|>b", "\x1c", "文字", "é", "!!??", "\x85", "ß", "<|", "\x01", "µ", "İ"]
    texts = ["", "  \n"] + [" ".join(rng.choices(parts, k=6)) + rng.choice(["", ".", ","]) for _ in range(300)]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [
        enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# --- op2


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op2_toxicity"](spark, sf).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(label[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in label]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    right = sum(y == p for y, p in held) / len(held)
    found = sum(y == p == 1 for y, p in held) / sum(y for y, _ in held)
    wrong = sum(y == 0 and p == 1 for y, p in held) / sum(y == 0 for y, _ in held)
    assert right > 0.97 and found > 0.85 and wrong < 0.015


def test_grammar_composition_marks_contexts():
    from ledgerlake.llm.toxicity import grammar

    g = grammar()

    def read(*symbols):
        state, out = 0, []
        for s in symbols:
            state, got = g.step(state, s)
            out.append(got)
        return out

    assert read("other", "insult") == ["other", "plain"]
    assert read("negation", "other", "insult")[-1] == "negated"
    assert read("negation", "other", "other", "other", "insult")[-1] == "plain"
    assert read("target", "insult")[-1] == "targeted"
    assert read("reporting", "target", "insult")[-1] == "reported"
    assert read("threat") == ["threat"] and read("reporting", "threat")[-1] == "reported"


def test_toxicity_learns_contexts_and_awkward(spark, documents, awkward):
    from ledgerlake.llm.toxicity import labelled_sample, learn, scored, toxicity

    rng = random.Random(5)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(words, k=30)
        kind = i % 4
        if kind == 0:
            w[10:12] = ["you", rng.choice(["gloop", "snarf"])]
        elif i % 40 == 1:
            w[10:13] = ["they", "said", rng.choice(["gloop", "snarf"])]
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind == 0)))
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = learn(labelled_sample(documents(rows), lab, "toxic"))
    assert len(model.entries) >= 2
    new = documents([(1, "calm you gloop word1"), (2, "she said a gloop came"), (3, "word1 word2"), (4, None), (5, "")])
    p = {r.doc_id: r.predicted for r in scored(new, model).collect()}
    assert p[1] == 1 and p[3] == p[4] == p[5] == 0
    out = toxicity(awkward, lab)
    assert out.count() == awkward.count() and out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert toxicity(awkward, lab.limit(0)).where("score <> 0").count() == 0
    assert toxicity(awkward.limit(0), lab).count() == 0


# --- op3


def test_statistics_and_verdicts(spark, whole):
    text = dict(whole)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op3_robust_outliers"](spark, SF).collect()
    assert len(rows) == len(whole)
    for r in rows:
        s = models.statistics(text[r.doc_id])
        assert s == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and not (r.base_failed and r.kept)
    bad = [r for r in rows if quality.get(r.doc_id) == 0]
    good = [r for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad) and sum(r.kept for r in good) >= 0.98 * len(good)


def test_outliers_awkward(spark, awkward):
    from ledgerlake.llm.outliers import quality_verdicts

    rows = quality_verdicts(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    for i, t in _numbered(_docs(awkward)):
        assert models.statistics(t) == (by[i].n_words, by[i].word_chars, by[i].n_symbols, by[i].n_dup_lines, by[i].n_repeat_words)
    assert by[1].base_failed and not by[1].kept
    assert quality_verdicts(awkward.limit(0)).count() == 0


def test_outliers_plan_has_no_python(spark):
    plan = QUERIES["op3_robust_outliers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_robust_estimate_ignores_a_large_minority(spark):
    """A quarter of the rows far away moves neither location nor scatter enough to hide itself."""
    from pyspark.sql import functions as F

    from ledgerlake.llm.outliers import robust_outliers

    n = 2000
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        far = i % 5 == 0
        words = int(np.exp(rng.normal(6, 0.5)))
        rows.append((i, "en", "a" if i % 3 else None, words, int(words * (9.5 if far else rng.normal(5, 0.1))),
                     int(words * 0.6) if far else 0, 0, 0, far))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, "
                                        "n_symbols long, n_dup_lines long, n_repeat_words long, far boolean")
    out = robust_outliers(stats, F.lit(True)).collect()
    assert all(r.outlier == r.far for r in out)


@pytest.mark.parametrize("odd", range(5))
def test_a_row_odd_in_one_statistic_is_rejected(spark, odd):
    """Clean text has no symbols, repeated lines or repeated words; the odd rows pass the base rule."""
    from ledgerlake.llm.outliers import base_failed, robust_outliers

    rng = np.random.default_rng(5)
    rows = []
    for i in range(1010):
        far = i < 10
        words = 60_000 if far and odd == 0 else int(np.exp(rng.normal(6, 0.4)))
        chars = int(words * (9.5 if far and odd == 1 else rng.normal(5, 0.1)))
        symbols, lines, repeats = (share * words // 100 if far and odd == k else 0 for k, share in ((2, 10), (3, 5), (4, 40)))
        rows.append((i, "en", "a", words, chars, symbols, lines, repeats, far))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, "
                                        "n_symbols long, n_dup_lines long, n_repeat_words long, far boolean")
    out = robust_outliers(stats, ~base_failed()).collect()
    assert all(r.outlier for r in out if r.far) and sum(r.outlier for r in out if not r.far) <= 5


# --- op5


def test_mix_targets_and_rerun(spark, whole):
    text = dict(whole)
    rows = QUERIES["op5_pivotal_mix"](spark, SF).collect()
    again = QUERIES["op5_pivotal_mix"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(whole)
    assert all(r["size"] == len(models.SPACE.findall(text[r.doc_id] or "")) for r in rows)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, taken, target, most = {}, {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        most[s] = max(most.get(s, 0), r["size"])
        target[s] = r.target
        assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    expect = models.targets(sizes)
    assert all(abs(target[s] - expect[s]) < 1e-6 * (1 + expect[s]) for s in sizes)
    assert all(abs(taken[s] - target[s]) <= most[s] for s in sizes)


def test_mix_is_fair_on_average(spark, documents):
    """Over many seeds, each document is taken about as often as its source's rate says."""
    from ledgerlake.llm.mixing import mix

    docs = documents([(i, "w " * (1 + i % 7), f"s{i % 2}") for i in range(40)])
    counts = {}
    for seed in range(12):
        for r in mix(docs, seed=seed, fan_in=4).collect():
            counts.setdefault(r.source, []).append((r.copies, r.target / r.source_size))
    for pairs in counts.values():
        assert abs(np.mean([c for c, _ in pairs]) - pairs[0][1]) < 0.08


def test_mix_awkward(spark, awkward):
    from ledgerlake.llm.mixing import mix, mixed_documents

    rows = mix(awkward).collect()
    assert len(rows) == awkward.count() and sum(r["size"] == 0 for r in rows) == 3
    mixed = mixed_documents(awkward)
    assert mixed.columns == awkward.columns and mixed.count() == sum(r.copies for r in rows)
    assert mix(awkward.limit(0)).count() == 0 and mixed_documents(awkward.limit(0)).count() == 0


def test_mix_plan_has_no_python(spark):
    plan = QUERIES["op5_pivotal_mix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- op6


def test_small_groups_are_judged_by_all_rows_of_their_language(spark):
    """A lone row of a source, a lone language and a null source: odd rows go, ordinary ones stay, whatever their group's size."""
    from ledgerlake.llm.outliers import base_failed, robust_outliers

    rng = np.random.default_rng(8)

    def row(i, lang, source, symbols=0.0):
        words = int(np.exp(rng.normal(6, 0.4)))
        chars = int(words * rng.normal(5, 0.1))
        return (i, lang, source, words, chars, int(symbols * chars), 0, 0, symbols > 0)

    rows = [row(i, ("en", "de")[i % 2], ("a", "b", None)[i % 3]) for i in range(1500)]
    rows += [row(2000, "en", "lone", 0.6), row(2001, "en", "few"), row(2002, "xx", "lone", 0.6), row(2003, "yy", "a"), row(2004, None, None, 0.6),
             row(2005, None, None), row(2006, "en", None, 0.6)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, "
                                        "n_symbols long, n_dup_lines long, n_repeat_words long, far boolean")
    out = robust_outliers(stats, ~base_failed()).collect()
    assert len(out) == len(rows)
    assert all(r.outlier for r in out if r.far) and not any(r.outlier for r in out if r.doc_id >= 2000 and not r.far)
    assert sum(r.outlier for r in out) <= 4 + 5



def test_near_groups(spark, whole):
    rows = QUERIES["op6_jaccard_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == models.near_groups(whole)


def _near_copies(seed, n_groups=12, size=8):
    """Groups of texts that differ in a few words each, around the threshold, plus common passages."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(3000)]
    common = rng.choices(words, k=25)
    rows, i = [], 100
    for g in range(n_groups):
        base = rng.choices(words, k=rng.randint(20, 160)) + (common if g % 2 else [])
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 40)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, (" " if i % 2 else "\t").join(t).title()))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_around_the_threshold(spark, documents, seed):
    from ledgerlake.llm.jaccard_join import near_duplicates

    rows = _near_copies(seed) + [(1, None), (2, ""), (3, "a b"), (4, "A\nb"), (5, "a")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows)).collect()}
    assert got == models.near_groups(rows)


def test_near_groups_awkward(spark, awkward):
    from ledgerlake.llm.jaccard_join import near_duplicates, one_of_each

    rows = near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    one = one_of_each(awkward)
    assert one.columns == awkward.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in one.collect()) == sorted(
        (i or 0, (t or "")[:5]) for i, t in set(_docs(awkward)) if i != 6)
    assert near_duplicates(awkward.limit(0)).count() == 0 and one_of_each(awkward.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    from ledgerlake.llm.components import components

    links = [(i, i + 1) for i in range(60)] + [(200, 200 + k) for k in range(1, 50)] + [(300, 301), (301, 300), (302, 302)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 250)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- op7


def test_repeats_removed(spark, whole):
    rows = QUERIES["op7_substring_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == models.without_repeats(whole)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_shared_passages(spark, documents, seed):
    from ledgerlake.llm.substring_dedup import remove_repeats

    rng = random.Random(seed)
    words = [f"v{i}" for i in range(500)]
    shared = [rng.choices(words, k=k) for k in (49, 50, 51, 120)] + [["same"] * 130, ["a", "b"] * 60]
    rows = []
    for i in range(60):
        t = rng.choices(words, k=rng.randint(0, 80))
        for s in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randint(0, 3)
            t += s[cut:] + rng.choices(words, k=rng.randint(0, 20))
        rows.append((i * 3 % 61, " ".join(t)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in
           remove_repeats(documents(rows), shard_segments=15).collect()}
    assert got == models.without_repeats(rows)


def test_repeats_awkward(spark, awkward):
    from ledgerlake.llm.substring_dedup import remove_repeats

    rows = remove_repeats(awkward).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[5][0].n_removed == 0 and by[6][0].n_removed == by[6][0].n_words == 60_000
    assert all(r.n_removed == 0 for r in by[7])  # equal numbers do not remove each other's words
    assert by[1][0].n_words == by[2][0].n_words == 0
    assert remove_repeats(awkward.limit(0)).count() == 0


def test_fm_index_ranks_and_windows():
    from ledgerlake.llm.fm_index import FmIndex, WaveletTree

    rng = np.random.default_rng(0)
    s = rng.integers(0, 37, 500)
    tree = WaveletTree(s, 37)
    c, i = rng.integers(0, 37, 200), rng.integers(0, 501, 200)
    assert tree.rank(c, i).tolist() == [int((s[:k] == x).sum()) for x, k in zip(c, i)]
    texts = [rng.integers(1, 4, rng.integers(1, 60)).astype(np.int64) for _ in range(40)]
    owners = rng.integers(0, 100, 40)
    for depth in (1, 3, 5, 8):
        first = {}
        for t, o in zip(texts, owners):
            for k in range(len(t) - depth + 1):
                w = tuple(t[k:k + depth])
                first[w] = min(first.get(w, 1000), o)
        got = FmIndex(texts, owners, depth).first_owner(texts)
        assert [g.tolist() for g in got] == [[first[tuple(t[k:k + depth])] for k in range(len(t) - depth + 1)] for t in texts]


# --- op9


def test_licence_base_places(spark, whole):
    from ledgerlake.llm.licenses import PHRASES

    text = dict(whole)
    rows = QUERIES["op9_license_scan"](spark, SF).collect()
    assert len(rows) == len(whole) and any(r.n_base for r in rows)
    for r in rows:
        assert models.phrase_places(text[r.doc_id], PHRASES) == (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licence_chains_and_awkward(spark, documents, awkward):
    from ledgerlake.llm.licenses import TEMPLATES, scan

    mit = TEMPLATES[0][1].split()
    edited = mit[:20] + ["inserted", "words"] + mit[20:40] + mit[42:]
    got = {r.doc_id: r for r in scan(documents([(1, "x y " + " ".join(mit).upper() + " z"), (2, " ".join(edited)),
                                                (3, " ".join(mit[:12])), (4, " ".join(reversed(mit))),
                                                (5, "cc by cc BY-nc"), (6, "cc cc by")])).collect()}
    assert got[1].labels == got[2].labels == "mit" and got[1].covers["mit"] == 1.0 and got[2].covers["mit"] > 0.9
    assert got[3].labels == "" and 0 < got[3].score < 0.75 and got[4].labels == ""
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].base_labels) == (2, 0, 2, "cc-by")
    assert got[6].n_base == 1 and got[6].first_word == 1
    assert scan(awkward).count() == awkward.count() and scan(awkward.limit(0)).count() == 0


def test_licence_rows_do_not_depend_on_their_neighbours(spark, documents):
    """Equal short notices in one batch, in every order, against each text scanned alone."""
    import itertools

    from ledgerlake.llm.licenses import scan

    texts = ["licensed under the mit license", "xx licensed under the mit license", "", "mit", "licensed under the mit license xx",
             "licensed under the"]
    alone = {t: scan(documents([(0, t)])).drop("doc_id").first() for t in texts}
    assert alone[texts[0]].labels == alone[texts[1]].labels == alone[texts[4]].labels == "mit" and alone["mit"].labels == ""
    orders = [t for p in itertools.permutations(texts) for t in p]
    rows = scan(documents(list(enumerate(orders))).coalesce(1)).collect()
    for r in rows:
        assert tuple(r)[1:] == tuple(alone[orders[r.doc_id]]), orders[r.doc_id]


def test_suffix_automaton_matches_all_substrings():
    from ledgerlake.llm.licenses import SuffixAutomaton

    rng = random.Random(2)
    templates = [[rng.randrange(4) for _ in range(rng.randint(3, 30))] for _ in range(6)]
    a = SuffixAutomaton()
    for k, t in enumerate(templates):
        a.add(k, t)
    a.close()
    for _ in range(50):
        s = [rng.randrange(5) for _ in range(40)]
        at = lambda i, n: {(k, j + n - 1) for k, t in enumerate(templates) for j in range(len(t) - n + 1) if t[j:j + n] == s[i:i + n]}
        expect = {}
        for i in range(len(s)):
            n = max((n for n in range(1, len(s) - i + 1) if at(i, n)), default=0)
            if n >= 2 and not (i and at(i - 1, n + 1)):
                expect[i, n] = at(i, n)
        assert {(i, n): e for i, n, e in a.maximal_matches(s, 2)} == expect


# --- op10


def test_contamination(spark, whole):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expect = models.contaminated(whole, items)
    import hashlib

    rows = QUERIES["op10_decontaminate"](spark, SF).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == {i: (n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0)
                   for i, (n, h, f) in expect.items()}


def test_contamination_short_items_and_awkward(spark, documents, awkward):
    from ledgerlake.llm.decontaminate import contamination

    items = [(1, "one"), (2, "Two words"), (3, "three little words"), (4, " ".join(f"k{i}" for i in range(14))), (5, ""),
             (6, None), (7, "the same words in two rows the same words in two"), (7, "one"), (None, "three little words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "ONE"), (2, "x two WORDS-two words"), (3, "three little"), (4, " ".join(f"K{i}" for i in range(2, 13))),
            (5, "three, little; words one"), (6, None), (7, "")]
    expect = models.contaminated(rows, [x for x in items if x[0] is not None])
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in contamination(documents(rows), bench).collect()}
    assert got == expect
    out = contamination(awkward, bench).collect()
    assert len(out) == awkward.count()
    assert [r.contaminated for r in out if r.doc_id == 7 and r.text.startswith("the same")] == [True, True]
    assert contamination(awkward, bench.limit(0)).where("contaminated").count() == 0
    assert contamination(awkward.limit(0), bench).count() == 0


def test_encoder_keeps_a_large_vocabulary():
    """400,000 distinct words fit what an encoder remembers: texts that use them again are not learned anew."""
    import itertools
    import string

    import public_tokenizers
    from ledgerlake.llm.token_files import Encoder

    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    words = ["q" + "".join(x) for x in itertools.islice(itertools.product(string.ascii_lowercase, repeat=5), 400_000)]
    first = [x for k in range(0, len(words), 20_000) for x in enc.encode([" ".join(words[k:k + 20_000])])]
    list(enc.encode(["one more"]))
    assert len(enc.words) == 400_002
    assert list(enc.encode([" ".join(words[:20_000])])) == first[:1]


class _Counted:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode(self, text, **how):
        self.texts.append(text)
        return self.tokenizer.encode(text, **how)


def test_encoder_gives_the_tokenizer_distinct_words_only():
    """Characters beyond plain Latin send their own word to the whole tokenizer, once, and never the document around it."""
    from ledgerlake.llm.token_files import Encoder

    enc = Encoder(tokenizer_path())
    rng = random.Random(3)
    odd = ["“quoted”", "it’s", "ΝαῚΣ", "été", "文字", "a\xa0b", "́x", "İ"]
    texts = [" ".join(rng.choices([*odd, "The", "the", "naïve,", "x1y22"], k=50)) for _ in range(200)]
    expect = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
    enc.tokenizer, enc.bare = whole, bare = _Counted(enc.tokenizer), _Counted(enc.bare)
    assert list(enc.encode(texts)) == expect
    assert sorted(whole.texts) == sorted(odd)
    assert sorted(" ".join(bare.texts).split()) == sorted(["the", "naïve", ",", "x", "1", "y", "2"])
    assert list(enc.encode(texts)) == expect
    assert len(whole.texts) == len(odd)


def test_encoder_takes_columns():
    """A slice of an Arrow column, with nulls, empty texts and spaces at both ends; an empty column; another kind of tokenizer."""
    import pyarrow as pa
    import public_tokenizers

    from ledgerlake.llm.token_files import Encoder

    texts = ["left out", None, "", " \n", "  two words\t", "a<|endoftext|>b c", "“x” " * 50, "'s't''", "last"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = Encoder(public_tokenizers.path(name))
        expect = [np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts[1:]]
        for kind in (pa.string(), pa.large_string()):
            assert list(enc.encode(pa.array(texts, kind).slice(1))) == expect
        assert list(enc.encode(pa.array([], pa.string()))) == []


def test_batches_are_encoded_by_bytes():
    from ledgerlake.llm.token_files import _chunks

    rng = random.Random(8)
    for _ in range(50):
        sizes = np.array([rng.choice([0, 1, 30, 99, 100, 500]) for _ in range(rng.randrange(0, 60))], np.int32)
        got = list(_chunks(sizes, 100))
        assert [i for lo, n in got for i in range(lo, lo + n)] == list(range(len(sizes)))
        assert all(n and sizes[lo + 1:lo + n].sum() < 200 for lo, n in got)


def test_encoder_memory_stays_within_its_bound(monkeypatch):
    """Calls of new words, each of which fits the bound: what is remembered never exceeds it, and the ids stay right."""
    from ledgerlake.llm import token_files

    monkeypatch.setattr(token_files, "CACHE_BYTES", 60_000)
    enc = token_files.Encoder(tokenizer_path())
    for k in range(30):
        t = " ".join("q" + "abcdefghij"[k % 10] * (i % 7) + "xyz"[k // 10] * (i // 7) for i in range(100))
        assert list(enc.encode([t, t])) == [enc._whole(t)] * 2
        assert 0 < enc.held <= 60_000
