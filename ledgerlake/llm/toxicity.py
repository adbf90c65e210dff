"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes (insult, threat, target, negation, reporting verb, other) in a lexicon transducer whose
insult and threat arcs carry weights. Three transducers follow: negation marks insults shortly after a negator,
reported speech marks those after a reporting verb, and target marks those in a clause that has named a
person. They are composed into one automaton that reads a clause and sends each match's weight to the
kind of its context. A document's score is a logistic function of these sums, so a context counts as much as
labelled documents say, and an isolated word is judged by the clause it stands in.

Learning: the lexicon's words and word beginnings (4 to 6 bytes) are found by sequential covering on labelled
rows that are not held out, at most ``SAMPLE_ROWS`` of them (chosen by a hash of their number; of rows with the same
smallest shingle hash, mostly copies, one): an entry must occur mostly in toxic documents and explain toxic documents
that earlier entries explain little. Context weights are a ridge logistic fit on the same rows. The model is a few
hundred numbers.

Scores read texts only. Null and empty texts have no match and get the score of a document without matches. Without
toxic labelled rows every score is 0. Repeated rows are scored alike. Null numbers are not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import written
from ledgerlake.llm.wordhash import Words, alphabet, mix, windows, words

KIND = "alnum_lower"
SAMPLE_ROWS = 20_000
STEMS = (4, 5, 6)
LEAST_SUPPORT, LEAST_GAIN, LEAST_ODDS, MOST_ENTRIES = 5, 2.0, 30.0, 400
FADE = 0.5
CANDIDATES = 5_000
THRESHOLD = 0.3
NEGATION_SCOPE = 3

# Function words of the context classes, in the four languages of the corpus.
NEGATION = "not never no none nicht kein keine keinen nie pas jamais ne aucun nunca jamás ningún tampoco".split()
REPORTING = ("said says say called calls quoted wrote claims claimed sagte sagt schrieb behauptet nannte dit disait "
             "écrit appelle dijo dice escribió llamó afirma").split()
TARGET = ("you your he she they them him her his their du ihr sie er dich euch dein tu te vous ton il elle ils "
          "usted ustedes ellos ella él tus vosotros").split()
THREAT = ("kill hurt destroy beat shoot burn töten umbringen schlagen zerstören tuer frapper détruire brûler matar "
          "golpear destruir quemar").split()
FEATURES = ("plain", "targeted", "negated", "reported", "threat")
ANY = "any"


@dataclass(frozen=True)
class Transducer:
    """Deterministic: arcs map (state, input) to (state, output); ``ANY`` is the input not listed, copied out."""

    arcs: dict

    def step(self, state, symbol):
        nxt, out = self.arcs.get((state, symbol)) or self.arcs.get((state, ANY)) or (state, symbol)
        return nxt, symbol if out is ANY else out


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """The transducer that feeds first's output to second, for all states that ``symbols`` can reach from (0, 0)."""
    arcs, todo, names = {}, [(0, 0)], {(0, 0): 0}
    while todo:
        a, b = todo.pop()
        for s in symbols:
            a2, mid = first.step(a, s)
            b2, out = second.step(b, mid)
            if (a2, b2) not in names:
                names[a2, b2] = len(names)
                todo.append((a2, b2))
            arcs[names[a, b], s] = (names[a2, b2], out)
    return Transducer(arcs)


SYMBOLS = ["insult", "threat", "target", "negation", "reporting", "other"]


def grammar(scope: int = NEGATION_SCOPE) -> Transducer:
    """Negation, then reported speech, then target."""
    negation = {(0, "negation"): (scope, ANY)}
    for left in range(1, scope + 1):
        negation |= {(left, "negation"): (scope, ANY), (left, "insult"): (left - 1, "negated"),
                     (left, "threat"): (left - 1, "negated"), (left, ANY): (left - 1, ANY)}
    reported = {(0, "reporting"): (1, ANY), (1, "insult"): (1, "reported"), (1, "threat"): (1, "reported")}
    target = {(0, "target"): (1, ANY), (0, "insult"): (0, "plain"), (1, "insult"): (1, "targeted")}
    return compose(compose(Transducer(negation), Transducer(reported), SYMBOLS), Transducer(target), SYMBOLS)


def word_hash(word: str) -> int:
    data = pa.array([word])
    return int(next(words(data, KIND)).hashes[0])


def prefix_hashes(w: Words, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes of each word; 0 for words that are not longer."""
    value = alphabet(KIND).value
    long = w.end - w.start > size
    out = np.zeros(len(w.start), np.uint64)
    at = w.start[long]
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = mix(h ^ value[w.data[at + k]])
    out[long] = h
    return out


def features_of(w: Words) -> list[np.ndarray]:
    """The hashes under which the lexicon may know each word: whole, and by its beginnings."""
    return [w.hashes] + [prefix_hashes(w, k) for k in STEMS]


def clause_of(w: Words) -> np.ndarray:
    """Clause number of each word: clauses end at . ! ? ; : and line ends, and with the row."""
    ends = np.isin(w.data, np.frombuffer(b".!?;:\n", np.uint8))
    count = np.concatenate([[0], np.cumsum(ends)])
    return count[w.start] + w.row_of() * (len(w.data) + 1)


@dataclass(frozen=True)
class Model:
    """entries: hash to weight; weights: one per feature; bias."""

    entries: dict[int, float]
    weights: tuple[float, ...]
    bias: float

    def lexicon(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes, their class (index into SYMBOLS) and weight."""
        known = {}
        for symbol, listed in (("target", TARGET), ("reporting", REPORTING), ("negation", NEGATION), ("threat", THREAT)):
            known |= {word_hash(x): (SYMBOLS.index(symbol), 1.0) for x in listed}
        known |= {h: (SYMBOLS.index("insult"), weight) for h, weight in self.entries.items()}
        keys = np.array(sorted(known), np.uint64)
        return keys, np.array([known[int(k)][0] for k in keys]), np.array([known[int(k)][1] for k in keys])


def _classes(w: Words, keys: np.ndarray, kinds: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(len(w.hashes), SYMBOLS.index("other"))
    weight = np.zeros(len(w.hashes))
    for h in reversed(features_of(w)):  # the whole word decides last
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        kind[hit], weight[hit] = kinds[at[hit]], weights[at[hit]]
    return kind, weight


def _matches(w: Words, lexicon, automaton: Transducer) -> np.ndarray:
    """Per row: the summed weights of its matches by context, on a log scale."""
    out = np.zeros((w.rows, len(FEATURES)))
    kind, weight = _classes(w, *lexicon)
    hot = np.flatnonzero(kind <= SYMBOLS.index("threat"))
    if len(hot):
        clause, row = clause_of(w), w.row_of()
        for c in np.unique(clause[hot]):
            lo, hi = np.searchsorted(clause, [c, c + 1])
            state = 0
            for i in range(lo, hi):
                state, got = automaton.step(state, SYMBOLS[kind[i]])
                if got in FEATURES:
                    out[row[i], FEATURES.index(got)] += weight[i]
    return np.log1p(out)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, y of at most ``rows`` labelled rows that are not held out, chosen by a hash of the number."""
    y = (labels.groupBy("doc_id").agg(F.max(column).alias("y")).where("doc_id is not null and y is not null"))
    y = y.where(~_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    y = written(y, "sample")
    return _without_copies(written(docs.select("doc_id", "text").join(y, "doc_id"), "labelled"))


def _without_copies(sample: DataFrame) -> DataFrame:
    """One row per smallest five-word shingle hash."""
    def least(batches):
        for batch in batches:
            for w in words(batch.column("text"), KIND):
                sh = windows(w.hashes, 5)
                low = [int(sh[lo:hi - 4].min()) if hi - lo >= 5 else hash_of(w.hashes[lo:hi]) for lo, hi in zip(w.bound, w.bound[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[w.first:w.first + w.rows],
                                                  pa.array(np.array(low, np.uint64).view(np.int64))], ["doc_id", "low"])

    def hash_of(h: np.ndarray) -> int:
        return int(windows(h, len(h))[0]) if len(h) else 0

    ids = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(least, "doc_id long, low long")
    one = written(ids.groupBy("low").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "distinct-sample")
    return sample.join(one, "doc_id", "left_semi")


def learn(sample: DataFrame) -> Model:
    """Fit lexicon and context weights on ``sample`` (doc_id, text, y)."""
    sample = written(sample, "labelled")

    def count(batches):
        counts: dict[int, list[int]] = {}
        for batch in batches:
            y = batch.column("y").to_numpy()
            for w in words(batch.column("text"), KIND):
                every = features_of(w)
                for r in range(w.rows):
                    s = slice(w.bound[r], w.bound[r + 1])
                    for h in np.unique(np.concatenate([f[s] for f in every])).tolist():
                        counts.setdefault(h, [0, 0])[int(y[w.first + r] > 0)] += 1
        if counts:
            h = np.array(list(counts), np.uint64).view(np.int64)
            n = np.array(list(counts.values()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n[:, 0]), pa.array(n[:, 1])], ["h", "neg", "pos"])

    total = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0))).first()
    n_pos, n_neg = total[1], total[0] - total[1]
    if n_pos == 0:
        return Model({}, (0.0,) * len(FEATURES), -np.inf)
    found = (sample.select("text", "y").mapInArrow(count, "h long, neg long, pos long").groupBy("h")
             .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where((F.col("h") != 0) & (F.col("pos") >= LEAST_SUPPORT)))
    odds = ((F.col("pos") + 0.1) / (n_pos + 0.2)) / ((F.col("neg") + 0.1) / (n_neg + 0.2))
    best = (found.withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
            .orderBy(F.desc(F.log("odds") * F.col("pos")), "h").limit(CANDIDATES).collect())
    candidates = {r.h & (1 << 64) - 1: (r.pos, r.neg, float(np.log(r.odds))) for r in best}
    entries = _cover(_incidence(sample, candidates), candidates)
    draft = Model(entries, (0.0,) * len(FEATURES), 0.0)
    rows = score_features(sample.select("doc_id", "text", "y"), draft, "y int").drop("doc_id").collect()
    x = np.array([list(r)[1:] for r in rows], float).reshape(len(rows), len(FEATURES))
    weights, bias = _logistic(x, np.array([r.y > 0 for r in rows], float))
    return Model(entries, tuple(weights), bias)


def _incidence(sample: DataFrame, candidates: dict) -> list[set[int]]:
    """Candidates in each toxic row of the sample (bounded by the sample and the number of candidates)."""
    keys = np.array(sorted(candidates), np.uint64)

    def find(batches):
        for batch in batches:
            for w in words(batch.column(0), KIND):
                every = features_of(w)
                got = [np.intersect1d(np.concatenate([f[w.bound[r]:w.bound[r + 1]] for f in every]), keys).view(np.int64)
                       for r in range(w.rows)]
                yield pa.RecordBatch.from_pydict({"hs": pa.array([g.tolist() for g in got], pa.list_(pa.int64()))})

    rows = sample.where("y > 0").select("text").mapInArrow(find, "hs array<long>").collect()
    return [{h & (1 << 64) - 1 for h in r.hs} for r in rows]


def _cover(rows: list[set[int]], candidates: dict) -> dict[int, float]:
    """Entries one by one: the candidate that explains most of the toxic rows, less what it costs in clean ones.

    A row counts ``FADE`` times as much after each entry that explains it, so words of which a row holds several
    are all found, and words that only accompany them in copies of one text are not.
    """
    by: dict[int, list[int]] = {h: [] for h in candidates}
    for i, hs in enumerate(rows):
        for h in hs:
            by[h].append(i)
    places = {h: np.array(v, np.int64) for h, v in by.items()}
    left = np.ones(len(rows))
    entries: dict[int, float] = {}
    gain = {h: float(len(v)) - 3 * candidates[h][1] for h, v in places.items()}
    while gain and len(entries) < MOST_ENTRIES:
        # Gains only fall, so the best old gain that is still the best after an update is the best of all.
        h = max(gain, key=lambda k: (gain[k], candidates[k][0], k))
        now = float(left[places[h]].sum()) - 3 * candidates[h][1]
        if now < gain[h] - 1e-9:
            gain[h] = now
            continue
        if now < LEAST_GAIN:
            break
        del gain[h]
        entries[h] = candidates[h][2]
        left[places[h]] *= FADE
    return entries


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, float]:
    """Newton steps for a ridge logistic fit; weights that fall below zero are set to zero."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(a.shape[1], ridge * max(1, len(y)) * 0.01)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + penalty * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
        w = w - np.clip(np.linalg.solve(hess, grad), -2, 2)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], float(w[-1])


def score_features(docs: DataFrame, model: Model, extra: str = "") -> DataFrame:
    """doc_id, the column named by ``extra`` if any, and one double per feature."""
    lexicon, automaton = model.lexicon(), grammar()
    carry = ["doc_id"] + ([extra.split()[0]] if extra else [])

    def run(batches):
        for batch in batches:
            for w in words(batch.column("text"), KIND):
                f = _matches(w, lexicon, automaton)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c)[w.first:w.first + w.rows] for c in carry] + [pa.array(f[:, k]) for k in range(f.shape[1])],
                    [*carry, *FEATURES])

    schema = ", ".join(["doc_id long"] + [extra] * bool(extra) + [f"{f} double" for f in FEATURES])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry[1:]).mapInArrow(run, schema)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (all columns, as given) with score and predicted."""
    lexicon, automaton = model.lexicon(), grammar()
    names, text = docs.columns, docs.columns.index("text")
    weights, bias = np.array(model.weights), model.bias

    def run(batches):
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for w in words(batch.column(text), KIND):
                z = _matches(w, lexicon, automaton) @ weights + bias
                scores[w.first:w.first + w.rows] = np.exp(-np.logaddexp(0, -z))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                [*(f"c{i}" for i in range(len(names))), "score", "predicted"])

    given = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]
                       + ["score double", "predicted int"])
    return given.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "score", "predicted")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``."""
    model = learn(labelled_sample(docs, labels, "toxic"))
    slim = scored(docs.select("doc_id", "text"), model).drop("text")
    return slim.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
