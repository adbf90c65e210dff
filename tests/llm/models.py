"""Brute-force versions of the operators' results, in plain Python over whole tables."""

import collections
import hashlib
import re
import zlib

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def token_rows(docs, tokenizer):
    out, start = [], 0
    for number, text in sorted(docs, key=lambda d: d[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        out.append((number, start, len(ids), crc))
        start += len(ids)
    return out


def statistics(text):
    text = text or ""
    w = SPACE.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    again = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def shingle_set(text, size=4):
    w = SPACE.findall((text or "").translate(LOW))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*(w[i:] for i in range(size))))


def near_groups(docs, percent=85, size=4):
    """doc number: (set size, smallest number reachable)."""
    sets = {i: shingle_set(t, size) for i, t in docs}
    by = collections.defaultdict(list)
    for i, s in sets.items():
        by[s].append(i)
    distinct = [s for s in by if s]
    place = collections.defaultdict(list)
    up = list(range(len(distinct)))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for k, s in enumerate(distinct):
        common = collections.Counter(j for g in s for j in place[g])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(distinct[j]) - n):
                up[root(k)] = root(j)
        for g in s:
            place[g].append(k)
    least = {}
    for k, s in enumerate(distinct):
        least[root(k)] = min(least.get(root(k), min(by[s])), min(by[s]))
    out = {i: (0, i) for i, s in sets.items() if not s}
    for k, s in enumerate(distinct):
        out |= {i: (len(s), least[root(k)]) for i in by[s]}
    return out


def without_repeats(docs, window=50):
    """doc number: (words, removed words, sha256 of the rest)."""
    split = {i: SPACE.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k:k + window]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def contaminated(docs, items, window=10):
    """doc number: (words, hit words, sorted items)."""
    grams = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOW))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i:i + n])].add(str(item))
    sizes = sorted({len(g) for g in grams})
    out = {}
    for i, text in docs:
        w, hit, found = ALNUM.findall((text or "").translate(LOW)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := grams.get(tuple(w[k:k + n])):
                    found |= got
                    hit.update(range(k, k + n))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def phrase_places(text, phrases):
    w = ALNUM.findall((text or "").translate(LOW))
    at = [(i, label) for p, label in phrases.items() for q in [p.split()] for i in range(len(w) - len(q) + 1) if w[i:i + len(q)] == q]
    return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None),
            ",".join(sorted({x for _, x in at})))


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Target per source by repeated capping and sharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    got, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        more = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s, x in more.items():
            got[s] += x
            if got[s] >= most * sizes[s]:
                left += got[s] - most * sizes[s]
                got[s] = most * sizes[s]
                free.discard(s)
    return got
