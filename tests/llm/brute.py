"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs):
    """{doc_id: (n_shingles, component_id, kept)} for unique ids."""
    sets = {}
    for doc_id, text in docs:
        w = words((text or "").translate(_LOWER))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders = collections.defaultdict(list)
    for doc_id in sorted(sets):
        for s in sets[doc_id]:
            holders[s].append(doc_id)
    common = collections.Counter((a, b) for ids in holders.values() for i, a in enumerate(ids) for b in ids[:i])
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    root = roots(sets, links)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in sets}


def without_repeats(docs):
    """{doc_id: (n_words, n_removed, kept text)} for unique ids."""
    first, found = {}, {}
    for doc_id, text in sorted(docs):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first.setdefault(tuple(w[i : i + 13]), doc_id) < doc_id:
                gone[i : i + 13] = [True] * 13
        found[doc_id] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return found


def base_rules(text):
    w = words(text)
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = [False] * len(w)
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            inside[i : i + 8] = [True] * 8
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), repeated, sum(inside),
            len(w) < 20 or 100 * sum(inside) > 30 * len(w))


def targets(sizes):
    """Water filling, source by source: raise a common level until all words are shared."""
    weights = [i % 3 + 1 for i in range(len(sizes))]
    level, left = 0.0, float(sum(sizes))
    points = sorted(3 * s / w for s, w in zip(sizes, weights))
    for p in [*points, float("inf")]:
        open_weight = sum(w for s, w in zip(sizes, weights) if 3 * s / w > level)
        if not open_weight or left <= (p - level) * open_weight:
            level += left / open_weight if open_weight else 0
            break
        left -= (p - level) * open_weight
        level = p
    return [min(3.0 * s, level * w) for s, w in zip(sizes, weights)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
