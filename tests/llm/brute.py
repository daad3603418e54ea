"""Plain row-at-a-time versions of the corpus operators, for tests only."""

import hashlib
import re

NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def decontaminate(docs, items, size=10):
    """docs: [(id, text)], items: [(id, text)] -> {id: (n_words, n_hit, n_items, sha, contaminated)}"""
    wins = []
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        n = min(size, len(w))
        wins += [(i, tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n]
    by = {}
    for i, w in wins:
        by.setdefault(w, set()).add(i)
    lengths = {len(w) for w in by}
    out = {}
    for d, t in docs:
        w = ALNUM.findall(lower(t or ""))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (got := by.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        names = sorted(str(x) for x in found if x is not None)
        out[d] = (len(w), len(hit), len(names), sha(",".join(names)), bool(hit))
    return out


def shingle_set(text, k):
    w = NOT_SPACE.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_duplicates(docs, k=4, percent=80):
    """docs: [(id, text)] -> {id: (n_shingles, component_id, kept)}"""
    sets = {d: shingle_set(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    index = {}
    for d in ids:
        for s in sets[d]:
            index.setdefault(s, []).append(d)
    for a in ids:
        shared = {}
        for s in sets[a]:
            for b in index[s]:
                if b > a:
                    shared[b] = shared.get(b, 0) + 1
        for b, n in shared.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def remove_repeats(docs, size=20):
    """docs: [(id, text)] -> {id: (n_words, n_removed, sha)}"""
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = NOT_SPACE.findall(t or "")
        gone = set()
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone |= set(range(k, k + size))
            seen.add(key)
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def quality(text):
    w = NOT_SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if NOT_SPACE.search(x)]
    wins = {}
    for k in range(len(w) - 4):
        wins.setdefault(tuple(w[k : k + 5]), []).append(k)
    rep = {i for at in wins.values() if len(at) > 1 for k in at for i in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)
