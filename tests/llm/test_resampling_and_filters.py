"""Importance resampling, filter interactions and the n-gram join against plain versions."""

import math
import random
import re
import zlib
from itertools import permutations

import pytest

import brute
from tidemark.llm import interactions, parity_join, resampling


def _resample(docs, target, least, most, buckets, min_words, percent, seed=2024):
    def grams(t):
        w = brute.ALNUM.findall(brute.lower(t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    found = [(i, *grams(x)) for i, x in docs]
    for _, _, g in found:
        for b in g:
            s[b] += 1
    for x in target:
        for b in grams(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = {}
    for i, n, g in found:
        h = int(brute.sha(f"{seed}:{i}")[:8], 16)
        w = sum(gain[b] for b in g)
        out[i] = [n, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    fit = sorted((i for i in out if out[i][0] >= min_words), key=lambda i: (-out[i][3], i))
    for r, i in enumerate(fit[: percent * len(fit) // 100]):
        out[i][4] = r + 1
    return {i: tuple(x[1:]) for i, x in out.items()}


WORDS = ["a", "b", "Ce", "d1", "élan", "漢字", "E" * 40, "f", "g.h"]


def _texts(seed, n=120):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 2, 19, 20, 60])))) for i in range(n)] + [(500, None), (501, ""), (502, "the long text of " * 20000), (503, "!!! ,,, ---")]


@pytest.mark.parametrize(("least", "most", "buckets", "percent"), [(1, 1, 10000, 10), (1, 3, 97, 50), (2, 4, 1000, 100), (3, 3, 7, 0)])
def test_resampling_equals_brute_force(spark, least, most, buckets, percent):
    docs, target = _texts(least), [t for _, t in _texts(9, 15)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, score string, id int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.importance_resample(df, wanted, least=least, most=most, buckets=buckets, percent=percent, min_words=20).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == _resample(docs, target, least, most, buckets, 20, percent)


def test_resampling_of_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (4, "x"), (5, None)], "doc_id int, text string")
    none = spark.createDataFrame([], "text string")
    rows = resampling.importance_resample(df, none, percent=50).collect()
    assert sorted((r.doc_id or 0, r.n_features) for r in rows) == [(0, 59), (3, 59), (3, 59), (4, 1), (5, 0)]
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1] and all(r.score is None for r in rows if r.doc_id is None)
    assert resampling.importance_resample(df.limit(0), none).count() == 0
    with pytest.raises(TypeError, match="doc_id"):
        resampling.importance_resample(df.selectExpr("cast(doc_id as string) doc_id", "text"), none)


def test_suffix_order_is_that_of_sorted_suffixes():
    import numpy as np

    rng = np.random.default_rng(0)
    for depth in (1, 2, 3, 5, 8):
        sizes = rng.integers(0, 9, 12)
        ids = rng.integers(0, 3, sizes.sum())
        ends = np.repeat(np.cumsum(sizes), sizes)
        left = ends - np.arange(len(ids))
        key = lambda p: tuple(ids[p : min(p + depth, ends[p])])  # noqa: B023, E731
        order = resampling.suffix_order(ids, left, depth)
        assert [key(p) for p in order] == sorted(map(key, range(len(ids))))
        lcp = resampling.common_prefixes(ids, left, order, depth)
        for p, q, n in zip(order[:-1], order[1:], lcp, strict=True):
            a, b = key(p), key(q)
            assert n == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _interactions(docs, labels):
    first, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        if i is None:
            continue
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = brute.NOT_SPACE.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        rows.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part, fails, g, x in rows:
        for o in map("".join, permutations("ABCDE")):
            at = next((k for k, f in enumerate(o) if f in fails), 5)
            for k, f in enumerate(o):
                r = out.setdefault((part, o, k + 1), [0] * 6)
                for c, v in enumerate([at > k, at == k, f in fails and at < k, fails == {f}, at == k and g, at == k and x]):
                    r[c] += v
    total = {}
    for (part, o, k), r in out.items():
        total[part, o[k - 1]] = total.get((part, o[k - 1]), 0) + r[1]
    return {k: (*r, total[k[0], k[1][k[2] - 1]]) for k, r in out.items()}


def test_filter_interactions_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice(["x", "Yy", "z#", "w1", "w2"] if k % 2 else [f"v{j}" for j in range(400)]) for _ in range(rng.choice([0, 5, 199, 200, 300]))) for k in range(25)]
    docs = [(i, rng.choice(pool), rng.choice(["a", "b", None, ""])) for i in range(90)] + [(None, pool[0], "a"), (None, None, "b"), (200, None, "c"), (201, "", "c"), (7, pool[3], "a"), (300, "A b " * 50000, "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*d, "clash", 5) for d in docs], "doc_id long, text string, source string, mask string, step int").repartition(4)
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = interactions.filter_interactions(df, lb)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()} == _interactions(docs, labels)
    assert interactions.filter_interactions(df.limit(0), lb).count() == 0
    assert interactions.filter_interactions(df.where("doc_id = 201"), lb.limit(0)).count() == 600
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "partial_count" in plan


def _join(docs, k=5, percent=80):
    sets = {i: brute.shingle_set(t, k) for i, t in docs}
    linked = {i: [j for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in sets}
    comps = brute.near_duplicates(docs, k, percent)
    same = {i: min(j for j in sets if sets[j] == sets[i]) if sets[i] else i for i in sets}
    return {i: (len(sets[i]), same[i], comps[i][1], len(linked[i])) for i in sets}


def _near(seed, n=70, length=130):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(length)]
    docs = []
    for i in range(n):  # edits on both sides of the limit, cuts, additions
        t = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((i, " ".join(t[: rng.choice([length, length, length * 9 // 10, length * 3 // 4])] + [rng.choice(words) for _ in range(rng.choice([0, 0, 5, 20]))])))
    docs += [(100 + i, " ".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 8, 9, 10])))) for i in range(80)]
    docs += [(300, None), (301, ""), (302, " \t\n"), (303, docs[3][1].upper()), (304, "A b\tc"), (305, "long " * 30000)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "few", "block", "size", "percent"), [(0, 16, 512, 5, 80), (1, 2, 7, 5, 80), (2, 2, 9, 3, 60), (3, 1000, 512, 1, 100), (4, 2, 5, 2, 50)])
def test_join_equals_brute_force(spark, monkeypatch, seed, few, block, size, percent):
    monkeypatch.setattr(parity_join, "FEW", few)
    monkeypatch.setattr(parity_join, "BLOCK", block)
    docs = _near(seed)
    df = spark.createDataFrame([(i, t, "clash", 2) for i, t in docs], "doc_id int, text string, class_id string, n int").repartition(4)
    got = parity_join.ngram_join(df, size=size, percent=percent).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: (a, b, c, d) for i, (a, b, c, d) in _join(docs, size, percent).items()}


def test_join_of_odd_rows(spark):
    t = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(None, t), (None, t), (7, t), (7, t), (9, t), (1, "x")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id or -1, r.n_links) for r in parity_join.ngram_join(df).collect())
    assert rows == [(-1, -1, 0), (-1, -1, 0), (1, 1, 0), (7, 7, 2), (7, 7, 2), (9, 7, 2)]
    assert parity_join.ngram_join(df.limit(0)).count() == 0
    with pytest.raises(TypeError, match="doc_id"):
        parity_join.ngram_join(df.selectExpr("cast(doc_id as string) doc_id", "text"))


def test_sketches_bound_the_difference_and_keys_meet():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60)) if rng.random() < 0.5 else int(rng.integers(1, 3000))
        percent = int(rng.choice([50, 80, 95]))
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        room = (100 - percent) * n // percent
        extra = rng.integers(0, 1 << 63, int(rng.integers(0, room + 1)), dtype=np.uint64)
        split = int(rng.integers(0, len(extra) + 1))
        a, b = np.unique(np.concatenate([both, extra[:split]])), np.unique(np.concatenate([both, extra[split:]]))
        d = len(np.setxor1d(a, b))
        assert d <= parity_join.most_different(len(a), len(b), percent)
        assert parity_join.distances([parity_join.bit_sketch(a)], [parity_join.bit_sketch(b)])[0, 0] <= d
        assert np.intersect1d(parity_join.band_keys(a, percent), parity_join.band_keys(b, percent)).size
