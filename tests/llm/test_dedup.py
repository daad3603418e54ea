import random

import pytest

import brute
from tidemark.llm import near_dedup, repeats

WORDS = [f"w{i}" for i in range(400)]


def _near_docs(seed):
    rng = random.Random(seed)
    docs, base = [], [rng.choice(WORDS) for _ in range(120)]
    for i in range(60):  # copies around the threshold: several components in the same buckets
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        docs.append((i, " ".join(t)))
    for i in range(60, 90):
        docs.append((i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 4, 5, 40])))))
    docs += [(100, None), (101, ""), (102, " \n"), (103, docs[70][1].upper()), (104, docs[0][1]), (105, "a b c"), (106, "A  b\tc"), (107, "long " * 30000)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "block", "few"), [(0, 256, 16), (1, 7, 2), (2, 7, 1000)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, block, few):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "FEW", few)
    docs = _near_docs(seed)
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, class_id string")
    rows = near_dedup.near_duplicates(df, size=4, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute.near_duplicates(docs)


def test_near_duplicates_of_odd_rows(spark):
    t = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(None, t), (None, t), (7, t), (7, t), (9, t), (1, "x")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert rows == [(-1, -1, True), (-1, -1, True), (1, 1, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    assert near_dedup.near_duplicates(df.where("doc_id = 1")).first().component_id == 1


def test_sketch_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 3, 50, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - n // 5], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)])
        x, y = near_dedup.sketch(np.unique(a)), near_dedup.sketch(np.unique(b))
        want = (n - n // 5) / (n + n // 5)
        assert abs((x == y).mean() - want) < 0.12
        assert not (x == np.uint64(0xFFFFFFFFFFFFFFFF)).any()


def _repeat_docs(seed):
    rng = random.Random(seed)
    passages = [[rng.choice(WORDS) for _ in range(n)] for n in (19, 20, 21, 45, 60)]
    docs = []
    for i in range(40):
        t = []
        for _ in range(rng.randrange(4)):
            t += [rng.choice(WORDS) for _ in range(rng.randrange(30))]
            t += rng.choice(passages)
        docs.append((i, " ".join(t)))
    docs += [(50, "x " * 100), (51, "x " * 15 + "y " * 15), (52, "a b c " * 30), (53, "y " * 12 + "x " * 15 + "y " * 15), (54, None), (55, ""), (56, docs[3][1]), (57, " ".join(passages[4] + passages[4])), (58, "ü ñ\t" * 25), (59, "q " * 30000)]
    rng.shuffle(docs)
    return docs


def test_repeats_equal_brute_force(spark):
    for seed in range(3):
        docs = _repeat_docs(seed)
        df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, kept string")
        got = {r.doc_id: (r.n_words, sum(b - a for a, b in r.removed), brute.sha(r.kept)) for r in repeats.repeated_words(df).collect()}
        assert got == brute.remove_repeats(docs)


def test_repeats_of_odd_rows(spark):
    t = " ".join(WORDS[:30])
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (2, "x " + t), (3, "other " + t)], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.n_words, len(r.kept.split())) for r in repeats.repeated_words(df).collect())
    assert rows == [(-1, 30, 30), (2, 31, 31), (3, 30, 0), (3, 30, 0), (3, 31, 1)]
    assert repeats.repeated_words(df.limit(0)).count() == 0


def test_keys_that_are_no_integers_are_refused(spark):
    df = spark.createDataFrame([("a", "x y")], "doc_id string, text string")
    for f in (near_dedup.near_duplicates, repeats.repeated_words):
        with pytest.raises(TypeError, match="doc_id"):
            f(df)


def test_components_of_chains_and_stars(spark):
    from tidemark.llm.graph import components

    edges = [(i, i + 1) for i in range(1000, 1300)] + [(5, k) for k in range(2000, 2600)] + [(2599, 3000), (7, 7), (8, 9), (9, 8), (8, 9)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1000 for i in range(1001, 1301)} | {k: 5 for k in range(2000, 2600)} | {3000: 5, 9: 8}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_halves_follow_the_counts():
    import numpy as np

    rng = np.random.default_rng(3)
    counts = rng.integers(0, 3, (64, 64)).astype(float)
    counts[:32, 32:] += 50  # most neighbours go from the first classes to the last
    right = repeats.divide(counts)
    assert not right[:32].any() and right[32:].all()
    assert [repeats.rounds(n) for n in (2, 20, 50, 200)] == [1, 2, 3, 5]
