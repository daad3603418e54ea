"""The pipeline on a small corpus against its stages done by hand, and odd rows through every stage."""

import random

import pytest

import brute
import corpus_pipeline
from tidemark.llm import byte_bpe, secrets

import public_tokenizers

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(240):
        t = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        if i % 4 == 0:
            for _ in range(4):
                t.insert(rng.randrange(len(t)), rng.choice(["vilewort", "grumpfen"]))
        docs.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(1000, docs[1][1], "en", "s", 0), (1001, docs[2][1] + " extra", "en", "s", 0), (1002, docs[3][1][:40] + " " + ITEM, "en", "s", 0), (1003, 'key password = "Zk39xQ81pLm2" end', "en", "s", 0)]
    docs += [(1004, None, "en", None, None), (1005, "", None, "s", 0), (None, "no key at all", "en", "s", 13), (1003, 'key password = "Zk39xQ81pLm2" end', "en", "s", 0), (1006, "long text " * 20000, "en", "s", 0)]
    docs = [(i, t, lang, s, len(t) if t else 0) for i, t, lang, s, _ in docs]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs


def test_pipeline(spark, corpus):
    sf, docs = corpus
    stages = {}
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        stages[name] = df.collect()
    clean = [x for x in docs if "vilewort" not in (x[1] or "") and "grumpfen" not in (x[1] or "")]
    key = lambda rows: sorted((-1 if r[0] is None else r[0], r[1] or "") for r in rows)
    assert key(stages["toxicity"]) == key(clean)
    kept = brute.near_duplicates([(i, t) for i, t, *_ in clean if i is not None], k=5)
    want = {i: (i, t) for i, t, *_ in clean if i is not None and kept[i][2]}
    assert {1000, 1001}.isdisjoint(want)
    assert key(stages["near_dedup"]) == key([*want.values(), (None, "no key at all")])
    hit = {i for i, r in brute.decontaminate(want.values(), [(0, ITEM)]).items() if r[4]}
    assert hit == {1002}
    assert key(stages["decontamination"]) == key([v for i, v in want.items() if i not in hit] + [(None, "no key at all")])
    by = {r.doc_id: r for r in stages["secrets"]}
    assert by[1003].text == 'key password = "[SECRET]" end' and by[1003].n_chars == len(by[1003].text)
    assert all(not secrets.scan(r.text or "") for r in by.values()) and by[1006].n_chars == 200000
    rows = corpus_pipeline.run(spark, sf).collect()
    enc = byte_bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert len(rows) == len(by) and all(r.round_trip for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(enc.encode_ordinary(r.text or "")) for i, r in by.items()}


def test_empty_corpus(spark, corpus, tmp_path):
    sf, _ = corpus
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_keys_keep_one_row_whatever_the_order(spark):
    rows = [(1, "b " * 20, "en", "s", 1), (1, "a " * 20, "en", "s", 2), (1, "a " * 20, "de", "s", 3), (2, "c d e f g h", "en", "s", 4), (None, "x", "en", "s", 5), (None, "x", "en", "s", 5)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long")
        kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()]
        assert sorted(kept, key=str) == sorted([rows[2], rows[3], rows[4], rows[5]], key=str)
