import hashlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import byte_bpe, token_counts

TEXTS = ["", None, "a", "It's  a test\n\n  of 'll it ", "<|endoftext|>x<|endoftext|>", "ünïcödé 漢字 🙂 ñ", "word " * 40000, "x" * 3000, " \t\n ", "it's" * 20000]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(2, "a", "clash"), (None, "a", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def reference_ids(text):
    return byte_bpe.encoding(RANKS, public_tokenizers.PATTERN).encode_ordinary(text or "")


def library_count(text):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(JSON).encode(text or "", add_special_tokens=False))


def test_encode_equals_library_and_round_trips(docs):
    rows = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "a" if r.doc_id is None else TEXTS[r.doc_id]
        assert bytes(r.ids_le) == np.array(reference_ids(text), "<u4").tobytes()
        assert bytes(r.decoded) == (text or "").encode()


def test_decode_is_the_inverse(docs):
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=False), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in got.collect() if r.doc_id is not None} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_decode_joins_raw_bytes(spark):
    enc = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    ids = [i for i in enc.encode_ordinary("🙂") for _ in (0, 1)][:3]
    df = spark.createDataFrame([(0, bytearray(np.array(ids, "<u4").tobytes())), (1, None)], "doc_id long, ids_le binary")
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(df, RANKS, public_tokenizers.PATTERN).collect()} == {0: enc.decode_bytes(ids), 1: b""}


def test_a_large_cache_is_not_rewritten(spark, docs, tmp_path, monkeypatch):
    cache, seen = str(tmp_path / "cache"), []
    keep = token_counts.written
    monkeypatch.setattr(token_counts, "written", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    many = spark.range(3000).selectExpr("id AS doc_id", "'text number ' || id AS text")
    assert token_counts.count_tokens(many, cache, JSON, RANKS).count() == 3000 and seen[-1].count() == 3000
    few = spark.createDataFrame([(1, "text number 7"), (2, "text number 7"), (3, "not seen yet"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(few, cache, JSON, RANKS).collect()}
    assert got == {1: library_count("text number 7"), 2: library_count("text number 7"), 3: library_count("not seen yet"), 4: 0}
    assert seen[-1].count() == 3 and spark.read.parquet(cache).count() == 3002
    parts = {p.name.split("=")[0] for p in (tmp_path / "cache").iterdir() if p.is_dir()}
    assert parts == {"tokenizer"}


def test_counts_and_cache(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    for _ in range(2):
        rows = token_counts.count_tokens(docs, cache, JSON, RANKS).collect()
        assert len(rows) == len(TEXTS) + 2
        for r in rows:
            text = "a" if r.doc_id is None else TEXTS[r.doc_id]
            assert (r.n_bytes, r.n_tokens) == (len((text or "").encode()), library_count(text))
        stored = spark.read.parquet(cache)
        assert stored.count() == len({t or "" for t in TEXTS})  # nothing is encoded twice
    more = docs.unionByName(spark.createDataFrame([(99, "brand new", "")], docs.schema))
    assert token_counts.count_tokens(more, cache, JSON, RANKS).where("doc_id = 99").first().n_tokens == library_count("brand new")
    assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS}) + 1


def test_counts_without_rank_file(docs, tmp_path):
    rows = token_counts.count_tokens(docs, str(tmp_path / "c"), JSON).where("doc_id is not null").collect()
    assert all(r.n_tokens == library_count(TEXTS[r.doc_id]) for r in rows)


def test_both_libraries_split_common_characters_alike():
    count = token_counts.counter(JSON, RANKS)
    chars = [chr(c) for c in range(0x250)]
    texts = ["".join(chars)] + [f"a{c}{c} {c}b1{c}'s {c} {c}" for c in chars]
    assert [count(t) for t in texts] == [library_count(t) for t in texts]
    rare = [f"a{chr(c)} {chr(c)}1" for c in (0x85, 0x1680, 0x180E, 0x2000, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x1F600)]
    assert [count(t) for t in rare] == [library_count(t) for t in rare]


def test_empty_table(spark, docs, tmp_path):
    none = docs.limit(0)
    assert byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(none, str(tmp_path / "c"), JSON, RANKS).count() == 0


def _as_library(text):
    """Ids by the library, a long run of white space by itself: the library's own splitting fails at a million."""
    enc = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    out, at, regex = [], 0, __import__("regex")
    for m in regex.finditer(public_tokenizers.PATTERN, text):
        assert m.start() == at
        at = m.end()
        out += enc._core_bpe.encode_single_piece(m[0].encode())
    assert at == len(text)
    return out


BLANK = {"blanks": " ", "lines": "\n", "mixed": " \n\t\u3000 \r", "letters": "x", "cjk": "漢字語", "marks": "!?"}


@pytest.mark.parametrize("kind", BLANK)
def test_very_long_runs(kind):
    enc = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    count = token_counts.counter(JSON, RANKS)
    unit = BLANK[kind]
    for n in (2_000_000, byte_bpe.LONG, byte_bpe.LONG - 1):
        run = (unit * (n // len(unit) + 1))[:n]
        for text in (run, "a" + run, run + "a", "a b" + run + " b" + run + "c d", run + "漢"):
            ids = byte_bpe.encode_text(enc, text)
            assert enc.decode_bytes(ids.tolist()) == text.encode()
            if n < 100_000:
                assert ids.tolist() == _as_library(text) == enc.encode_ordinary(text)
                assert count(text) == library_count(text) == len(ids)
            else:
                assert ids.tolist() == _as_library(text)
                assert count(text) == len(ids)


def test_digest_covers_everything(tmp_path, monkeypatch):
    other = tmp_path / "other.tiktoken"
    other.write_bytes(open(RANKS, "rb").read() + b"\n")
    digests = {token_counts.version(JSON), token_counts.version(JSON, RANKS), token_counts.version(JSON, str(other))}
    monkeypatch.setattr(public_tokenizers, "PATTERN", ".")
    digests.add(token_counts.version(JSON, RANKS))
    assert len(digests) == 4


def test_safe_pieces_join_back():
    text = "ab cd\n ef" * 30000
    parts = [p for p, _ in byte_bpe.safe_pieces(text, 1000)]
    assert "".join(parts) == text and len(parts) > 100
    assert hashlib.sha256(repr([i for p in parts for i in reference_ids(p)]).encode()).digest() == hashlib.sha256(repr(reference_ids(text)).encode()).digest()
