import base64
import gzip
import hashlib
import io
import random

import pytest

from brute import decontaminate
from tidemark.llm import decontaminate as op8
from tidemark.llm import warc

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "v", "ü" * 300000), (None, "n", "only"), (None, "n", "<p>x</p>"), (2, "again", "<p>x</p>")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, sha1 string")


def test_round_trip(spark, pages, tmp_path):
    to = (tmp_path / "w").as_uri()
    archives = warc.write_archives(pages, to, archive_bytes=2000)
    rows = warc.read_archives(archives, to, payloads=True).collect()
    assert len(rows) == len(PAGES) and all(r.digest_ok for r in rows)
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    latest = {}
    for i, _, h in PAGES:
        latest[digest(h)] = max(latest.get(digest(h), -1), -1 if i is None else i)
    want = sorted((-1 if i is None else i, len((h or "").encode()), digest(h), latest[digest(h)] if latest[digest(h)] not in (i, -1) else -1) for i, _, h in PAGES)
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.refers_to or -1) for r in rows) == want
    assert all((r.record_type == "revisit") == (r.refers_to is not None) == (r.payload == b"" and r.payload_bytes > 0) for r in rows if r.payload_bytes)
    for a in archives.collect():  # any gzip reader sees the whole archive
        assert gzip.open(a.path).read().count(b"WARC/1.1\r\n") == a.records


def test_damage_is_an_error():
    good = warc.gzip_member(warc.record(1, "u", b"body", 4, base64.b32encode(hashlib.sha1(b"body").digest()).decode(), None, "d"))
    assert [r["digest_ok"] for r in warc.read_archive(io.BytesIO(good * 3), block=7)] == [True] * 3
    bad = warc.gzip_member(warc.record(1, "u", b"bodx", 4, base64.b32encode(hashlib.sha1(b"body").digest()).decode(), None, "d"))
    assert [r["digest_ok"] for r in warc.read_archive(io.BytesIO(bad))] == [False]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(good[:-20])))
    longer = warc.gzip_member(gzip.decompress(good) + b"x")
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(longer)))


def test_archives_of_others():
    """Records of other kinds, ids and spellings; no digest, no HTTP length, a folded line."""
    body = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nhello"

    def member(kind, more, content):
        return warc.gzip_member(f"WARC/1.0\r\nwarc-type: {kind}\r\n{more}content-length:{len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n")

    data = member("warcinfo", "", b"software: x\r\n") + member("request", "", b"GET / HTTP/1.0\r\n\r\n")
    data += member("response", "WARC-Record-ID: <urn:uuid:0a>\r\nWARC-Target-URI:\r\n http://a/\r\n", body) + member("metadata", "", b"") + member("revisit", "WARC-Payload-Digest: sha1:AB\r\n", b"")
    rows = list(warc.read_archive(io.BytesIO(data), block=11, payloads=True))
    assert [(r["record_type"], r["page_id"], r["digest_ok"], r["payload"]) for r in rows] == [("response", None, None, b"hello"), ("revisit", None, True, b"")]
    assert rows[0]["url"] == "http://a/" and rows[0]["payload_digest"] == base64.b32encode(hashlib.sha1(b"hello").digest()).decode() and rows[1]["payload_digest"] == "AB"
    with pytest.raises(ValueError):
        warc._reached("viewfs://store/x")
    assert warc._reached("s3a://b/x") == "s3://b/x" and warc._reached("file:/tmp/x") == "file:/tmp/x"


def test_no_pages(spark, pages, tmp_path):
    to = (tmp_path / "w").as_uri()
    assert warc.read_archives(warc.write_archives(pages.limit(0), to), to).count() == 0


def _case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "C", "dé", "e1", "F-g"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14])))) for i in range(12)] + [(3, None), (None, "zz yy")]
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 5, 30, 200])))) for i in range(30)]
    docs += [(100, items[8][1].upper() + " x"), (101, "pre " + (items[9][1] or "") + ", post"), (102, None), (103, "zz, yy!")]
    return docs, items


@pytest.mark.parametrize("blocks", [1 << 20, 250])
def test_decontamination_equals_brute_force(spark, blocks):
    for seed in range(2):
        docs, items = _case(seed)
        d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, items string")
        b = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, id string")
        import pyspark.sql.functions as F

        rows = op8.contamination(d, b, size=10, block_bytes=blocks).select("*", F.sha2(F.array_join("items", ","), 256).alias("sha")).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), r.sha, r.n_hit > 0) for r in rows} == decontaminate(docs, items)


def test_blocks_with_one_id_over_several_texts(spark):
    """One id, and a null id, whose texts fall into different blocks: every block's hit words count."""
    texts = [" ".join(f"{n}{k}" for k in range(12)) for n in ("a", "b", "c", "d", "e", "f")]
    items = [(7, t) for t in texts] + [(None, t.replace("1", "x")) for t in texts] + [(8, texts[0]), (8, texts[3] + " more")]
    docs = [(i, f" pad{i} ".join(texts[: i + 1])) for i in range(6)] + [(10 + i, " - ".join(t.replace("1", "x") for t in texts[i:])) for i in range(6)]
    docs += [(20, " ".join(t + " " + t.replace("1", "x") for t in texts)), (21, texts[1] + " " + texts[1]), (22, "none")]
    d = spark.createDataFrame(docs + docs[:3], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate(docs, items)
    got = {}
    for blocks in (1 << 20, 250, 60):
        rows = op8.contamination(d, b, size=10, block_bytes=blocks).collect()
        assert len(rows) == len(docs) + 3
        assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in rows} == {i: w[:3] for i, w in want.items()}
        assert all(r.n_hit == sum(y - x for x, y in r.hit_ranges) for r in rows)
        got[blocks] = sorted((r.doc_id, [tuple(x) for x in r.hit_ranges], list(r["items"])) for r in rows)
    assert got[1 << 20] == got[250] == got[60]


def test_decontamination_of_and_by_nothing(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [r.n_hit for r in op8.contamination(d, b.limit(0)).collect()] == [0, 0, 0]
    assert [r.n_hit for r in op8.contamination(d, b).collect()] == [1, 1, 1]
    assert op8.contamination(d.limit(0), b).count() == 0
