"""Operator 1: token counts through a digest cache.

The cache is a Parquet table of (tokenizer, content, n_tokens), where `tokenizer` is a digest of the
tokenizer's files, options and libraries and `content` one of the normalised text. What normalisation a
tokenizer does is its own (that of this query does none), so texts are only made whole for the digest: null
becomes the empty text, and two texts share a digest when they are equal byte by byte. The table joins to the digests of
all texts; only distinct contents that it lacks are encoded, and their counts are appended to it. What
is joined and looked up is narrow; whole texts move once, for the misses, after copies within a
task have been merged, so that a text which a third of all rows hold is moved once per task.

Null counts as the empty text (0 tokens). Rows with the same or a null key are counted each. An empty
table gives an empty result. Two runs that append the same content at once do no harm: the lookup
takes one count per digest.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import exists, folder, prepare, written
from tidemark.llm._text import pieces
from tidemark.llm.byte_bpe import encode_text, encoding, safe_pieces

CACHE = "tokenizer string, content binary, n_tokens long"
#: Characters for which the splitting patterns of both libraries are known to agree (tests/llm holds the proof).
_RARE = re.compile("[^\\x00-ɏ]")


def version(path: str, ranks: str | None = None) -> str:
    """Digest of everything that a count depends on besides the text: the tokenizer's file, the rank file, the
    splitting pattern, the options, and the versions of the libraries that encode."""
    from importlib.metadata import version as installed

    h = hashlib.sha256(b"no added tokens; specials as in the file")
    for part in (f"tokenizers {installed('tokenizers')}", f"tiktoken {installed('tiktoken')} {public_tokenizers.PATTERN}" if ranks else ""):
        h.update(b"\0" + part.encode())
    for p in filter(None, (path, ranks)):
        with open(p, "rb") as f:
            h.update(b"\0" + hashlib.sha256(f.read()).digest())
    return h.hexdigest()


@functools.lru_cache(maxsize=2)
def counter(path: str, ranks: str | None):
    """A function from a text to its number of tokens.

    With a rank file of the same vocabulary, texts of common characters are counted by tiktoken, which
    gives the same counts several times faster; the special strings of the tokenizer's file are cut out
    first, as the tokenizers library does, and count one each.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    added = [t["content"] for t in conf["added_tokens"]]
    cuttable = conf["pre_tokenizer"] and conf["pre_tokenizer"]["type"] == "ByteLevel" and not conf["normalizer"]
    special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    fast = encoding(ranks, public_tokenizers.PATTERN) if ranks and cuttable else None

    def count(text: str) -> int:
        if not text:
            return 0
        if fast is None or _RARE.search(text):
            parts = [p for p, _ in safe_pieces(text)] if cuttable else [text]
            return sum(len(slow.encode(p, add_special_tokens=False)) for p in parts)
        parts = special.split(text) if special else [text]
        return len(parts) - 1 + sum(len(encode_text(fast, p)) for p in parts if p)

    return count


def count_tokens(docs: DataFrame, cache: str, path: str, ranks: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, content (digest), n_tokens. `cache` is the cache table's
    folder, partitioned by tokenizer; it is created when absent and grows by the distinct misses. What is read and
    written besides is of the size of the documents, not of the cache's."""
    spark = prepare(docs.sparkSession)
    tokenizer = version(path, ranks)
    keyed = docs.select(key, F.coalesce(text, F.lit("")).alias("_text"))
    keyed = keyed.select(key, "_text", F.octet_length("_text").cast("long").alias("n_bytes"), F.unhex(F.sha2("_text", 256)).alias("content"))

    def stored() -> DataFrame:
        known = spark.read.schema(CACHE).parquet(cache) if exists(spark, cache) else spark.createDataFrame([], CACHE)
        return known.where(F.col("tokenizer") == tokenizer)

    fresh = not exists(spark, cache)
    misses = keyed if fresh else keyed.select("content", "_text").join(stored().select("content"), "content", "left_anti")
    misses = misses.groupBy("content").agg(F.first("_text").alias("_text"))

    def run(batches):
        count = counter(path, ranks)
        for batch in batches:
            for part in pieces(batch, "_text"):
                n = [count(t) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(n, pa.int64())], names=["content", "n_tokens"])

    counted = misses.mapInArrow(run, "content binary, n_tokens long")
    counted.select(F.lit(tokenizer).alias("tokenizer"), "content", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)
    # Written, so that the join's sides come straight from their exchanges and Spark can split the rows of a
    # text that very many documents hold.
    known = stored()
    if not fresh:  # of a cache that others have filled, only what these documents hold
        known = known.join(keyed.select("content").distinct(), "content", "left_semi")
    counts = written(known.groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keyed.drop("_text").join(counts, "content", "left").select(key, "n_bytes", "content", "n_tokens")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    # The cache is this call's own, so that the query always does the whole job.
    out = count_tokens(docs, folder(spark, "token-cache"), path, ranks)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
