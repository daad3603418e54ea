"""Operator 3: byte-level BPE encoding and decoding with a local rank file.

Texts are encoded by the tiktoken library inside Arrow batches, without a shuffle. A long text is cut
first at places where a match of the splitting pattern must end whatever follows - between a visible
ASCII character and white space - so that pieces of bounded size give the ids of the whole text. A long run
of white space is one match of the pattern up to its last character (or all of it, at the end of a text) and is
encoded as such, as the library's own splitting fails at a million blanks.
Decoding looks the ids' bytes up and joins them as raw bytes; no assumption is made that a run of ids
is valid UTF-8.

Null and empty texts give no ids and empty bytes. Rows are independent, so repeated rows, ties and
null keys pass through; an empty table gives an empty result. Columns of the input other than the key
and the text are not read.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._spark import prepare
from tidemark.llm._text import pieces

LONG = 1 << 16
_SAFE = re.compile(r"(?<=[!-~])(?=[ \t\n\r])")
#: White space as the pattern's \s has it, in runs that are matches of their own.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)


def _between(text: str, at: int, end: int, size: int) -> Iterator[str]:
    """Cut text[at:end] after at least `size` characters, where a match of the pattern must end."""
    while end - at > size:
        m = _SAFE.search(text, at + size, end)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    if at < end:
        yield text[at:end]


def safe_pieces(text: str, size: int = LONG) -> Iterator[tuple[str, bool]]:
    """Pieces of the text that can be encoded by themselves, and whether one is a single match of the pattern."""
    at = 0
    for m in _RUN.finditer(text) if len(text) >= LONG else ():
        yield from ((p, False) for p in _between(text, at, m.start(), size))
        at = m.end() - (m.end() < len(text))
        yield text[m.start() : at], True
    yield from ((p, False) for p in _between(text, at, len(text), size))


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _undivided(enc):
    """The same ranks with a pattern that takes a text as one match."""
    import tiktoken

    return tiktoken.Encoding("undivided", pat_str=r"[\s\S]+", mergeable_ranks=enc._mergeable_ranks, special_tokens={})


def encode_text(enc, text: str) -> np.ndarray:
    got = [(_undivided(enc) if single else enc).encode_to_numpy(p, allowed_special=set(), disallowed_special=()) for p, single in safe_pieces(text)]
    return got[0] if len(got) == 1 else np.concatenate(got) if got else np.zeros(0, np.uint32)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = True, columns: list[str] | None = None) -> DataFrame:
    """One row per document: the key (or the given columns), n_tokens, ids_le (the ids as little-endian unsigned 32-bit
    integers), and with `decoded` the bytes that decoding these ids gives back."""
    prepare(docs.sparkSession)
    columns = columns or [key]
    fields = [*(docs.schema[c] for c in columns), T.StructField("n_tokens", T.LongType()), T.StructField("ids_le", T.BinaryType())]
    schema = T.StructType(fields + [T.StructField("decoded", T.BinaryType())] * decoded)

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            for part in pieces(batch, text, 2 << 20):
                ids = [encode_text(enc, t or "") for t in part.column(text).to_pylist()]
                out = [*(part.column(c) for c in columns), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if decoded:
                    out.append(pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids_le") -> DataFrame:
    """One row per row of tokens: the key and the bytes that its little-endian 32-bit ids stand for.
    A null or empty list of ids gives empty bytes; an id outside the ranks is an error."""
    prepare(tokens.sparkSession)
    schema = T.StructType([tokens.schema[key], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            got = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(got, pa.binary())], names=schema.names)

    return tokens.select(key, ids).mapInArrow(run, schema)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
