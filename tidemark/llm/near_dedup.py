"""Operator 4: near-duplicate detection with fast similarity sketches, banding and exact verification.

A text's set holds the hashes of its distinct word shingles. Texts of equal sets form a class, whose
smallest key stands for it. The sketch has T coordinates, filled by rounds of hashed bin placement
(Dahlgaard, Knudsen, Thorup: Fast similarity sketching, 2017): in round i < T each element falls into
a bin drawn by hash i and offers it the value (i, hash); in rounds T to 2T - 1 each element goes to the
bin i - T, so that every coordinate fills whatever the size of the set; a coordinate keeps its least
value, and work stops when all are filled. Two coordinates agree with a probability equal to the
Jaccard similarity, and their number is as concentrated as for independent samples.

Bands of R coordinates become bucket keys. With 48 bands of 6, a pair of similarity 0.8 shares no bucket
with a probability of 5e-7. Buckets can be huge (a passage or template that millions of texts share),
so pairs within them are not enumerated. Every bucket checks its members against its smallest one (a
star, linear in the bucket), exactly, on full sets; verified links give components, and members of a
bucket that are in one component need no further comparison, as it could add nothing. What remains are
members of different components in one bucket; of buckets with the same members one is enough. In buckets of
up to `FEW` members they become pairs, each pair once for all its buckets, without those of sizes too
different and those looked at before. In larger ones they are compared exactly and completely, but in
blocks of bounded size instead of pairs of rows: the members of a bucket's largest component against the
others, and the others among each other, each pair of blocks by one product of incidence matrices, which
returns one link at most for two components. So no pair that shares a bucket and could join two
components stays unverified, whatever its bucket's size. Aggregates are written before they are joined, so
that Spark can split a key that very many rows share.

The key must be of an integer type. Nulls: a null text has an empty set; an empty set has no links. A row with a null key has no links, a
null component, and is kept. Rows that share a key are one vertex; repeated rows get one result each.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm._spark import prepare, written
from tidemark.llm._text import NOT_SPACE, Words, mix, pieces, windows, words
from tidemark.llm.graph import components

BANDS, ROWS = 48, 6
T = BANDS * ROWS
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = np.random.Generator(np.random.PCG64(171704807)).integers(0, 1 << 63, 2 * T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.random.Generator(np.random.PCG64(71)).integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 4096
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The T coordinates of a nonempty set of 64-bit hashes."""
    out = np.full(T, _EMPTY)
    i, n = 0, len(elements)
    while i < T:
        rounds = min(T - i, max(1, _STEP // n))
        x = mix(elements[None, :] ^ _SEEDS[i : i + rounds, None])
        at = ((x >> _32) * np.uint64(T)) >> _32
        x &= _LOW
        x |= (np.arange(i, i + rounds, dtype=np.uint64) << _32)[:, None]
        np.minimum.at(out, at.ravel().astype(np.intp), x.ravel())
        i += rounds
        if (out != _EMPTY).all():
            return out
    for j in np.flatnonzero(out == _EMPTY).tolist():
        out[j] = (np.uint64(T + j) << _32) | (mix(elements ^ _SEEDS[T + j]) & _LOW).min()
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """Keys of the bands of some sketches (n, T), as signed 64-bit integers (n, BANDS)."""
    k = (sketches.reshape(-1, BANDS, ROWS) * _ODD).sum(axis=2, dtype=np.uint64)
    return mix(k + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words has its whole sequence as one."""
    full = windows(w.hash, size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            out.append(mix(windows(w.hash[a:b], b - a)[:1] ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketched(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                sets = shingle_sets(words(part.column(text), NOT_SPACE, lower=True), size)
                some = [i for i, s in enumerate(sets) if len(s)]
                bands = np.zeros((0, BANDS), np.int64)
                if some:
                    bands = band_keys(np.stack([sketch(sets[i]) for i in some]))
                filled = np.zeros(len(sets), np.int64)
                filled[some] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled)]), pa.int32()), pa.array(bands.ravel()))
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), lists], names=["id", "n", "digest", "bands"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "id long, n long, digest binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those with 100 * |A and B| >= percent * |A or B|. a may be in many pairs."""
    held = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches):
        for batch in batches:
            for half in pieces(batch, "ta", 4 << 20):
                for part in pieces(half, "tb", 4 << 20):
                    sets = []
                    for i, t in (("a", "ta"), ("b", "tb")):
                        ids = part.column(i).to_numpy()
                        _, first, back = np.unique(ids, return_index=True, return_inverse=True)
                        if part.num_rows > 1 and len(first) < part.num_rows:
                            # rows of one key may still differ in text
                            same = part.column(t).take(pa.array(first[back])).equals(part.column(t))
                            if not same:
                                first = back = np.arange(part.num_rows)
                        one = shingle_sets(words(part.column(t).take(pa.array(first)), NOT_SPACE, lower=True), size)
                        sets.append([one[k] for k in back])
                    ok = []
                    for x, y in zip(*sets, strict=True):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        ok.append(100 * both >= percent * (len(x) + len(y) - both))
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return held.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Linked members of different components, one pair for two components."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # columns for those that two members have
    kept = times[place] > 1
    owner, column = owner[kept], shared[place[kept]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(shared[-1]) + 1 if len(shared) else 0, 4096):
        lo, hi = np.searchsorted(column, [low, low + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[lo:hi], column[lo:hi] - low] = 1
        both += m @ m.T
    ok = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (comps[:, None] < comps[None, :])
    a, b = np.nonzero(ok)
    if not len(a):
        return [], []
    _, first = np.unique(np.stack([comps[a], comps[b]]), axis=1, return_index=True)
    return ids[a[first]].tolist(), ids[b[first]].tolist()


#: Members and shingles of a block; members of a bucket whose pairs are listed.
BLOCK, BLOCK_SHINGLES, FEW = 256, 100_000, 16


def _close(n, m, percent: int):
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _between(members: DataFrame, labels: DataFrame, texts: DataFrame, tried: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between members of one bucket that are in different components. `tried` are pairs (a, b), a < b, that
    have been verified."""
    named = members.join(labels.select(F.col("vertex").alias("class"), "component"), "class", "left")
    named = named.select("key", "class", "n", F.coalesce("component", "class").alias("comp"))
    per = named.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64(F.lit(1), "class").cast("decimal(38,0)")).alias("y"))
    top = per.groupBy("key").agg(F.max(F.struct("c", "s", "comp")).alias("top"), F.sum("c").alias("all_c"), F.sum("s").alias("all_s"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("comps")).where("comps > 1")
    top = top.groupBy("all_c", "x", "y").agg(F.min(F.struct("key", "top", "all_s")).alias("one")).select("one.*", "all_c")  # x, y: who is in it
    top = written(top, "open-buckets")
    open_ = named.join(top, "key")
    few = open_.where(F.col("all_c") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("class", "n", "comp"))).alias("m"))
    few = few.select("m", F.posexplode("m").alias("i", "a")).select("a", F.explode(F.slice("m", F.col("i") + 2, FEW)).alias("b"))
    few = few.where((F.col("a.comp") != F.col("b.comp")) & _close(F.col("a.n"), F.col("b.n"), percent)).select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).distinct()
    few = written(few.join(tried, ["a", "b"], "left_anti"), "pairs")
    links = written(_verified(few, texts, size, percent), "links")
    open_ = open_.where(F.col("all_c") > FEW)
    parts = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES))
    whole = parts(F.col("all_c"), F.col("all_s")) <= 1
    major = F.col("comp") == F.col("top.comp")
    turns = F.when(major, parts(F.col("top.c"), F.col("top.s"))).otherwise(parts(F.col("all_c") - F.col("top.c"), F.col("all_s") - F.col("top.s")))
    side = F.when(whole, 0).when(major, 1).otherwise(2)
    block = F.when(whole, F.lit(0)).otherwise(F.pmod(F.xxhash64("class"), F.greatest(turns, F.lit(1))))
    open_ = open_.select("key", "class", "comp", side.alias("side"), block.cast("long").alias("block"))
    held = open_.join(texts.select(F.col("id").alias("class"), "text"), "class")
    blocks = held.groupBy("key", "side", "block").agg(F.collect_list(F.struct("class", "comp", "text")).alias("items"))
    blocks = written(blocks, "blocks")
    a = blocks.where("side > 0")
    b = blocks.where("side = 2").select("key", F.col("block").alias("other"), F.col("items").alias("more"))
    crossed = a.join(b, "key").where("side = 1 or block <= other").select("items", F.when((F.col("side") == 1) | (F.col("block") != F.col("other")), F.col("more")).alias("more"))
    todo = blocks.where("side = 0").select("items", F.lit(None).cast(blocks.schema["items"].dataType).alias("more")).unionByName(crossed)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                both = [x for x in (batch.column(k).slice(i, 1) for k in ("items", "more")) if not x.null_count]
                rows = pa.concat_arrays([x.flatten() for x in both])
                ids, comps, found = rows.flatten()
                sets = [s for t in _slices(found) for s in shingle_sets(words(t, NOT_SPACE, lower=True), size)]
                x, y = _links(ids.to_numpy(), comps.to_numpy(), sets, percent)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return links.unionByName(todo.mapInArrow(run, "a long, b long"))


def _slices(texts: pa.Array):
    for part in pieces(pa.RecordBatch.from_arrays([texts], names=["t"]), "t"):
        yield part.column("t")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles, class_id (smallest key with an equal set), component_id
    (smallest key that links reach), kept (the key is its component's)."""
    prepare(docs.sparkSession)
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} is not of an integer type")
    rows = written(_sketched(docs, key, text, size), "sketches")
    classes = rows.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("class"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    keys = classes.select("class", "n", F.explode("bands").alias("key"))
    centre = keys.groupBy("key").agg(F.min(F.struct("class", "n")).alias("c"), F.max("class").alias("hi")).where("c.class <> hi").select("key", "c")
    centre = written(centre, "centres")
    members = written(keys.join(centre, "key"), "members")
    involved = members.select(F.col("class").alias("id")).distinct()
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(involved, "id")
    texts = written(texts, "texts")
    pairs = members.where((F.col("class") != F.col("c.class")) & _close(F.col("n"), F.col("c.n"), percent))
    pairs = written(pairs.select(F.col("c.class").alias("a"), F.col("class").alias("b")).distinct(), "pairs")
    links = written(_verified(pairs, texts, size, percent), "links")
    labels = components(links)
    more = written(_between(members.drop("c"), labels, texts, pairs, size, percent), "links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionByName(more))

    by_class = classes.select("digest", "class")
    by_class = by_class.join(labels.withColumnRenamed("vertex", "class"), "class", "left")
    found = rows.select("id", "n", "digest").join(by_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "class", "id"))
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class_id"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, size=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
