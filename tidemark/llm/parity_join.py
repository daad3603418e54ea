"""Operator 13: the exact Jaccard join of word n-gram sets, by parity sketches.

Sets of sizes n <= m with 100 * |A and B| >= p * |A or B| have m <= 100 n / p, and differ in at most
D = (100 - p)(n + m) / (100 + p) elements. Two XOR sketches bound that difference from below:

Segments. In a size band (sizes from 2**b to 2**(b+1) - 1, and the larger partners that these can have) every element
is hashed to one of k segments, and a segment's word is the XOR of its elements' 64-bit hashes. An element in
only one of two sets changes one segment, so at most D segments differ. As k is above D, some must agree (pigeonhole), and of a set with
more than D segments that hold elements, at least one of those. In any order of segments that all sets use,
the first D + 1 of both sets then have one in common (prefix filter); the order here takes segments of more elements first, as
those are shared by chance least. Their words are the join's keys. A set with D or fewer filled segments has them
all, and a key that marks such sets for each other.

Bits. Each element flips one bit of a sketch of 8 to 16 bits per element, whose Hamming distance is at most the number of
differing elements. Candidates farther apart than D are dropped before any text is fetched. Sketches of different
lengths are folded by XOR. No step loses a link; 64-bit words of different contents are equal with a chance of 2**-64.

Sets that are equal form a class, whose smallest key stands for it. Keys can be shared by very many sets, so the pairs of a bucket
are not enumerated. Every bucket compares its members with its smallest one (linear in the bucket), and verified links give
components. Members of different components that share a bucket are then compared: as pairs, each once, in buckets of up
to `FEW`; in larger ones as blocks of bit sketches, whose Hamming distances leave few pairs to verify. All verification is on full sets. The
number of links of each class is counted inside the components, where all links are, in blocks of bounded size by
products of incidence matrices; so a group of many near copies costs work, but no row per pair.

The key must be of an integer type. Nulls: a null text has an empty set; an empty set has no links. A row with a null key
has no links and a null component. Rows that repeat a key are one vertex; n_links counts rows. Texts of fewer words than an
n-gram have their whole sequence as their one element. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm._spark import drop, prepare, written
from tidemark.llm._text import NOT_SPACE, mix, pieces, words
from tidemark.llm.graph import components
from tidemark.llm.near_dedup import _close, _slices, _verified, shingle_sets

_SPREAD, _WORD, _BAND = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), 0x9FB21C651E98DF25
_32 = np.uint64(32)
#: Members whose pairs a bucket lists; members and elements of a block.
FEW, BLOCK, BLOCK_SHINGLES = 16, 512, 250_000


def most_different(n, m, percent: int):
    """The greatest symmetric difference of sets of sizes n and m that are similar enough."""
    return (100 - percent) * (n + m) // (100 + percent)


def bands(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, segments, D) for each band in which a set of this size meets partners."""
    out = []
    b = size.bit_length() - 1
    own = b
    while b >= 0:
        top = (2 << b) - 1
        if b < own and percent * size > 100 * top:
            break
        segments = 16 + 3 * most_different(top, 100 * top // percent, percent) // 2
        partner = 100 * size // percent if b == own else top
        out.append((b, segments, most_different(size, partner, percent)))
        b -= 1
    return out


def band_keys(elements: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of a nonempty set, as signed 64-bit integers."""
    place, word = mix(elements ^ _SPREAD) >> _32, mix(elements + _WORD)
    out = []
    for band, segments, most in bands(len(elements), percent):
        at = (place * np.uint64(segments)) >> _32
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=np.uint64(segments)))
        held = np.bitwise_xor.reduceat(word[order], first)
        if len(first) > most:
            count = np.diff(first, append=len(order))
            held = held[np.lexsort((held, -count))[: most + 1]]
        else:
            held = np.append(held, np.uint64(0))
        out.append(mix(held + np.uint64((band + 1) * _BAND % (1 << 64))))
    return np.concatenate(out).view(np.int64)


def bit_sketch(elements: np.ndarray) -> bytes:
    """The parity of the elements hashed to each bit; a power of two, at least 64 and eight times the elements, of bits."""
    n = max(64, 8 << len(elements).bit_length())
    at = (mix(elements ^ _SPREAD) & np.uint64(n - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=n).astype(np.uint8) & 1).tobytes()


def fold(sketches: np.ndarray, length: int) -> np.ndarray:
    """Sketches (n, words of 64 bits) as they would be with fewer bits."""
    while sketches.shape[1] > length:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Hamming distances of all sketches of a to all of b, at the shorter of two lengths."""
    out = np.zeros((len(a), len(b)), np.int64)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for x in np.unique(na):
        for y in np.unique(nb):
            i, j = np.flatnonzero(na == x), np.flatnonzero(nb == y)
            p, q = (np.frombuffer(b"".join(s[k] for k in at), np.uint64).reshape(len(at), -1) for s, at in ((a, i), (b, j)))
            low = min(p.shape[1], q.shape[1])
            p, q = fold(p, low), fold(q, low)
            for row, sketch in zip(i, p, strict=True):
                out[row, j] = np.bitwise_count(q ^ sketch).sum(axis=1)
    return out


def _sketched(docs: DataFrame, size: int, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(words(part.column("text"), NOT_SPACE, lower=True), size)
                keys = [band_keys(s, percent) if len(s) else np.zeros(0, np.int64) for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                bits = [bit_sketch(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(bits, pa.binary())], names=["id", "n", "digest", "keys", "bits"])

    return docs.mapInArrow(run, "id long, n long, digest binary, keys array<long>, bits binary")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose bit sketches are near enough."""
    side = lambda i: sketches.select(F.col("class").alias(i), F.col("n").alias(f"n_{i}"), F.col("bits").alias(f"bits_{i}"))
    held = pairs.join(side("b"), "b").join(side("a"), "a").where(_close(F.col("n_a"), F.col("n_b"), percent))

    def run(batches):
        for batch in batches:
            ok = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")), strict=True):
                ok.append(bool(distances([x], [y])[0, 0] <= most_different(n, m, percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return held.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _dealt(members, key: str, weight: str):
    """members with the block that each falls into, of as many as its group needs."""
    per = members.groupBy(key).agg(F.count("*").alias("_c"), F.sum(weight).alias("_s"))
    per = per.select(key, F.greatest(F.ceil(F.col("_c") / BLOCK), F.ceil(F.col("_s") / BLOCK_SHINGLES)).alias("blocks"))
    return members.join(per, key).withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))


def _crossed(blocks: DataFrame, key: str) -> DataFrame:
    """items, more: each block of a group by itself (more is null) and with each later one of the group."""
    alone = blocks.select("items", F.lit(None).cast(blocks.schema["items"].dataType).alias("more"))
    many = blocks.where("blocks > 1")
    other = many.select(key, F.col("block").alias("other"), F.col("items").alias("more"))
    return alone.unionByName(many.join(other, key).where("block < other").select("items", "more"))


def _in_buckets(members: DataFrame, labels: DataFrame, sketches: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) not in `tried` of members of one bucket in different components, near enough by their sketches."""
    named = members.join(labels.select(F.col("vertex").alias("class"), "component"), "class", "left")
    named = named.select("key", "class", "n", F.coalesce("component", "class").alias("comp"))
    hashed = [F.sum(F.xxhash64(F.lit(k), "class").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    per = named.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *hashed).where("lo <> hi")
    open_ = per.groupBy("c", "h1", "h2").agg(F.min("key").alias("key")).select("key", "c")  # one bucket of those with the same members
    open_ = named.join(written(open_, "open-buckets"), "key")
    few = open_.where(F.col("c") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("class", "n", "comp"))).alias("m"))
    few = few.select("m", F.posexplode("m").alias("i", "a")).select("a", F.explode(F.slice("m", F.col("i") + 2, FEW)).alias("b"))
    few = few.where((F.col("a.comp") != F.col("b.comp")) & _close(F.col("a.n"), F.col("b.n"), percent)).select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).distinct()
    few = _possible(written(few.join(tried, ["a", "b"], "left_anti"), "pairs"), sketches, percent)
    large = _dealt(open_.where(F.col("c") > FEW), "key", "n").join(sketches.select("class", "bits"), "class")
    blocks = written(large.groupBy("key", "block", "blocks").agg(F.collect_list(F.struct("class", "comp", "n", "bits")).alias("items")), "blocks")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one, two = (batch.column(k)[row].as_py() for k in ("items", "more"))
                sides = [[[x[c] for x in part] for c in ("class", "comp", "n", "bits")] for part in (one, two or one)]
                (ids, comps, n, bits), (ids2, comps2, n2, bits2) = sides
                n, n2 = np.array(n)[:, None], np.array(n2)[None, :]
                ok = (distances(bits, bits2) <= most_different(n, n2, percent)) & (100 * np.minimum(n, n2) >= percent * np.maximum(n, n2))
                ok &= np.array(comps)[:, None] != np.array(comps2)[None, :]
                a, b = np.nonzero(ok)
                a, b = np.array(ids, np.int64)[a], np.array(ids2, np.int64)[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    found = _crossed(blocks, "key").mapInArrow(run, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    return few.unionByName(found).distinct()


def _counted(labels: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """class and links, the rows of other classes that it is linked with, for the classes of components of two or more."""
    all_ = labels.select(F.col("vertex").alias("class"), "component").unionByName(labels.select(F.col("component").alias("class"), "component").distinct())
    members = written(all_.join(classes.groupBy("class").agg(F.sum("copies").alias("copies"), F.max("n").alias("n")), "class"), "linked")
    held = _dealt(members, "component", "n").join(texts.select(F.col("id").alias("class"), "text"), "class")
    blocks = written(held.groupBy("component", "block", "blocks").agg(F.collect_list(F.struct("class", "copies", "text")).alias("items")), "blocks")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [batch.column(k).slice(row, 1) for k in ("items", "more")]
                sides = [x.flatten().flatten() for x in sides if not x.null_count]
                sets = [s for _, _, t in sides for part in _slices(t) for s in shingle_sets(words(part, NOT_SPACE, lower=True), size)]
                ids, copies = (np.concatenate([x[k].to_numpy() for x in sides]) for k in (0, 1))
                once = list({(i, hash(s.tobytes())): k for k, (i, s) in reversed(list(enumerate(zip(ids.tolist(), sets, strict=True))))}.values())
                once.sort()  # without repeated rows
                split = sum(k < len(sides[0][0]) for k in once)
                ids, copies, sets = ids[once], copies[once], [sets[k] for k in once]
                ok = _similar(sets, percent) & (ids[:, None] != ids[None, :])
                if len(sides) == 2:  # what each block has within itself is counted where it stands alone
                    ok[:split, :split] = False
                    ok[split:, split:] = False
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ok @ copies)], names=["class", "links"])

    return _crossed(blocks, "component").mapInArrow(run, "class long, links long").groupBy("class").agg(F.sum("links").alias("links"))


def _similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are similar enough, from products of incidence matrices."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = times[column] > 1
    column = (np.cumsum(times > 1) - 1)[column[kept]]
    owner = owner[kept]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    np.fill_diagonal(both, 0)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [low, low + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[lo:hi], column[lo:hi] - low] = 1
        both += m @ m.T
    return 100 * both >= percent * (n[:, None] + n[None, :] - both)


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles, class_id (smallest key with an equal set), component_id (smallest key that
    links reach), n_links (other rows that it is linked with, copies included)."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} is not of an integer type")
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100")
    prepare(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = written(_sketched(docs, size, percent), "sketches")
    classes = rows.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("class"), F.first("n").alias("n"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    one = classes.select("digest", F.col("class").alias("id"))
    sketches = rows.join(one, ["digest", "id"]).dropDuplicates(["digest", "id"]).select(F.col("id").alias("class"), "n", "keys", "bits")
    keyed = written(sketches, "representatives")
    found = written(rows.select("id", "n", "digest"), "sizes")
    drop(rows)  # with the keys and bits of copies
    keys = keyed.select("class", F.explode("keys").alias("key"))
    centre = keys.groupBy("key").agg(F.min("class").alias("c"), F.max("class").alias("hi")).where("c <> hi").select("key", "c")
    members = written(keys.join(written(centre, "centres"), "key"), "members")
    involved = members.select("class").distinct()
    sketches = written(keyed.select("class", "n", "bits").join(involved, "class"), "bits")
    drop(keyed)
    members = members.join(sketches.select("class", "n"), "class")
    texts = written(docs.join(involved.withColumnRenamed("class", "id"), "id"), "texts")
    pairs = written(members.where("class <> c").select(F.col("c").alias("a"), F.col("class").alias("b")).distinct(), "pairs")
    links = written(_verified(written(_possible(pairs, sketches, percent), "possible"), texts, size, percent), "links")
    labels = components(links)
    more = written(_in_buckets(members.drop("c"), labels, sketches, pairs, percent), "possible")
    more = written(_verified(more, texts, size, percent), "links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionByName(more))
    drop(pairs)
    counted = written(_counted(labels, classes, texts, size, percent), "counts")

    by_class = classes.select("digest", "class", "copies").join(labels.withColumnRenamed("vertex", "class"), "class", "left").join(counted, "class", "left")
    found = found.join(by_class, "digest", "left")
    known = F.col("id").isNotNull()
    return found.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("class", "id")).alias("class_id"),
        F.when(known, F.coalesce("component", "class", "id")).alias("component_id"),
        F.when(known, F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def op13_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_join(docs).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
