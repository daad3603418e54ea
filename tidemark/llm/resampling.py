"""Operator 11: importance resampling towards a target distribution of hashed n-grams.

Word-id suffix arrays: a task numbers the words of a block of texts (2 MB, or one longer text alone) and sorts the block's
positions by the words that follow, by prefix doubling up to the longest n-gram asked for; a suffix ends with its text.
Neighbours in that order have a longest common prefix (LCP, up to that length), and where it reaches n, neighbours hold the same
n-gram: such LCP runs enumerate the block's different n-grams, repeated or not. Each run's n-gram is hashed once (crc32 of
its words joined by one space, modulo the buckets), and the bucket ids are scattered back to all its occurrences, so
that each text ends with the bucket of every one of its features, repeats counted.

These are written once. Counts of buckets over all documents and over the target are Spark aggregates with map-side
combining; the gains, one integer per bucket and so of fixed size, go to the tasks that sum them by document. The draw
is a Gumbel top-k: documents long enough are range-partitioned by (score descending, key) and written, and a rank is
the place in a partition plus the sizes of those before it, so that no task orders more than its share and
equal scores cannot gather in one.

A null text has no words. Texts without features weigh 0; texts of fewer words than an n-gram have none of that size.
Empty documents, an empty target or both are counted as 0 (the smoothing keeps gains finite). A row with a null key has
score and rank null and is not drawn. Rows that repeat a key are rows of their own: each counts, and may be drawn, at
neighbouring ranks. Ties go to the smaller key. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm._spark import drop, prepare, written
from tidemark.llm._text import ALNUM, LOWER, Words, pieces, words


def suffix_order(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the words from there on, up to `depth` of them and the text's end. `left` is how many
    words of its text begin with each. Equal suffixes stay in text order."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    known = 1
    order = np.argsort(rank, kind="stable")
    while known < depth and n:
        after = np.zeros(n, np.int64)  # 0: the text is over
        more = np.flatnonzero(left > known)
        after[more] = rank[more + known]
        order = np.lexsort((after, rank))
        new = (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[1], np.cumsum(new) + 1])
        known *= 2
    return order


def common_prefixes(ids: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the order but the first, how many words it shares with the one before, up to `depth`."""
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for k in range(depth):
        x, y = a[alive], b[alive]
        alive = alive[(left[x] > k) & (left[y] > k)]
        x, y = a[alive] + k, b[alive] + k
        alive = alive[ids[x] == ids[y]]
        lcp[alive] = k + 1
    return lcp


def feature_buckets(w: Words, least: int, most: int, buckets: int) -> list[np.ndarray]:
    """For n from `least` to `most`: the bucket of the n-gram that begins at each word, -1 where its text ends before."""
    left = w.left()
    ids = np.unique(w.hash, return_inverse=True)[1]
    order = suffix_order(ids, left, most)
    lcp = common_prefixes(ids, left, order, most)
    data = LOWER[w.data]
    out = []
    for n in range(least, most + 1):
        at = np.full(len(ids), -1, np.int32)
        full = left[order] >= n
        begins = full.copy()
        begins[1:] &= lcp < n  # a run's first occurrence
        run = np.cumsum(begins) - 1
        heads = order[begins]
        hashed = np.empty(len(heads), np.int32)
        start, end = w.start[heads], w.end[heads + n - 1]
        for k, (p, a, b) in enumerate(zip(heads.tolist(), start.tolist(), end.tolist(), strict=True)):
            gram = data[a:b] if n == 1 else b" ".join(data[w.start[i] : w.end[i]].tobytes() for i in range(p, p + n))
            hashed[k] = zlib.crc32(gram) % buckets
        at[order[full]] = hashed[run[full]]
        out.append(at)
    return out


def features(docs: DataFrame, key: str, text: str, least: int, most: int, buckets: int) -> DataFrame:
    """id, n_words and the bucket of every feature of each text."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words(part.column("text"), ALNUM, lower=True)
                flat = np.stack(feature_buckets(w, least, most, buckets), axis=1)
                owner = w.owner().repeat(flat.shape[1])
                flat = flat.ravel()
                ok = flat >= 0
                n = np.bincount(owner[ok], minlength=part.num_rows)
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int64()), pa.array(flat[ok], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(w.counts, pa.int64()), lists.cast(pa.list_(pa.int32()))], names=["id", "n_words", "found"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n_words long, found array<int>")


def counts(found: DataFrame) -> DataFrame:
    return found.select(F.explode("found").alias("bucket")).groupBy("bucket").count()


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln of the ratio of the target's smoothed share to the documents') of every bucket."""
    both = counts(target).withColumnRenamed("count", "t").join(counts(documents).withColumnRenamed("count", "s"), "bucket", "full")
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both.collect():  # a row per bucket at most
        s[r.bucket], t[r.bucket] = r.s or 0, r.t or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features and weight, the sum of the gains of a document's features."""

    def run(batches):
        for batch in batches:
            lists = batch.column("found")
            total = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            off = lists.offsets.to_numpy() - lists.offsets[0].as_py() if batch.num_rows else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(np.diff(off), pa.int64()), pa.array(np.diff(total[off]), pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 times a standard Gumbel draw that the seed and the key fix)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def drawn(scored: DataFrame, take: int, share: int) -> DataFrame:
    """rank 1, 2, 3, ... of the first floor(take * rows / share) rows by falling score and rising id; null for the others."""
    spark = scored.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = scored.repartitionByRange(n, F.desc("score"), "id").sortWithinPartitions(F.desc("score"), "id")
    place = F.monotonically_increasing_id()
    ordered = written(ordered.withColumn("_part", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND((1 << 33) - 1)), "ordered")
    before, sizes = 0, {}
    for r in ordered.groupBy("_part").count().orderBy("_part").collect():  # a row per partition
        sizes[r["_part"]] = before
        before += r["count"]
    offsets = spark.createDataFrame(list(sizes.items()), "_part long, _before long")
    rank = F.col("_place") + F.col("_before") + 1
    return ordered.join(F.broadcast(offsets), "_part", "left").withColumn("rank", F.when(rank <= take * before // share, rank)).drop("_part", "_place", "_before")


def importance_resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", least: int = 1, most: int = 2, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """One row per document: the key, n_features, weight, score and rank (null where not drawn)."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} is not of an integer type")
    found = written(features(docs, key, text, least, most, buckets), "features")
    wanted = written(features(target.withColumn("_no_key", F.lit(0)), "_no_key", target_text, least, most, buckets), "features")
    gain = gains(found, wanted, buckets)
    scored = weights(found, gain).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = written(scored, "scored")
    drop(found, wanted)
    fit = (F.col("n_words") >= min_words) & F.col("id").isNotNull()
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    out = drawn(scored.where(fit), percent, 100).unionByName(rest)
    return out.select(F.col("id").alias(key), "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance_resample(docs, bench, least=1, most=1)


OP11_SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), dw AS (
  SELECT doc_id, unnest(words) AS word FROM d
), vocab AS (
  SELECT word FROM (SELECT word FROM dw UNION SELECT word FROM b)
), hexed AS (
  SELECT word, hex(encode(word)) AS h FROM vocab
), bytes AS (
  SELECT word, list_transform(range(length(h) // 2), lambda k: 16 * (strpos('0123456789ABCDEF', substr(h, CAST(2 * k + 1 AS BIGINT), 1)) - 1) + strpos('0123456789ABCDEF', substr(h, CAST(2 * k + 2 AS BIGINT), 1)) - 1) AS bs FROM hexed
), crc AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, bs), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab
), sc AS (
  SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY bucket
), tc AS (
  SELECT bucket, count(*) AS t FROM b JOIN crc USING (word) GROUP BY bucket
), totals AS (
  SELECT coalesce((SELECT sum(s) FROM sc), 0) AS ss, coalesce((SELECT sum(t) FROM tc), 0) AS tt
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM sc FULL JOIN tc USING (bucket), totals
), weighed AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(w.weight, 0) AS BIGINT) AS weight
  FROM d LEFT JOIN (SELECT doc_id, sum(gain) AS weight FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY doc_id) w ON w.doc_id = d.doc_id
), hashed AS (
  SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda k: strpos('0123456789abcdef', substr(sha256('2024:' || doc_id), k, 1)) - 1)), lambda a, x: 16 * a + x) AS h FROM weighed
), scored AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM hashed
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked ON ranked.doc_id = scored.doc_id
"""
