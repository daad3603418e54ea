"""Operator 8: benchmark decontamination by a prefix-filtered set join.

Benchmark items become windows of `size` consecutive words (a shorter item is one window). A document
contains a window when all the window's shingles (three words; fewer for shorter windows) stand in it
in place, so containment has threshold 1 and the necessary prefix of a window, its shingles ordered by
rarity in the corpus, is the one rarest shingle. The join takes document shingles to prefix shingles,
keeps those that the bounds allow (the window would start and end inside the document), and then
compares the words of the window one by one.

Rarity is counted over all documents, for the benchmark's own shingles only. A benchmark of up to
`block_bytes` of text goes to all tasks with its tables (some thirty times as large), and documents are not
shuffled. A larger one stays a table: a bitmap of its shingles of at most 16 MB goes to the tasks, which let
through those shingles of documents that it may hold, with the words around them; they are counted, and
joined to the prefixes by shingle; bounds and words are checked in the join's own row. Both ways give the
same rows.

Words are compared by 64-bit hashes, a window by all its hashes. Null and empty texts have no words.
Items without words match nothing; equal items are all reported; items with a null id are left out of
the list of ids but their words count as hit. Repeated rows are judged each. Either table may be empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._spark import prepare, written
from tidemark.llm._text import ALNUM, Members, pieces, windows, words

SHINGLE = 3


class Windows:
    """The windows of some benchmark items: item, length, word hashes, shingle hashes by place."""

    def __init__(self, texts: list[str | None], size: int):
        w = words(pa.array(texts, pa.string()), ALNUM, lower=True)
        n, left = w.counts, w.left()
        length = np.minimum(np.repeat(n, n), size)
        self.start = np.flatnonzero(left >= length)
        self.item, self.length = w.owner()[self.start], length[self.start]
        padded = np.concatenate([w.hash, np.zeros(size, np.uint64)])
        self.words = padded[self.start[:, None] + np.arange(size)]
        self.q = np.minimum(self.length, SHINGLE)
        by_q = {q: windows(padded, q) for q in set(self.q.tolist())}
        self.shingles = np.zeros((len(self.start), size), dtype=np.uint64)
        for q, h in by_q.items():
            rows = self.q == q
            self.shingles[rows] = h[self.start[rows][:, None] + np.arange(size)]
        #: Shingles that lie in the window.
        self.inside = np.arange(size) <= (self.length - self.q)[:, None]

    def sets(self) -> dict[int, np.ndarray]:
        return {int(q): np.unique(self.shingles[self.q == q][self.inside[self.q == q]]) for q in np.unique(self.q)}


def _frequencies(docs: DataFrame, text: str, sets: dict[int, np.ndarray]) -> dict[int, dict[int, int]]:
    """How often each shingle of the benchmark occurs in all documents."""

    def run(batches):
        members = {q: Members(keys) for q, keys in sets.items()}
        counts = {q: np.zeros(len(m.keys), np.int64) for q, m in members.items()}
        for batch in batches:
            for part in pieces(batch, text):
                w = words(part.column(text), ALNUM, lower=True)
                left = w.left()
                for q, m in members.items():
                    at, k = m.find(windows(w.hash, q))
                    counts[q] += np.bincount(k[left[at] >= q], minlength=len(m.keys))
        for q, m in members.items():
            some = np.flatnonzero(counts[q])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), q), pa.int32()), pa.array(m.keys[some].view(np.int64)), pa.array(counts[q][some])], names=["q", "shingle", "n"])

    got = docs.select(text).mapInArrow(run, "q int, shingle long, n long").groupBy("q", "shingle").agg(F.sum("n").alias("n"))
    out: dict[int, dict[int, int]] = {q: {} for q in sets}
    for r in got.collect():  # at most one row for each shingle of the block
        out[r.q][r.shingle % (1 << 64)] = r.n
    return out


def _matches(docs: DataFrame, key: str, text: str, ids: list[str | None], win: Windows, freq: dict[int, dict[int, int]], size: int, columns: list[str] | None = None, prefix: str = "") -> DataFrame:
    columns = columns or [key]
    rare = np.full(win.shingles.shape, np.iinfo(np.int64).max)
    for q, known in freq.items():
        rows = win.q == q
        rare[rows] = np.vectorize(lambda h, known=known: known.get(int(h), 0), otypes=[np.int64])(win.shingles[rows]) if rows.any() else rare[rows]
    place = np.argmin(np.where(win.inside, rare, np.iinfo(np.int64).max), axis=1)
    first_shingle = win.shingles[np.arange(len(place)), place]
    tables = {}
    for q in np.unique(win.q).tolist():
        rows = np.flatnonzero(win.q == q)
        rows = rows[np.argsort(first_shingle[rows], kind="stable")]
        keys, first = np.unique(first_shingle[rows], return_index=True)
        tables[q] = (keys, np.append(first, len(rows)), rows)
    made = {"n_words": T.LongType(), "hit_ranges": T.ArrayType(T.ArrayType(T.LongType())), "items": T.ArrayType(T.StringType()), "n_hit": T.LongType()}
    schema = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(prefix + n, t) for n, t in made.items())])
    length, win_words, item = win.length, win.words, win.item

    def run(batches):
        members = {q: Members(keys) for q, (keys, _, _) in tables.items()}
        for batch in batches:
            for part in pieces(batch, text):
                w = words(part.column(text), ALNUM, lower=True)
                n = part.num_rows
                cover = np.zeros(len(w.hash) + 1, np.int64)
                doc_of = w.owner()
                pairs = []
                for q, (_, first, rows) in tables.items():
                    at, k = members[q].find(windows(w.hash, q))
                    times = first[k + 1] - first[k]
                    which = rows[np.repeat(first[k] - np.cumsum(times) + times, times) + np.arange(times.sum())] if len(k) else rows[:0]
                    d = np.repeat(doc_of[at], times)
                    start = np.repeat(at, times) - place[which]
                    ok = (start >= w.first[d]) & (start + length[which] <= w.first[d + 1])
                    d, start, which = d[ok], start[ok], which[ok]
                    ok = np.ones(len(d), bool)
                    for j in range(size):
                        ok &= (j >= length[which]) | (w.hash[np.minimum(start + j, len(w.hash) - 1)] == win_words[which, j])
                    d, start, which = d[ok], start[ok], which[ok]
                    np.add.at(cover, start, 1)
                    np.subtract.at(cover, start + length[which], 1)
                    pairs.append(np.stack([d, item[which]], axis=1))
                hit = np.cumsum(cover[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[w.first[1:]] - total[w.first[:-1]]
                items: list[list[str]] = [[] for _ in range(n)]
                for d, i in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []:
                    items[d].append(ids[i])
                ranges: list[list[list[int]]] = [[] for _ in range(n)]
                for d in np.flatnonzero(n_hit).tolist():
                    h = np.concatenate([[False], hit[w.first[d] : w.first[d + 1]], [False]])
                    edge = np.flatnonzero(h[1:] != h[:-1]).reshape(-1, 2)
                    ranges[d] = edge.tolist()
                items = [sorted({x for x in found if x is not None}) for found in items]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(w.counts), pa.array(ranges, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string())), pa.array(n_hit)], names=schema.names)

    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)


def _window_table(bench: DataFrame, size: int) -> DataFrame:
    """The distinct windows of a benchmark (id, t): id, word hashes w, shingle length q, shingle hashes by place."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "t"):
                win = Windows(part.column("t").to_pylist(), size)
                lists = lambda values, n: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(values[np.arange(size) < n[:, None]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(win.item)), pa.array(win.q.astype(np.int32)), lists(win.words, win.length), lists(win.shingles, win.length - win.q + 1)], names=["id", "q", "w", "shingles"])

    return bench.mapInArrow(run, "id string, q int, w array<long>, shingles array<long>").dropDuplicates(["id", "w"])


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for each of 2 ** k values of the low bits of the hashes, about 16 times as many as there are, 16 MB at most."""
    n = hashes.agg(F.approx_count_distinct("h")).first()[0]
    k = min(27, max(15, n.bit_length() + 4))
    low = F.pmod(F.col("h"), F.lit(1 << k)) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(low).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("bits")).collect()  # 2 ** (k - 15) rows of 4 KB
    out = np.zeros(1 << (k - 3), np.uint8)
    for r in rows:
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _seen_shingles(docs: DataFrame, text: str, qs: list[int], bits: np.ndarray, size: int) -> DataFrame:
    """Shingles of documents that the bitmap lets through: _row, q, shingle, place, the text's number of words n, and
    the words (around) from place lo on in which a window with that shingle can lie."""
    low = np.uint64(len(bits) * 8 - 1)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text, 1 << 20):
                w = words(part.column(text), ALNUM, lower=True)
                left, owner = w.left(), w.owner()
                for q in qs:
                    h = windows(w.hash, q)
                    at = (h & low).astype(np.int64)
                    at = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & (left >= q))
                    lo = np.maximum(w.first[owner[at]], at - (size - q))
                    n = np.minimum(w.first[owner[at] + 1], at + size) - lo
                    ends = np.append(0, np.cumsum(n))
                    around = w.hash[np.repeat(lo - ends[:-1], n) + np.arange(ends[-1])]
                    first = w.first[owner[at]]
                    longs = lambda x: pa.array(x, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("_row").take(pa.array(owner[at])), pa.array(np.full(len(at), q, np.int32)), longs(h[at].view(np.int64)), longs(at - first), longs(w.counts[owner[at]]), longs(lo - first), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), longs(around.view(np.int64)))],
                        names=["_row", "q", "shingle", "place", "n", "lo", "around"],
                    )

    kind = docs.schema["_row"].dataType.simpleString()
    return docs.select("_row", text).mapInArrow(run, f"_row {kind}, q int, shingle long, place long, n long, lo long, around array<long>")


def _joined_hits(docs: DataFrame, bench: DataFrame, text: str, size: int) -> DataFrame:
    """Occurrences of windows in documents by joins: _row, id, start and length of each."""
    win = written(_window_table(bench, size), "windows")
    qs = [r.q for r in win.select("q").distinct().collect()]
    each = win.select("id", "w", "q", F.posexplode("shingles").alias("p", "shingle"))
    seen = written(_seen_shingles(docs, text, qs, _bitmap(each.select(F.col("shingle").alias("h"))), size), "shingles")
    freq = written(seen.groupBy("q", "shingle").agg(F.count("*").alias("f")), "frequencies")
    rare = each.join(freq, ["q", "shingle"], "left").groupBy("id", "w", "q").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "p", "shingle")).alias("r"))
    # A window of which some shingle is in no document occurs nowhere.
    rare = written(rare.where("r.f > 0").select("id", "w", "q", "r.p", "r.shingle"), "prefixes")
    start = F.col("place") - F.col("p")
    fits = (start >= 0) & (start + F.size("w") <= F.col("n"))
    found = seen.join(rare, ["q", "shingle"]).where(fits)
    found = found.where(F.slice("around", (start - F.col("lo") + 1).cast("int"), F.size("w")) == F.col("w"))
    return found.select("_row", "id", start.alias("start"), F.size("w").cast("long").alias("length"))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = 4 << 20, columns: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row per document: key (or the given columns), and with the prefix: n_words, n_hit (words inside an occurrence of a window), hit_ranges
    ([first, end) word places), items (ids of the items with occurring windows, sorted as strings)."""
    prepare(docs.sparkSession)
    bench = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("t"))
    total = bench.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    if total <= block_bytes:
        rows = bench.collect()  # block_bytes at most
        win = Windows([r.t for r in rows], size)
        return _matches(docs, key, text, [r.id for r in rows], win, _frequencies(docs, text, win.sets()), size, columns, prefix)
    row = F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("x"))
    hits = written(_joined_hits(docs.select(row.alias("_row"), text), bench, text, size), "hits")
    span = F.array("start", F.col("start") + F.col("length"))
    merged = hits.groupBy("_row").agg(F.array_sort(F.collect_set(span)).alias("r"), F.array_sort(F.collect_set("id")).alias("items"))  # a null id is in no list
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(F.element_at(acc, -1), 2) >= x[0]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], x[1]))))).otherwise(F.concat(acc, F.array(x)))
    merged = merged.withColumn("hit_ranges", F.aggregate("r", F.expr("cast(array() as array<array<bigint>>)"), step)).drop("r")
    merged = written(merged.withColumn("n_hit", F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])), "merged-hits")
    empty = Windows([], size)
    columns = columns or [key]
    base = _matches(docs.withColumn("_row", row), "_row", text, [], empty, {}, size, ["_row", *columns], "_own_").select("_row", *columns, "_own_n_words")
    merged = merged.select(F.col("_row").alias("_hit_row"), *(F.col(c).alias("_hit_" + c) for c in ("hit_ranges", "items", "n_hit")))
    joined = base.join(merged, F.col("_row").eqNullSafe(F.col("_hit_row")), "left")
    none = lambda c, kind: F.coalesce("_hit_" + c, F.expr(f"cast({kind})")).alias(prefix + c)
    return joined.select(*columns, F.col("_own_n_words").alias(prefix + "n_words"), none("hit_ranges", "array() as array<array<bigint>>"), none("items", "array() as array<string>"), none("n_hit", "0 as bigint"))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contamination(docs, bench)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
