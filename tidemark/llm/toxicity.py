"""Operator 9: toxicity by the nearest labelled examples.

Terms are the lower-cased words of a text and the first 4, 5 and 6 characters (bytes) of longer words, so
that inflected and compound forms meet. A bounded sample of labelled rows (`per_class` of each label, the
first by a hash of the key, and of these as many as hold `most_terms` terms between them, half for each label, one at
least) serves as examples, with all their terms. Document frequencies cover all
documents and all terms, and vectors are full: a text's terms that no example holds count in its norm. A
term's TF-IDF weight is multiplied by `FLOOR` + x / (x + `chi_limit`), x being the chi-square of term and
label among the examples, shrunk where less than a few (`least_df`) hold the term; no term is left out.

Examples stand in an inverted index in blocks of similar ones, with the greatest weight of each block and
term. A text's products are summed block by block where the bound of a block reaches the k-th product, so the
k nearest by cosine are exact. Whole texts are long queries, for which few blocks fall below the bound: most postings of
a text's terms are read, and the search is close to exhaustive over an index of bounded size. Their order does not depend on the text's norm; the part of the norm that
comes from terms of no example is summed by a join of those terms with their frequencies, by a hash of the
text. They vote with their squared similarity, labels weighted back to their share among all labelled rows,
with a little weight on that share; the logit of the vote is calibrated by two parameters fitted on the
examples' own leave-one-out votes. The nearest examples are returned as evidence.

The key must be of an integer type. A null or empty text has no terms and gets the vote of no neighbours. Labels that are null or of null
keys are not used; of contradicting labels of one key the greater counts. Without examples of both
labels every score is the share of label 1, or 0 without labels. Repeated rows and null keys are scored
each; ties between examples go to the smaller key. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._spark import fresh, prepare, written
from tidemark.llm._text import ALNUM, LOWER, Members, mix, pieces, words

_P = np.uint64(0x100000001B3)
PREFIXES = (4, 5, 6)
#: Factor of a term that says nothing about the label.
FLOOR = 0.05
SHOWN = 3


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct terms of each text, in order: the text, the term's place in a sorted table, its count;
    and the table."""
    w = words(texts, ALNUM, lower=True)
    none = np.zeros(0, np.int64)
    if not len(w.hash):
        return none, none, none, np.zeros(0, np.uint64)
    distinct, first, word = np.unique(w.hash, return_index=True, return_inverse=True)
    pair, n = np.unique(w.owner() * len(distinct) + word, return_counts=True)
    owner, word = np.divmod(pair, len(distinct))
    data = LOWER[w.data]
    start, length = w.start[first], (w.end - w.start)[first]
    kinds, has = [distinct], [np.ones(len(distinct), bool)]
    h = np.full(len(distinct), 0xCBF29CE484222325, np.uint64)
    for j in range(max(PREFIXES)):
        h = h * _P + data[np.minimum(start + j, len(data) - 1)].astype(np.uint64)
        if j + 1 in PREFIXES:
            kinds.append(mix(h + np.uint64(j + 1)))
            has.append(length > j + 1)
    table, place = np.unique(np.concatenate([k[ok] for k, ok in zip(kinds, has, strict=True)]), return_inverse=True)
    doc, term, count, at = [], [], [], 0
    for ok in has:
        mine = np.full(len(distinct), -1)
        mine[ok] = place[at : at + ok.sum()]
        at += ok.sum()
        t = mine[word]
        some = t >= 0
        doc.append(owner[some])
        term.append(t[some])
        count.append(n[some])
    key = np.concatenate(doc) * len(table) + np.concatenate(term)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    doc, term = np.divmod(key[at], len(table))
    return doc, term, np.add.reduceat(np.concatenate(count)[order], at), table


def terms(texts: pa.Array, keep: Members | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and count for the distinct terms of each text. With keep, only members count, as their indexes."""
    doc, term, count, table = _terms(texts)
    if keep is None:
        return doc, table[term], count
    at, k = keep.find(table)
    known = np.full(len(table), -1)
    known[at] = k
    term = known[term]
    some = term >= 0
    return doc[some], term[some].astype(np.uint64), count[some]


def _alike(products: np.ndarray, which: np.ndarray, size: int) -> list[int]:
    """An order of the vectors with these inner products in which similar ones are near: halves by the first
    principal direction, again and again, down to blocks of `size`."""
    if len(which) <= size:
        return which.tolist()
    s = products[np.ix_(which, which)]
    mean = s.mean(axis=0)
    s -= mean
    s -= mean[:, None]
    s += mean.mean()
    v = np.cos(np.arange(len(which), dtype=np.float32) + 1)
    for _ in range(30):
        v = s @ v
        v /= max(np.linalg.norm(v), 1e-300)
    which = which[np.argsort(v, kind="stable")]
    cut = size * max(1, -(-len(which) // size) // 2)
    del s
    return _alike(products, which[:cut], size) + _alike(products, which[cut:], size)


class Votes:
    """How the nearest examples become a calibrated score: the examples' keys and labels, the labels' weights."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, weight: tuple, share: float, a: float = 1.0, b: float = 0.0):
        self.keys, self.labels, self.weight, self.share, self.a, self.b = keys, labels, weight, share, a, b

    def vote(self, sims: np.ndarray, places: np.ndarray) -> float:
        y = self.labels[places]
        w = np.where(y == 1, self.weight[1], self.weight[0]) * sims * sims
        return (float(w @ y) + 0.05 * self.share) / (float(w.sum()) + 0.05)

    def calibrated(self, vote: float) -> float:
        return 1 / (1 + math.exp(-min(500.0, max(-500.0, self.a * math.log(vote / (1 - vote)) + self.b))))

    def calibrate(self, votes: np.ndarray, y: np.ndarray) -> None:
        x = np.log(votes / (1 - votes))
        w = np.where(y == 1, self.weight[1], self.weight[0])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(self.a * x + self.b, -500, 500)))
            g, h = w * (p - y), w * p * (1 - p) + 1e-9
            grad = np.array([(g * x).sum() + 1e-3 * (self.a - 1), g.sum() + 1e-3 * self.b])
            hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
            step = np.linalg.solve(hess, grad)
            step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
            self.a, self.b = self.a - step[0], self.b - step[1]


class Index(Votes):
    """Examples by term, as postings in blocks of `BLOCK` similar examples, each block's greatest weight beside it.

    The postings of term t are those of the entries ptr[t]:ptr[t + 1]; an entry e is one block of them, in block
    block[e], with greatest weight top[e] and postings at[e]:at[e + 1], each an example's place and its weight.
    The terms of which a `DENSE`-th of the examples have a posting (the `ROWS` most frequent at most) stand once
    more as rows with a weight for each example, so that a batch of texts meets them in one matrix product.
    """

    BLOCK, DENSE, ROWS = 64, 16, 4096
    #: Queries at a time.
    BATCH = 64
    #: Blocks, best bound first, that are looked at before the bounds of the others are held against the k-th best.
    FIRST = 2

    def __init__(self, keys: np.ndarray, labels: np.ndarray, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, share: float, k: int):
        n1 = labels.mean()
        super().__init__(keys, labels, ((1 - share) / (1 - n1), share / n1), share)
        self.n_terms, self.k, self.blocks = n_terms, k, -(-len(keys) // self.BLOCK)
        n = np.bincount(term.astype(np.int64), minlength=n_terms)
        frequent = np.argsort(-n, kind="stable")[: self.ROWS]
        self.dense = np.sort(frequent[n[frequent] * self.DENSE >= len(keys)])
        self._post(keys, labels, doc, term, weight)
        products = np.zeros((len(keys), len(keys)), np.float32)
        order = np.argsort(doc, kind="stable")
        for low in range(0, len(keys), self.BATCH):
            some = order[slice(*np.searchsorted(doc[order], [low, low + self.BATCH]))]
            products[low : low + self.BATCH] = self.products(doc[some] - low, term[some].astype(np.int64), weight[some], len(products[low : low + self.BATCH]))
        order = np.array(_alike(products, np.arange(len(keys)), self.BLOCK))
        del products
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self._post(keys[order], labels[order], place[doc], term, weight)

    def _post(self, keys, labels, doc, term, weight) -> None:
        self.keys, self.labels = keys, labels
        order = np.lexsort((doc, term))
        self.doc, self.posted = doc[order].astype(np.int32), weight[order]
        entry = term[order].astype(np.int64) * self.blocks + self.doc // self.BLOCK
        first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        self.at = np.append(first, len(entry))
        self.top = np.maximum.reduceat(self.posted, first)
        self.block = (entry[first] % self.blocks).astype(np.int32)
        self.ptr = np.searchsorted(entry[first] // self.blocks, np.arange(self.n_terms + 1))
        self._prepare()

    def _prepare(self) -> None:
        self.rows = None  # the old rows go before the new ones come
        self.rows = np.zeros((len(self.dense), self.blocks * self.BLOCK))
        self.row = np.full(self.n_terms, -1, np.int32)
        self.row[self.dense] = np.arange(len(self.dense))
        for i, t in enumerate(self.dense.tolist()):
            lo, hi = self.at[self.ptr[t]], self.at[self.ptr[t + 1]]
            self.rows[i, self.doc[lo:hi]] = self.posted[lo:hi]

    def votes(self) -> Votes:
        return Votes(self.keys, self.labels, self.weight, self.share, self.a, self.b)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "row")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._prepare()

    @property
    def weights(self) -> np.ndarray:
        """The whole matrix (term, example), to look at small indexes."""
        out = np.zeros((self.n_terms, len(self.keys)))
        out[np.repeat(np.arange(self.n_terms), np.diff(self.at[self.ptr])), self.doc] = self.posted
        return out

    def _start(self, owner: np.ndarray, at: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Products over the dense rows' terms (query, place), and the entries of the other terms with their query and
        weight. Places beyond the examples have 0."""
        row = self.row[at]
        some = row >= 0
        dense = np.zeros((n, len(self.dense)))
        dense[owner[some], row[some]] = q[some]
        owner, at, q = owner[~some], at[~some], q[~some]
        m = self.ptr[at + 1] - self.ptr[at]
        return dense @ self.rows, np.repeat(self.ptr[at] - np.cumsum(m) + m, m) + np.arange(m.sum()), np.repeat(owner, m), np.repeat(q, m)

    def _add(self, sums: np.ndarray, entry: np.ndarray, owner: np.ndarray, q: np.ndarray) -> None:
        m = self.at[entry + 1] - self.at[entry]
        which = np.repeat(self.at[entry] - np.cumsum(m) + m, m) + np.arange(m.sum())
        cell = np.repeat(owner * sums.shape[1], m) + self.doc[which]
        sums += np.bincount(cell, weights=np.repeat(q, m) * self.posted[which], minlength=sums.size).reshape(sums.shape)

    def products(self, owner: np.ndarray, at: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
        """Products of n queries with all examples; query owner[i] has the weight q[i] for the term at[i]."""
        sums, *rest = self._start(owner, at, q, n)
        self._add(sums, *rest)
        return sums[:, : len(self.keys)]

    def nearest(self, owner: np.ndarray, at: np.ndarray, q: np.ndarray, n: int, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n queries (as in products) the k nearest examples, but for the one whose key is in `but`; those that share
        no term are none. Returns cuts (those of query i are cuts[i]:cuts[i + 1]), products and places.

        An example has at most its product over the dense rows and the sum of its block's greatest weights of
        the other terms. Blocks whose bound is below the k-th product found are left out; what remains is summed
        in full.
        """
        sums, entry, owner, q = self._start(owner, at, q, n)
        cell = owner * self.blocks + self.block[entry]
        bound = sums.reshape(n, self.blocks, self.BLOCK).max(axis=2)
        bound = bound + np.bincount(cell, weights=q * self.top[entry], minlength=n * self.blocks).reshape(n, self.blocks)
        open_ = np.ones(bound.shape, bool)
        if self.blocks > self.FIRST and len(self.keys) > self.k:
            look = np.zeros(bound.shape, bool)
            np.put_along_axis(look, np.argpartition(bound, -self.FIRST, axis=1)[:, -self.FIRST :], True, axis=1)
            now = look.ravel()[cell]
            self._add(sums, entry[now], owner[now], q[now])
            least = np.partition(sums, -self.k - 1, axis=1)[:, -self.k - 1]  # one more, as `but` may be among them
            open_ = ~look & (bound * (1 + 1e-9) >= least[:, None])
        now = open_.ravel()[cell]
        self._add(sums, entry[now], owner[now], q[now])
        sums = sums[:, : len(self.keys)]
        if but is not None:
            sums[self.keys[None, :] == but[:, None]] = 0
        least = np.partition(sums, -self.k, axis=1)[:, -self.k] if len(self.keys) > self.k else np.zeros(n)
        rows, places = np.nonzero((sums >= least[:, None]) & (sums > 0))
        s = sums[rows, places]
        order = np.lexsort((self.keys[places], -s, rows))
        rows, places, s = rows[order], places[order], s[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        some = rank < self.k
        return np.searchsorted(rows[some], np.arange(n + 1)), s[some], places[some]


class Model:
    """What scoring needs: the examples' terms with their weights and the index, of bounded size; as tables the
    document frequencies of all other terms (rest), and the documents (docs) it was fitted on with the part of their
    norms that comes from those terms (others)."""

    def __init__(self, share: float, vocabulary=None, weight=None, index=None, rest: DataFrame | None = None, n: int = 0):
        self.share, self.vocabulary, self.weight, self.index, self.rest, self.n = share, vocabulary, weight, index, rest, n
        self.docs: DataFrame | None = None
        self.others: DataFrame | None = None


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 1000, k: int = 25, chi_limit: float = 20.0, least_df: int = 3, most_terms: int = 2_000_000) -> Model:
    prepare(docs.sparkSession)
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} is not of an integer type")
    labelled = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    labelled = written(labelled, "labels")
    count = {r.y: r.n for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    chosen = [labelled.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    chosen = written(chosen[0].unionByName(chosen[1]), "chosen")  # at most 2 * per_class rows
    ids = chosen.select(F.col("id").alias("_id"), "y")
    sample = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(ids), "_id")

    def split(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                d, t, c = terms(part.column("text"))
                rows = pa.array(d)
                yield pa.RecordBatch.from_arrays([part.column("_id").take(rows), part.column("y").take(rows), pa.array(t.view(np.int64)), pa.array(c)], names=["id", "y", "term", "c"])

    found = sample.select(F.col("_id").cast("long").alias("_id"), "y", "text").mapInArrow(split, "id long, y int, term long, c long")
    found = written(found.groupBy("id", "term").agg(F.max("y").alias("y"), F.max("c").alias("c")), "sample-terms")
    found = _within(found, most_terms).toArrow()  # what the examples hold
    ids, first, doc = np.unique(found["id"].to_numpy(), return_index=True, return_inverse=True)
    y = found["y"].to_numpy()[first]
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    if not n0 or not n1:
        return Model(share)
    keep = Members(found["term"].to_numpy().view(np.uint64))
    term = np.searchsorted(keep.keys, found["term"].to_numpy().view(np.uint64))
    c = found["c"].to_numpy()
    del found
    n, df, split = _document_frequencies(docs, text, keep)
    a, held = np.bincount(term, weights=y[doc]), np.bincount(term)
    b = held - a
    chi = (n0 + n1) * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(1.0, held * (n0 + n1 - held) * float(n0) * float(n1))
    chi *= held / (held + least_df)
    weight = (np.log((1.0 + n) / (1.0 + df)) + 1e-6) * (FLOOR + chi / (chi + chi_limit))
    order = np.lexsort((term, doc))
    doc, term, c = doc[order], term[order], c[order]
    v = (1 + np.log(c)) * weight[term]
    v /= np.sqrt(np.bincount(doc, weights=v * v))[doc]
    index = Index(ids, y, doc, term, v, len(keep.keys), share, k)
    votes = []
    for low in range(0, len(ids), Index.BATCH):
        lo, hi = np.searchsorted(doc, [low, low + Index.BATCH])
        mine = ids[low : low + Index.BATCH]
        cuts, sims, places = index.nearest(doc[lo:hi] - low, term[lo:hi], v[lo:hi], len(mine), but=mine)
        votes += [index.vote(sims[i:j], places[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    index.calibrate(np.array(votes), y)
    other = split.where("x is not null")
    rest = written(other.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "document-frequencies")
    model = Model(share, keep.keys, weight, index, rest, n)
    model.docs, model.others = docs, _other_norms(other, model)
    return model


def _within(found: DataFrame, most: int) -> DataFrame:
    """The rows of as many examples of each label, by a hash of their keys, as hold half of `most` rows; of one at least."""
    sizes = found.groupBy("id").agg(F.max("y").alias("y"), F.count("*").alias("n")).orderBy(F.xxhash64("id"), "id").collect()  # a row per example
    kept, total, held = [], {0: 0, 1: 0}, {0: 0, 1: 0}
    for r in sizes:
        total[r.y] += r.n
        if not held[r.y] or total[r.y] <= most / 2:
            held[r.y] += 1
            kept.append(r.id)
    return found if len(kept) == len(sizes) else found.where(F.col("id").isin(kept))


def _split_terms(docs: DataFrame, text: str, keep: Members) -> DataFrame:
    """One row for each document that has terms outside `keep`: a hash of its text (x), these terms and their counts
    (counts). And per task a row without x: the number of documents (n), the places of kept terms (terms) and in how
    many documents they are (counts)."""

    def run(batches):
        n, df = 0, np.zeros(len(keep.keys), np.int64)
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
        names = ["x", "n", "terms", "counts"]
        for batch in batches:
            n += batch.num_rows
            for part in pieces(batch, "text"):
                d, t, c, table = _terms(part.column("text"))
                at, k = keep.find(table)
                df[k] += np.bincount(t, minlength=len(table))[at]
                other = np.ones(len(table), bool)
                other[at] = False
                other = other[t]
                d, t, c = d[other], table[t[other]], c[other]
                ends = np.searchsorted(d, np.arange(part.num_rows + 1))
                some = np.flatnonzero(np.diff(ends))
                x = part.column("x").take(pa.array(some))
                yield pa.RecordBatch.from_arrays([x, pa.nulls(len(some), pa.int64()), lists(np.append(ends[some], len(d)), t.view(np.int64)), lists(np.append(ends[some], len(d)), c)], names=names)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([n], pa.int64()), lists([0, len(some)], some), lists([0, len(some)], df[some])], names=names)

    return docs.select(F.xxhash64(text).alias("x"), F.col(text).alias("text")).mapInArrow(run, "x long, n long, terms array<long>, counts array<long>")


def _document_frequencies(docs: DataFrame, text: str, keep: Members) -> tuple[int, np.ndarray, DataFrame]:
    """Number of documents, of those with each kept term, and the documents' other terms."""
    split = written(_split_terms(docs, text, keep), "other-terms")
    kept = split.where("x is null")
    n = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    df = np.zeros(len(keep.keys))
    rows = kept.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("n"))
    rows = rows.toArrow()  # at most one row for each term of the examples
    df[rows["terms"].to_numpy()] = rows["n"].to_numpy()
    return n, df, split


def _other_norms(other: DataFrame, model: Model) -> DataFrame:
    """By hash of a text (x), the squared weights of its terms that no example holds, summed (other)."""
    pairs = other.select("x", (F.lit(1.0) / F.size("terms")).alias("part"), F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    pairs = pairs.select("x", "part", F.col("p.terms").alias("term"), F.col("p.counts").cast("int").alias("c"))
    df = F.coalesce("n", F.lit(0)).cast("double")
    w = (1 + F.log(F.col("c").cast("double"))) * (F.log((1.0 + model.n) / (1 + df)) + 1e-6) * FLOOR
    rows = F.round(F.sum("part"))  # a repeated text comes as often as it has rows
    return written(pairs.join(model.rest, "term", "left").groupBy("x").agg(F.round(F.sum(w * w) / rows, 9).alias("other")), "other-norms")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", columns: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row per document: key (or the given columns), score, evidence (the nearest examples: id,
    label, similarity); the names of the latter two get the prefix."""
    columns = columns or [key]
    prepare(docs.sparkSession)
    evidence = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))
    own = [docs.schema[c] for c in columns]
    if not model.index:
        return docs.select(*columns, F.lit(float(model.share)).alias(prefix + "score"), F.array().cast(evidence).alias(prefix + "evidence"))
    index, votes, vocabulary, weight = model.index, model.index.votes(), model.vocabulary, model.weight
    near_x, near_norm, near_products, near_places = fresh(docs.columns, "_near_x", "_near_norm", "_near_products", "_near_places")
    made = {near_x: T.LongType(), near_norm: T.DoubleType(), near_products: T.ArrayType(T.DoubleType()), near_places: T.ArrayType(T.IntegerType())}
    near = T.StructType([*own, *(T.StructField(n, t) for n, t in made.items())])
    schema = T.StructType([*own, T.StructField(prefix + "score", T.DoubleType()), T.StructField(prefix + "evidence", evidence)])
    kind = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))

    def find(batches):
        keep = Members(vocabulary)
        for batch in batches:
            for part in pieces(batch, text):
                d, t, c = terms(part.column(text), keep)
                t = t.astype(np.int64)
                q = (1 + np.log(c)) * weight[t]
                norms = np.bincount(d, weights=q * q, minlength=part.num_rows)
                ends, products, places = [np.zeros(1, np.int64)], [], []
                for low in range(0, part.num_rows, index.BATCH):
                    n = min(index.BATCH, part.num_rows - low)
                    lo, hi = np.searchsorted(d, [low, low + n])
                    cuts, s, at = index.nearest(d[lo:hi] - low, t[lo:hi], q[lo:hi], n)
                    ends.append(ends[-1][-1] + cuts[1:])
                    products.append(s)
                    places.append(at.astype(np.int32))
                ends = pa.array(np.concatenate(ends), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (products, places)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), part.column(near_x), pa.array(norms), *lists], names=near.names)

    def judge(batches):
        for batch in batches:
            scores, shown = [], []
            for norm, products, places in zip(*(batch.column(n).to_pylist() for n in (near_norm, near_products, near_places)), strict=True):
                at = np.array(places, np.int64)
                sims = np.array(products, np.float64) / math.sqrt(norm or 1.0)
                scores.append(votes.calibrated(votes.vote(sims, at)))
                shown.append([{"id": int(votes.keys[p]), "label": int(votes.labels[p]), "similarity": float(s)} for s, p in zip(sims[:SHOWN], at[:SHOWN], strict=True)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores, pa.float64()), pa.array(shown, kind)], names=schema.names)

    others = model.others if docs is model.docs else _other_norms(_split_terms(docs, text, Members(vocabulary)).where("x is not null"), model)
    near_other, = fresh(docs.columns, "_near_other")
    others = others.withColumnsRenamed({"x": near_x, "other": near_other})
    found = docs.withColumn(near_x, F.xxhash64(text)).select(*dict.fromkeys([*columns, text, near_x])).mapInArrow(find, near)
    joined = found.join(others, near_x, "left").withColumn(near_norm, F.col(near_norm) + F.coalesce(near_other, F.lit(0.0)))
    return joined.select(*columns, near_norm, near_products, near_places).mapInArrow(judge, schema)


def held_out(key: str = "doc_id"):
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")
