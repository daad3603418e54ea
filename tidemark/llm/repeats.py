"""Operator 10: removal of repeated passages, found by recompression.

Rounds of Spark jobs give the corpus's words ever longer symbols. A round first names the maximal runs of equal
symbols. Then it counts, over the whole corpus, how often a symbol of one class is followed by one of another
(`CLASSES` classes of names, so the counts are a table of fixed size), divides the alphabet by these counts into
a left and a right half such that as many neighbours as can be found go from left to right, and names those
pairs. The division goes to the next round with the earlier ones. There are rounds until a symbol with the
neighbours that decided it takes about half a window; later symbols fit into few windows, so each would stand for
fewer of them (of windows of 20 words, 0.16 symbols each in two rounds, 0.25 in three, 0.40 in four). A name is a 64-bit hash of what it stands for, so with the
same divisions all tasks give equal sequences the same name. What a symbol depends on - itself and the
neighbours that were looked at - is a range of words around it; equal sequences of words have the same symbols
inside, apart from those whose range crosses an end. So each window of `size` words has a set of symbols that its
own words determine (at least its single words), and equal windows have the same set.

Every window takes, from the highest round that has any, the symbol with the least name, the name now
covering the words of its range. Spark counts these symbols over the corpus; a window whose symbol
occurs once is repeated nowhere. What remains is verified. The windows that share one occurrence of
a symbol form a group, and groups are joined by a hash of all their words: those that are not the first
of their kind repeat it as a whole. First ones of which the symbol has several kinds are compared window
by window, by a hash of each one's words. Windows that are not the first of their words are removed
with all words they cover; they are judged on the input, not on what is left.

Counts and first places are pre-aggregated per task and written before they are joined, so that Spark can split
a passage that a third of all texts hold. Only texts with shared symbols are read for the verification.

The key must be of an integer type. A null text has no words. Documents are ordered by key; rows with a null key
neither lose words nor make others lose any. Rows that repeat a key count as one document: none precedes the
other, and one with another text is judged by its own words. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._spark import drop, prepare, written
from tidemark.llm._text import NOT_SPACE, Words, mix, pieces, windows, words

#: Classes of names by which neighbours are counted.
CLASSES = 256
_U = np.uint64
_A, _B, _C = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Symbols:
    """The symbols of some texts in one round: name, the words lo:hi that it depends on, and whether a text begins with it."""

    def __init__(self, name, lo, hi, begins):
        self.name, self.lo, self.hi, self.begins = name, lo, hi, begins

    @classmethod
    def of(cls, w: Words) -> Symbols:
        n = len(w.hash)
        begins = np.zeros(n, bool)
        begins[w.first[:-1][w.counts > 0]] = True
        return cls(w.hash, np.arange(n), np.arange(1, n + 1), begins)

    def _sides(self) -> tuple[np.ndarray, np.ndarray]:
        """lo of the symbol before, hi of the one after; one word beyond the text at its ends, where nothing is known."""
        before = np.concatenate([[-1], self.lo[:-1]])
        before[self.begins] = self.lo[self.begins] - 1
        after = np.concatenate([self.hi[1:], self.hi[-1:] + 1])
        ends = np.concatenate([self.begins[1:], [True]])
        after[ends] = self.hi[ends] + 1
        return before, after

    def runs(self) -> Symbols:
        before, after = self._sides()
        first = np.ones(len(self.name), bool)
        first[1:] = (self.name[1:] != self.name[:-1]) | self.begins[1:]
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, len(first)))
        name = self.name[at]
        several = length > 1
        name[several] = mix(name[several] * _A + length[several].astype(_U))
        return Symbols(name, before[at], after[at + length - 1], self.begins[at])

    def classes(self, turn: int) -> np.ndarray:
        return (mix(self.name ^ _U(int(_B) * (turn + 1) % (1 << 64))) % _U(CLASSES)).astype(np.int64)

    def pairs(self, turn: int, right_half: np.ndarray) -> Symbols:
        before, after = self._sides()
        right = right_half[self.classes(turn)]
        joins = np.zeros(len(self.name), bool)  # with the next
        joins[:-1] = ~right[:-1] & right[1:] & ~self.begins[1:]
        joined = np.concatenate([[False], joins[:-1]])
        at = np.flatnonzero(~joined)
        two = joins[at]
        name, lo, hi = self.name[at], self.lo[at], self.hi[at]
        i = at[two]
        name[two] = mix(self.name[i] * _B + self.name[i + 1] * _C)
        hi[two] = self.hi[i + 1]
        alone = ~two
        r = right[at]
        lo[alone & r] = before[at[alone & r]]
        hi[alone & ~r] = after[at[alone & ~r]]
        return Symbols(name, lo, hi, self.begins[at])


def rounds(size: int) -> int:
    """A round doubles the words of a symbol and those beside it at most."""
    return max(1, math.floor(math.log2(size)) - 2)


def divide(counts: np.ndarray) -> np.ndarray:
    """Which classes are the right half, given how often each is followed by each: a class changes sides while that
    puts more neighbours from left to right, the most gainful first."""
    right = np.arange(len(counts)) % 2 == 1
    both = counts - np.diag(np.diag(counts))  # within a class nothing ever goes from left to right
    for _ in range(4 * len(counts)):
        as_left, as_right = both @ right.astype(float), (~right).astype(float) @ both
        gain = np.where(right, as_left - as_right, as_right - as_left)
        at = int(np.argmax(gain))
        if gain[at] <= 0:
            break
        right[at] = ~right[at]
    return right


def halves(docs: DataFrame, size: int, text: str = "text") -> list[np.ndarray]:
    """The right half of each round's alphabet, by counts of neighbours over all documents."""
    found: list[np.ndarray] = []
    for turn in range(rounds(size)):
        known = list(found)

        def run(batches, turn=turn, known=known):
            total = np.zeros(CLASSES * CLASSES, np.int64)
            for batch in batches:
                for part in pieces(batch, text):
                    s = Symbols.of(words(part.column(text), NOT_SPACE))
                    for k, right in enumerate(known):
                        s = s.runs().pairs(k, right)
                    s = s.runs()
                    c = s.classes(turn)
                    total += np.bincount((c[:-1] * CLASSES + c[1:])[~s.begins[1:]], minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

        counts = np.zeros(CLASSES * CLASSES)
        for r in docs.select(text).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # CLASSES ** 2 rows at most
            counts[r.cell] = r.n
        found.append(divide(counts.reshape(CLASSES, CLASSES)))
    return found


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _least(keys: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Index of the least key (the first of equal ones) in each range a to b, both included."""
    out = np.zeros(len(a), np.int64)
    table, step = np.arange(len(keys)), 1
    length = b - a + 1
    while True:
        now = (length >= step) & (length < 2 * step)
        x, y = table[a[now]], table[b[now] - step + 1]
        out[now] = np.where(keys[y] < keys[x], y, x)
        if 2 * step > most or 2 * step > len(keys):
            return out
        x, y = table[:-step], table[step:]
        table = np.where(keys[y] < keys[x], y, x)
        step *= 2


def anchors(w: Words, size: int, right_halves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows in some texts: the words where groups of consecutive windows with the same anchor
    begin, how many windows each has, and the anchors' names."""
    n = len(w.hash)
    starts = np.flatnonzero(w.left() >= size)
    if not len(starts):
        return starts, starts, np.zeros(0, _U)
    forth, back = (_powers(base, n) for base in (_BASE, _INVERSE))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(w.hash * forth[:n])])
    levels = [Symbols.of(w)]
    top = len(right_halves)
    for k, right in enumerate(right_halves):
        levels.append(levels[-1].runs().pairs(k, right))
    key = np.zeros(len(starts), _U)
    which = np.full(len(starts), -1, np.int64)
    for level in range(top, -1, -1):
        s = levels[level]
        todo = np.flatnonzero(which < 0)
        if not len(todo):
            break
        fits = np.flatnonzero((s.hi - s.lo <= size) & (s.lo >= 0) & (s.hi <= n))
        lo, hi = s.lo[fits], s.hi[fits]
        begin = np.concatenate([[0], np.cumsum(np.bincount(lo, minlength=n))])[starts[todo]]
        end = np.cumsum(np.bincount(hi, minlength=n + 1))[starts[todo] + size] - 1
        some = end >= begin
        todo, begin, end = todo[some], begin[some], end[some]
        if not len(todo):
            continue
        context = (sums[hi] - sums[lo]) * back[lo]
        names = mix(context ^ mix(s.name[fits] + _U(level)))
        at = _least(names, begin, end, size)
        key[todo], which[todo] = names[at], fits[at] * (top + 1) + level
    new = np.ones(len(starts), bool)
    new[1:] = (which[1:] != which[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    return starts[at], np.diff(np.append(at, len(new))), key[at]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} is not of an integer type")
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 20) -> DataFrame:
    """One row per document: key, n_words, removed ([first, end) word places), kept (the remaining words
    joined by one space)."""
    prepare(docs.sparkSession)
    keyed = _keyed(docs, key, text)
    right_halves = halves(keyed, size)

    def parse(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words(part.column("text"), NOT_SPACE)
                at, n, name = anchors(w, size, right_halves)
                doc = np.searchsorted(w.first, at, "right") - 1
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), part.column("id").take(rows), part.column("h").take(rows), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["symbol", "id", "h", "at", "n"])

    found = written(keyed.where("id is not null").mapInArrow(parse, "symbol long, id long, h long, at int, n int"), "symbols")
    # Written, so that both sides of the join come straight from their exchanges and Spark can split a
    # symbol that very many texts share.
    shared = written(found.groupBy("symbol").agg(F.count("*").alias("c")).where("c > 1").select("symbol"), "shared")
    groups = found.join(shared, "symbol").groupBy("id", "h").agg(F.collect_set(F.struct("symbol", "at", "n")).alias("groups"))
    groups = written(groups, "groups")
    drop(found, shared)

    def verify(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words(part.column("text"), NOT_SPACE)
                full = windows(w.hash, size)
                forth, back = (_powers(base, len(w.hash)) for base in (_BASE, _INVERSE))
                sums = np.concatenate([np.zeros(1, _U), np.cumsum(w.hash * forth[:-1])])
                g = part.column("groups")
                symbol, at, n = g.flatten().flatten()
                count = pc.list_value_length(g).to_numpy()
                rows = np.repeat(np.arange(part.num_rows), count)
                n_ = n.to_numpy().astype(np.int64)
                begin = w.first[rows] + at.to_numpy()
                end = begin + n_ + size - 1
                kind = mix((sums[end] - sums[begin]) * back[begin] + n_.astype(_U)).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(n_)])
                each = np.repeat(begin - ends[:-1], n_) + np.arange(ends[-1])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(full[each].view(np.int64)))
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([symbol, pa.array(kind), part.column("id").take(rows), part.column("h").take(rows), at, n, lists], names=["symbol", "kind", "id", "h", "at", "n", "windows"])

    seen = keyed.join(groups, ["id", "h"]).select("id", "h", "text", "groups")
    seen = written(seen.mapInArrow(verify, "symbol long, kind long, id long, h long, at int, n int, windows array<long>"), "kinds")
    drop(groups)
    place = F.struct("id", "at")
    kinds = written(seen.groupBy("kind").agg(F.min(place).alias("first"), F.first("symbol").alias("symbol")), "firsts")
    later = seen.select("kind", "id", "h", "at", "n").join(kinds.select("kind", "first"), "kind").where(place > F.col("first")).select("id", "h", "at", "n")
    several = written(kinds.groupBy("symbol").agg(F.count("*").alias("c")).where("c > 1").select("symbol"), "several")
    chosen = written(kinds.join(several, "symbol").select("kind", "first"), "several-kinds")
    heads = seen.select("kind", "id", "h", "at", "windows").join(chosen, "kind").where(place == F.col("first"))
    heads = heads.select("id", "h", "at", F.posexplode("windows").alias("more", "window")).select("window", "id", "h", (F.col("at") + F.col("more")).alias("at"))
    heads = written(heads, "heads")
    first = heads.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("window", "first")
    first = written(first, "first-windows")
    again = heads.join(first, "window").where(place > F.col("first")).select("id", "h", "at", F.lit(1).alias("n"))
    later = later.unionByName(again).groupBy("id", "h").agg(F.collect_set(F.struct("at", "n")).alias("later"))
    later = written(later, "later")
    drop(seen, kinds, several, chosen, heads, first)

    def cut(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words(part.column("text"), NOT_SPACE)
                removed, kept = [], []
                data = w.data.tobytes()
                for i, later in enumerate(part.column("later").to_pylist()):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    inside = np.zeros(b - a + 1, np.int64)
                    if later:
                        at, n = np.array([(x["at"], x["n"]) for x in later]).T
                        np.add.at(inside, at, 1)
                        np.subtract.at(inside, at + n + size - 1, 1)
                    gone = np.cumsum(inside)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                    removed.append(edge.reshape(-1, 2).tolist())
                    stay = np.flatnonzero(~gone) + a
                    kept.append(" ".join([data[s:e].decode() for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(w.counts), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string())], names=[key, "n_words", "removed", "kept"])

    judged = keyed.join(later, ["id", "h"], "left").select("id", "text", "later")
    return judged.mapInArrow(cut, f"`{key}` long, n_words long, removed array<array<long>>, kept string")


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = repeated_words(docs)
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return out.select("doc_id", "n_words", n.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
