"""Many models fitted in the same passes over the rows.

A slot is a training set: the rows of one outer fold, or those of one of its inner rotations, with the rows held out to
watch. A model is a slot with parameters. Rows carry their role in every slot and their margin under every model, so
each level of all models' next trees is one Spark aggregate of gradients keyed by (model, node, feature, bin): rows
are read once a level, not once a model. The driver sees models x nodes x features x bins sums and picks splits. Linear
models share passes alike: one Newton step of all of them is one aggregate of their second derivatives.

Gradients are added as whole multiples of 2**-30, so sums do not depend on the order of rows or tasks, and a
model grown among others is the model grown alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.trees import Node, assign, leaves

SCALE = float(1 << 30)
NONE, TRAIN, HELD = 0, 1, 2


@dataclass
class Slot:
    """Rows to train on and to watch, as conditions; `fold` is whose test rows it must not see."""

    fold: object
    name: str
    y: str
    train: Column
    held: Column | None = None


@dataclass
class Spec:
    """One boosted model: its slot, parameters, and what has become of it."""

    slot: int
    depth: int = 3
    least: float = 1.0
    rounds: int = 100
    patience: int | None = None
    rate: float = 0.05
    penalty: float = 1.0
    colsample: float = 1.0
    subsample: float = 1.0
    seed: int = 0
    base: float = 0.0
    banned: tuple[int, ...] = ()  # columns that it must not use
    trees: list[Node] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    done: bool = False

    @property
    def best_round(self) -> int:
        return int(np.argmin(self.losses)) + 1 if self.losses else len(self.trees)


def _role(s: Slot) -> Column:
    held = F.coalesce(s.held, F.lit(False)) if s.held is not None else F.lit(False)
    return F.when(F.col(s.y).isNull(), NONE).when(F.coalesce(s.train, F.lit(False)), TRAIN).when(held, HELD).otherwise(NONE).cast("tinyint")


def plan_slots(plan: dict) -> tuple[list[Slot], dict]:
    """All training sets of a plan, and where those of each (fold, label) begin: the whole fold, then its rotations."""
    slots, first = [], {}
    for at, entry in plan.items():
        first[at] = len(slots)
        slots += [entry["whole"], *entry["rotations"]]
    return slots, first


def slot_counts(df: DataFrame, slots: list[Slot], starts: dict[str, str] | None = None) -> list[dict]:
    """For each slot its training rows (n), positives (p), events (runs, from columns that mark the first row of each), and
    rows and positives held out (m, q), in one pass."""
    if not slots:
        return []
    labels = list(dict.fromkeys(s.y for s in slots))
    at = np.array([labels.index(s.y) for s in slots], int)
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    rows = df.select(F.array(*[_role(s) for s in slots]).alias("_role"), F.array(*[whole(y) for y in labels]).alias("_y"), F.array(*[whole(starts[y] if starts else y) for y in labels]).alias("_up"))

    def run(batches):
        total = np.zeros((5, len(at)), np.int64)
        for batch in batches:
            if batch.num_rows:
                role, y, up = (_matrix(batch.column(c), batch.num_rows) for c in ("_role", "_y", "_up"))
                total += _tally(role, y, up, at)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=["sums"])

    total = np.zeros((5, len(slots)), np.int64)
    for r in rows.mapInArrow(run, "sums array<long>").collect():  # a row per task
        total += np.array(r.sums, np.int64).reshape(5, -1)
    return _counts(total)


def _tally(role: np.ndarray, y: np.ndarray, up: np.ndarray, at: np.ndarray) -> np.ndarray:
    train, held = role == TRAIN, role == HELD
    return np.stack([train.sum(axis=0), (train * y[:, at]).sum(axis=0), (train * up[:, at]).sum(axis=0), held.sum(axis=0), (held * y[:, at]).sum(axis=0)])


def _counts(total: np.ndarray) -> list[dict]:
    return [dict(zip(("n", "p", "runs", "m", "q"), map(int, column), strict=True)) for column in total.T]


def fold_edges(df: DataFrame, columns: list[str], trains: list[Column], bins: int) -> list[list[list[float]]]:
    """Cuts of each column at its quantiles over each fold's training rows, exactly: the order of rows or tasks decides nothing."""
    own = F.array(*[F.coalesce(t, F.lit(False)) for t in trains])
    chunks = packed(df.select(own.alias("_in"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in columns]).alias("_x")), {"_in": np.bool_, "_x": np.float64})
    out = edges_of(chunks, len(trains), len(columns), bins)
    chunks.unpersist()
    return out


def edges_of(chunks: RDD, n_folds: int, n_columns: int, bins: int) -> list[list[list[float]]]:
    """fold_edges of chunks of (row is in a fold's training set, values)."""
    found = order_statistics(chunks, n_folds, n_columns, [k / bins for k in range(1, bins)])
    return [[sorted({float(v) for v in x if not math.isnan(v)}) for x in of] for of in found]


#: Counts in a pass of a search for order statistics; its digits are as wide as that allows.
COUNTED = 1 << 17


def order_statistics(chunks: RDD, n_sets: int, n_columns: int, qs: list[float]) -> np.ndarray:
    """For each set of rows and column the ceil(q n)-th smallest of its n values that are not NaN, exactly, for each q; NaN where there are none.
    Chunks are (row is in set, values). Values are taken as whole numbers of the same order, of which one digit after the other is found by
    counts, a pass each: what a task holds does not grow with its rows."""
    groups = n_sets * n_columns
    bits, done = max(1, min(11, int(math.log2(max(2, COUNTED // max(1, groups * len(qs))))))), 0
    found, rank = np.zeros((groups, len(qs)), np.uint64), np.zeros((groups, len(qs)), np.int64)
    while done < 64 and groups:
        width = min(bits, 64 - done)
        known = [np.unique(x) for x in found]  # digits found so far, of which several quantiles may have the same
        first = np.cumsum([0, *(len(x) for x in known)])

        def run(parts, done=done, width=width, known=known, first=first):
            total = np.zeros((first[-1], 1 << width), np.int64)
            for inside, x in parts:
                for j in range(n_columns):
                    values = np.ascontiguousarray(x[:, j]) + 0.0
                    b = values.view(np.uint64)
                    key, there = np.where(b >> np.uint64(63), ~b, b | np.uint64(1 << 63)), ~np.isnan(values)
                    for i in range(n_sets):
                        own, g = key[there & inside[:, i]], i * n_columns + j
                        at = 0
                        if done:
                            before = own >> np.uint64(64 - done)
                            at = np.minimum(np.searchsorted(known[g], before), len(known[g]) - 1)
                            on = known[g][at] == before
                            own, at = own[on], at[on]
                        digit = ((own >> np.uint64(64 - done - width)) & np.uint64((1 << width) - 1)).astype(np.int64)
                        total[first[g] : first[g + 1]] += np.bincount((at << width) + digit, minlength=len(known[g]) << width).reshape(-1, 1 << width)
            yield 0, total

        count = added(chunks.mapPartitions(run)).get(0, np.zeros((first[-1], 1 << width), np.int64))
        upto = np.cumsum(count, axis=1)
        if not done:
            n = upto[:, -1]
            rank = np.ceil(np.array(qs)[None, :] * n[:, None]).astype(np.int64)
        row = np.stack([first[g] + np.searchsorted(known[g], found[g]) for g in range(groups)])
        digit = np.minimum((upto[row] < rank[:, :, None]).sum(axis=2), (1 << width) - 1)
        rank = rank - np.where(digit > 0, upto[row, np.maximum(digit - 1, 0)], 0)
        found = (found << np.uint64(width)) | digit.astype(np.uint64)
        done += width
    if not groups:
        return np.zeros((n_sets, n_columns, len(qs)))
    b = np.where(found >> np.uint64(63), found ^ np.uint64(1 << 63), ~found)
    return np.where(n[:, None] > 0, b.view(np.float64), math.nan).reshape(n_sets, n_columns, len(qs))


def binned(columns: list[str], edges: list[list[float]]) -> list[Column]:
    """Number of edges at or below each value; -1 for missing."""

    def one(value: Column, e: list[float]) -> Column:
        below = F.size(F.filter(F.from_json(F.lit(str(e)), "array<double>"), lambda x: x <= value)) if e else F.lit(0)
        return F.when(value.isNull(), -1).otherwise(below).cast("smallint")

    return [one(F.col(c), e) for c, e in zip(columns, edges, strict=True)]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1)


#: Rows of a packed chunk; tasks whose sums go straight to the driver instead of through an exchange; turns after which margins
#: are made anew from all trees, so that no chain of states becomes long.
CHUNK, FEW, AGAIN = 1 << 15, 64, 32


def settle(df: DataFrame) -> DataFrame:
    """df computed once: written to the checkpoint folder where there is one, else kept by the executors."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def added(sums: RDD) -> dict:
    """Sums by key of (key, array), of few tasks on the driver, of many through an exchange first."""
    if sums.getNumPartitions() > FEW:
        sums = sums.reduceByKey(np.add, FEW)
    out: dict = {}
    for k, v in sums.collect():
        out[k] = out[k] + v if k in out else v
    return out


def packed(df: DataFrame, kinds: dict[str, type]) -> RDD:
    """Columns of numbers, or arrays of numbers, as tuples of matrices (vectors for plain numbers), one for each batch, kept while they are passed over."""

    plain = {f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType)}

    def run(batches):
        for batch in batches:
            if n := batch.num_rows:
                made = [batch.column(c).to_numpy(zero_copy_only=False) if c in plain else _matrix(batch.column(c), n) for c in kinds]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(made, kinds.values(), strict=True)]], names=["_n", *kinds])

    rows = df.select(*kinds).mapInArrow(run, "_n long, " + ", ".join(f"{c} binary" for c in kinds))
    chunks = rows.rdd.map(lambda r: tuple(x if c in plain else x.reshape(r["_n"], -1) for c, x in ((c, np.frombuffer(r[c], k)) for c, k in kinds.items())))
    return evenly(chunks).persist(StorageLevel.MEMORY_AND_DISK)


def evenly(chunks: RDD) -> RDD:
    """Chunks dealt out one by one to as many tasks as keep all cores busy to the end, where there are not so many already."""
    parts, cores = chunks.getNumPartitions(), max(1, chunks.context.defaultParallelism)
    n = -(-parts // cores) * cores
    if n == parts:
        return chunks
    return chunks.mapPartitionsWithIndex(lambda i, part: (((i * n // parts + k) % n, x) for k, x in enumerate(part))).partitionBy(n, lambda k: k).values()


def _joined(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column, one value after the other."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) and ends[-1] > ends[0] else np.zeros(0, np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix of bytes."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _in_bins(column: pa.Array, rows: int, folds: list[list[np.ndarray]]) -> np.ndarray:
    """Number of edges at or below each value (row, fold, column), -1 for missing, as `binned` has it; the edges are by fold and column."""
    flat = column.flatten()
    x, missing = _matrix(column, rows), flat.is_null().to_numpy(zero_copy_only=False).reshape(rows, -1)
    out = np.empty((rows, len(folds), x.shape[1]), np.int16)
    for f, edges in enumerate(folds):
        for j, e in enumerate(edges):
            out[:, f, j] = np.where(missing[:, j], -1, np.searchsorted(e, x[:, j], side="right"))
    return out


class Boosters:
    """All boosted models over one table. Rows of equal bins, labels and roles have equal gradients under every model: models are grown
    on the distinct ones with their counts, packed into binary chunks, so a pass costs what the distinct rows do. A pass is one job
    without an exchange over the chunks, which keep their margins. grow() returns the key columns, carried columns, roles and margins of every row."""

    def __init__(self, df: DataFrame, columns: list[str], slots: list[Slot], folds: list, trains: list[Column], keys: list[str] | None = None, bins: int = 32, monotone: dict[str, int] | None = None, carried: list[str] | None = None, edges: list[list[list[float]]] | None = None):
        self.columns, self.slots, self.folds = columns, slots, folds
        self.keys, self.carried, self.width = list(keys or []), list(carried or []), bins + 2
        self.monotone = np.array([(monotone or {}).get(c, 0) for c in columns])
        self.edges = edges or fold_edges(df, columns, trains, bins)
        self.labels = list(dict.fromkeys(s.y for s in slots))
        hashed = F.xxhash64(*self.keys) if self.keys else F.lit(0).cast("long")
        self.rows = df.select(
            *self.keys, *self.carried, F.array(*[F.coalesce(F.col(y).cast("tinyint"), F.lit(0).cast("tinyint")) for y in self.labels]).alias("_y"), F.array(*[_role(s) for s in slots]).alias("_role"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"), hashed.alias("_hash")
        )
        self.packed: dict[bool, tuple[DataFrame, int]] = {}

    def _cuts(self) -> list[list[np.ndarray]]:
        return [[np.array(e, np.float64) for e in edges] for edges in self.edges]

    def _pack(self, hashed: bool) -> tuple[DataFrame, int]:
        """Distinct rows (each row's hash among what they differ in, where models draw rows) with a role in some slot, in chunks, and
        how many chunks there are. A row is its labels, roles, bins and hash, byte after byte."""
        if hashed not in self.packed:
            cuts = self._cuts()

            def distinct(batches):
                for batch in batches:
                    n = batch.num_rows
                    if not n:
                        continue
                    role = _matrix(batch.column("_role"), n).astype(np.int8)
                    parts = [_matrix(batch.column("_y"), n).astype(np.int8), role, _in_bins(batch.column("_x"), n, cuts).reshape(n, -1)]
                    if hashed:
                        parts.append(batch.column("_hash").to_numpy().reshape(n, 1))
                    rows = np.concatenate([np.ascontiguousarray(x).view(np.uint8) for x in parts], axis=1)[(role != NONE).any(axis=1)]
                    if len(rows):
                        width = rows.shape[1]
                        found, count = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, width)))[:, 0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([_binary(found.view(np.uint8).reshape(-1, width)), pa.array(count.astype(np.int64))], names=["_row", "_count"])

            def run(batches):
                held, size = [], 0

                def chunk():
                    return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), *[pa.array([b"".join(x)], pa.binary()) for x in zip(*held, strict=True)]], names=["_n", "_row", "_count"])

                for batch in batches:
                    if not batch.num_rows:
                        continue
                    held.append((_joined(batch.column("_row")).tobytes(), batch.column("_count").to_numpy().astype(np.int64).tobytes()))
                    size += batch.num_rows
                    if size >= CHUNK:
                        yield chunk()
                        held, size = [], 0
                if size:
                    yield chunk()

            rows = self.rows.select("_y", "_role", "_x", "_hash").mapInArrow(distinct, "_row binary, _count long").groupBy("_row").agg(F.sum("_count").alias("_count"))
            chunks = rows.mapInArrow(run, "_n long, _row binary, _count binary").persist()
            self.packed[hashed] = chunks, chunks.count()
        return self.packed[hashed]

    def grow(self, specs: list[Spec]) -> DataFrame:
        """Grow all models to their rounds, or until what they watch has not improved for `patience` rounds."""
        self.specs = specs
        self.hashed = any(s.subsample < 1 for s in specs)
        chunks = self._pack(self.hashed)[0].rdd
        chunks = chunks.coalesce(max(1, chunks.context.defaultParallelism))  # as many tasks as run at once: a pass is short
        state, before, turn = self._state(chunks, 0, 0), None, 0
        while True:
            going = [m for m, s in enumerate(specs) if not s.done and turn < s.rounds]
            watch = [m for m, s in enumerate(specs) if not s.done and self.slots[s.slot].held is not None and len(s.losses) < len(s.trees)]
            if not going and not watch:
                break
            roots = {m: Node() for m in going}
            sums = self._sums(state, {m: (roots[m], [0]) for m in going}, watch, turn)
            for m in watch:
                loss, n = sums.pop(-1 - m, (0.0, 0.0))
                s = specs[m]
                s.losses.append(loss / n if n else math.inf)
                if s.patience and len(s.losses) - s.best_round >= s.patience:
                    s.done = True
                    roots.pop(m, None)
            if not roots:
                break
            self._split_all(state, roots, sums, turn)
            for m, root in roots.items():
                specs[m].trees.append(root)
            if before is not None:  # this turn's passes have read the state, which no longer needs the one before
                before.unpersist()
            turn += 1
            before, state = state, self._state(state, turn - 1, turn) if turn % AGAIN else self._state(chunks, 0, turn)
        for d in (before, state):
            if d is not None:
                d.unpersist()
        return self._scored()

    def _split_all(self, state: RDD, roots: dict[int, Node], sums: dict, turn: int) -> None:
        """Split level after level; the sums of the roots are there already."""
        level = {m: [r] for m, r in roots.items()}
        depth = 0
        while level:
            nxt: dict[int, list[Node]] = {}
            for m, nodes in level.items():
                spec = self.specs[m]
                allowed = self._allowed(spec, turn)
                fold = self.folds.index(self.slots[spec.slot].fold)
                hist = sums.get(m)
                for i, node in enumerate(nodes):
                    h = hist[i] if hist is not None else np.zeros((len(self.columns), self.width, 2))
                    total = h[0].sum(axis=0)
                    node.cover = float(total[1])
                    node.value = float(spec.rate * _weight(*total, spec.penalty, node.low, node.high))
                    if depth < spec.depth and (found := best_split(h, [len(e) for e in self.edges[fold]], allowed, spec.penalty, spec.least, self.monotone, node.low, node.high)):
                        node.feature, node.cut, node.missing_left, middle, sides = found
                        way = self.monotone[node.feature]
                        node.children = [Node(low=node.low if way >= 0 else middle, high=node.high if way <= 0 else middle), Node(low=node.low if way <= 0 else middle, high=node.high if way >= 0 else middle)]
                        for child, (g, c) in zip(node.children, sides, strict=True):
                            child.cover, child.value = float(c), float(spec.rate * _weight(g, c, spec.penalty, child.low, child.high))
                        if depth + 1 < spec.depth:
                            nxt.setdefault(m, []).extend(node.children)
            depth += 1
            level = nxt
            if level:
                places = {}
                for m, nodes in level.items():
                    number = {id(x): k for k, x in enumerate(leaves(roots[m]))}
                    places[m] = (roots[m], [number[id(x)] for x in nodes])
                sums = self._sums(state, places, [], turn)

    def _allowed(self, spec: Spec, turn: int) -> np.ndarray:
        """Columns that the model's tree of this turn may split by."""
        out = np.ones(len(self.columns), bool)
        out[list(spec.banned)] = False
        own = np.flatnonzero(out)
        k = max(1, int(round(spec.colsample * len(own))))
        if k < len(own):
            out[:] = False
            out[np.random.default_rng([spec.seed, turn, 1]).choice(own, k, replace=False)] = True
        return out

    def _sums(self, state: RDD, places: dict[int, tuple[Node, list[int]]], watch: list[int], turn: int) -> dict:
        """Gradient sums (node, feature, bin, 2) of the given leaves of each model, and under -1 - m what m loses on held rows."""
        p, width = len(self.columns), self.width
        at_slot = {m: (s.slot, self.labels.index(self.slots[s.slot].y), self.folds.index(self.slots[s.slot].fold)) for m, s in enumerate(self.specs)}
        draws = {m: (self.specs[m].subsample, np.uint64(np.random.default_rng([self.specs[m].seed, turn, 2]).integers(1 << 62))) for m in places}

        def run(chunks):
            total = {m: np.zeros((2, p, len(leaf) * width), np.int64) for m, (_, leaf) in places.items()}
            lost = {m: np.zeros(2, np.int64) for m in watch}
            for ys, role, bins, hashed, count, margin in chunks:
                for m, (root, wanted) in places.items():
                    slot, label, fold = at_slot[m]
                    on = role[:, slot] == TRAIN
                    share, salt = draws[m]
                    if share < 1:
                        on &= _uniform(hashed, salt) < share
                    rows = np.flatnonzero(on)
                    if not len(rows):
                        continue
                    b = bins[fold][:, rows]
                    leaf = assign(root, b.T)
                    if wanted != list(range(int(leaf.max()) + 1)):
                        number = np.full(max(len(leaves(root)), 1), -1)
                        number[wanted] = np.arange(len(wanted))
                        leaf = number[leaf]
                        rows, b, leaf = rows[leaf >= 0], b[:, leaf >= 0], leaf[leaf >= 0]
                    prob = 1 / (1 + np.exp(-margin[m, rows]))
                    times = count[rows]
                    exact = times.sum() < 1 << 22  # then sums of the chunk are whole numbers that doubles hold
                    fixed = [np.rint(v * SCALE).astype(np.int64) * times for v in (prob - ys[rows, label], prob * (1 - prob))]
                    for j in range(p):
                        key = leaf * width + b[j] + 1
                        for k, v in enumerate(fixed):
                            if exact:
                                total[m][k, j] += np.bincount(key, v, total[m].shape[2]).astype(np.int64)
                            else:
                                np.add.at(total[m][k, j], key, v)
                for m in watch:
                    slot, label, _ = at_slot[m]
                    rows = np.flatnonzero(role[:, slot] == HELD)
                    prob = np.clip(1 / (1 + np.exp(-margin[m, rows])), 1e-15, 1 - 1e-15)
                    loss = -np.where(ys[rows, label] == 1, np.log(prob), np.log1p(-prob))
                    lost[m] += np.array([(np.rint(loss * SCALE).astype(np.int64) * count[rows]).sum(), count[rows].sum()], np.int64)
            yield from total.items()
            yield from ((-1 - m, x) for m, x in lost.items())

        got = added(state.mapPartitions(run))
        out: dict = {}
        for m in watch:
            loss, n = got.get(-1 - m, (0, 0))
            out[-1 - m] = (loss / SCALE, float(n))
        for m, (_, wanted) in places.items():
            dense = got.get(m, np.zeros((2, p, len(wanted) * width), np.int64))
            out[m] = np.ascontiguousarray((dense / SCALE).reshape(2, p, len(wanted), width).transpose(2, 1, 3, 0))
        return out

    def _state(self, source: RDD, since: int, turn: int) -> RDD:
        """Chunks with the margins (model, row) of all turns before this one: labels, roles, bins (fold, column, row), hashes, counts, margins.
        The source is the packed chunks (since 0), or the chunks as they were at the turn `since`."""
        p, n_folds, n_labels, n_slots, hashed = len(self.columns), len(self.edges), len(self.labels), len(self.slots), self.hashed
        base = np.array([s.base for s in self.specs], np.float64)
        fold_of = [self.folds.index(self.slots[s.slot].fold) for s in self.specs]
        trees = [(m, t, np.array([x.value for x in leaves(t)])) for m, s in enumerate(self.specs) for t in s.trees[since:turn]]

        def opened(r):
            raw = np.frombuffer(r["_row"], np.uint8).reshape(r["_n"], -1)
            a, b = n_labels, n_labels + n_slots
            c = b + 2 * n_folds * p
            bins = np.ascontiguousarray(raw[:, b:c]).view(np.int16).reshape(-1, n_folds, p)
            return (
                np.ascontiguousarray(raw[:, :a]).view(np.int8), np.ascontiguousarray(raw[:, a:b]).view(np.int8), np.ascontiguousarray(bins.transpose(1, 2, 0)),
                np.ascontiguousarray(raw[:, c:]).view(np.int64)[:, 0] if hashed else None, np.frombuffer(r["_count"], np.int64), np.repeat(base[:, None], len(raw), axis=1),
            )

        def run(chunks):
            for x in chunks:
                *rest, bins, drawn, count, margin = x if isinstance(x[-1], np.ndarray) else opened(x)
                margin = margin.copy()
                for m, tree, value in trees:
                    margin[m] += value[assign(tree, bins[fold_of[m]].T)]
                yield (*rest, bins, drawn, count, margin)

        return source.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)

    def _scored(self) -> DataFrame:
        """Keys, carried columns, roles and margins of every row, its trees added in their order; nothing runs yet."""
        cuts = self._cuts()
        models = [(s.base, self.folds.index(self.slots[s.slot].fold), [(t, np.array([x.value for x in leaves(t)])) for t in s.trees]) for s in self.specs]
        rows = self.rows.select(*self.keys, *self.carried, "_role", "_x")
        kept = [f for f in rows.schema.fields if f.name != "_x"]
        names = [*(f.name for f in kept), "_margin"]

        def run(batches):
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                bins = np.ascontiguousarray(_in_bins(batch.column("_x"), n, cuts).transpose(1, 2, 0))
                margin = np.empty((n, len(models)))
                for m, (base, fold, trees) in enumerate(models):
                    own = np.full(n, base)
                    for tree, value in trees:
                        own += value[assign(tree, bins[fold].T)]
                    margin[:, m] = own
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(models), pa.int32()), pa.array(margin.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), lists], names=names)

        return rows.mapInArrow(run, T.StructType([*kept, T.StructField("_margin", T.ArrayType(T.DoubleType()))]))

    def unwatched(self) -> Boosters:
        """An engine of the same rows that watches nothing: the number of trees is settled."""
        out = Boosters.__new__(Boosters)
        out.__dict__.update(self.__dict__, slots=[replace(s, held=None) for s in self.slots])
        return out

    def free(self) -> None:
        for d, _ in self.packed.values():
            d.unpersist()
        self.packed.clear()


def _uniform(hashed: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = hashed.view(np.uint64) ^ salt
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(11)) / float(1 << 53)


def _weight(g: float, h: float, penalty: float, low: float, high: float) -> float:
    return min(high, max(low, -g / (h + penalty)))


def best_split(h: np.ndarray, n_edges: list[int], allowed: np.ndarray, penalty: float, least: float, monotone: np.ndarray, low: float, high: float):
    """Feature, cut, side of missing values, the middle of both sides' values and both sides' sums; None where no split
    gains. h: (feature, bin, 2), bin 0 for missing values. Of equal gains the first by (feature, cut, missing left) is taken."""
    total = h[0].sum(axis=0)
    cuts = h.shape[1] - 2
    left = np.cumsum(h[:, 1:], axis=1)[:, :cuts, None, :] + np.stack([h[:, 0], np.zeros_like(h[:, 0])], axis=1)[:, None]
    right = total - left
    (gl, hl), (gr, hr) = (np.moveaxis(x, -1, 0) for x in (left, right))
    ok = (hl >= least) & (hr >= least) & (np.arange(1, cuts + 1)[None, :, None] <= np.array(n_edges)[:, None, None]) & allowed[:, None, None]
    ok[:, :, 1] &= h[:, 0].any(axis=1)[:, None]
    with np.errstate(all="ignore"):
        a, b = (np.clip(-g / (c + penalty), low, high) for g, c in ((gl, hl), (gr, hr)))
        score = lambda g, c, w: -(2 * g * w + (c + penalty) * w * w)
        gain = score(gl, hl, a) + score(gr, hr, b) - score(*total, _weight(*total, penalty, low, high))
    ok &= monotone[:, None, None] * (b - a) >= 0
    gain = np.where(ok, gain, -np.inf)
    at = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[at] > 1e-12:
        return None
    f, cut, side = at
    return int(f), int(cut) + 1, side == 0, float((a[at] + b[at]) / 2), (tuple(left[at]), tuple(right[at]))


# choice of parameters

#: What a grid point does not name.
DEFAULT = {"depth": 3, "k_events": 1.0, "colsample": 1.0, "subsample": 1.0}


def logit(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass
class Search:
    """What a search over the rotations leaves: the engine with its packed rows, where each (fold, label)'s slots begin, rows of every slot,
    models of a slot at a point, and the record."""

    engine: Boosters
    first: dict
    counts: list[dict]
    spec: Callable[..., Spec]
    record: dict


def search_trees(df: DataFrame, columns: list[str], plan: dict, grid: list[dict], keys: list[str], starts: dict[str, str] | None = None, rate: float = 0.05, rounds: int = 100, patience: int = 10, penalty: float = 1.0, bins: int = 32, monotone: dict[str, int] | None = None, seed: int = 0, carried: list[str] | None = None, counts: list[dict] | None = None, chunks: RDD | None = None, among: list[str] | None = None) -> Search:
    """The choice of tune_trees without its refit; the caller frees the engine. Packed rows of the plan's slots and of the columns `among` may be given."""
    named = [k for k in DEFAULT if any(k in point for point in grid)]
    grid = [{k: point.get(k, DEFAULT[k]) for k in named} for point in grid]
    folds = list(dict.fromkeys(f for f, _ in plan))
    trains = [_any([e["whole"].train for (g, _), e in plan.items() if g == f]) for f in folds]
    slots, first = plan_slots(plan)
    counts = counts or slot_counts(df, slots, starts)
    viable = lambda c, held: 0 < c["p"] < c["n"] and (not held or 0 < c["q"] < c["m"])

    def spec(i: int, point: dict, **more) -> Spec:
        c = counts[i]
        p0 = c["p"] / c["n"]
        q = DEFAULT | point
        least = q["k_events"] * (c["p"] / max(1, c["runs"])) * p0 * (1 - p0)
        return Spec(i, depth=q["depth"], least=least, rate=rate, penalty=penalty, colsample=q["colsample"], subsample=q["subsample"], base=logit(p0), **more)

    edges = None
    if chunks is not None:
        pick, wholes = [(among or columns).index(c) for c in columns], [[first[at] for at in plan if at[0] == f] for f in folds]
        edges = edges_of(chunks.map(lambda x: (np.stack([(x[0][:, w] == TRAIN).any(axis=1) for w in wholes], axis=1), x[2][:, pick])), len(folds), len(columns), bins)
    engine = Boosters(df, columns, slots, folds, trains, keys, bins, monotone, carried, edges)
    tried = []
    for at, entry in plan.items():
        for k, point in enumerate(grid):
            for r in range(len(entry["rotations"])):
                i = first[at] + 1 + r
                if viable(counts[i], True):
                    tried.append((at, k, r, spec(i, point, rounds=rounds, patience=patience, seed=seed + 1000 * k + r)))
    record = {at: {"fold": at[0], "label": at[1], "blocked": bool(entry.get("blocked")), "grid": []} for at, entry in plan.items()}
    if tried:
        engine.grow([s for *_, s in tried])
    for at, entry in record.items():
        for k, point in enumerate(grid):
            mine = [s for a, j, _, s in tried if a == at and j == k]
            if mine:
                m = int(np.median([s.best_round for s in mine]))
                score = float(np.mean([s.losses[min(m, len(s.losses)) - 1] for s in mine]))
                entry["grid"].append({**point, "M": m, "score": score, "rounds": [s.best_round for s in mine]})
        if not entry["grid"] or not viable(counts[first[at]], False):
            entry["skipped"] = "no rotation with both classes" if not entry["grid"] else "training rows of one class"
            continue
        best = min(entry["grid"], key=lambda x: x["score"])
        entry["chosen"] = {k: v for k, v in best.items() if k not in ("M", "score", "rounds")}
        entry["M"], entry["ceiling"] = best["M"], best["M"] >= rounds
        entry["edges"] = {k: len(vs := {g[k] for g in grid}) > 1 and best[k] in (min(vs), max(vs)) for k in entry["chosen"]}
    return Search(engine, first, counts, spec, record)


def tune_trees(df: DataFrame, columns: list[str], plan: dict, grid: list[dict], keys: list[str], starts: dict[str, str] | None = None, rate: float = 0.05, rounds: int = 100, patience: int = 10, penalty: float = 1.0, bins: int = 32, monotone: dict[str, int] | None = None, seed: int = 0, carried: list[str] | None = None, counts: list[dict] | None = None):
    """Boosted arms tuned inside each fold.

    `plan` maps (fold, label) to {"whole": Slot, "rotations": [Slot, ...], "blocked": bool}. Each grid point (depth, k_events, colsample,
    subsample; all optional) is grown on every rotation with both classes on both sides, until what it holds out stops
    improving; all folds, labels, rotations and points together. A point's number of trees M is the whole part of the median of its
    rotations' best rounds, and its loss the mean of theirs at M, or at their last round. The winner is then refitted
    with M trees on the whole fold, and on every rotation for scores of rows that it did not see; again all together.
    Least leaf weights are k_events times the positives per event times p (1 - p), from the slot's own rows.

    Returns (margins, oof, record, models): margins (keys, model_fold, label, margin) by each fold's own model for all rows; oof (keys, model_fold, label,
    rotation, margin) for rows that a rotation held out; a record for each (fold, label), with "skipped" where no rotation
    has both classes; the fitted models by (fold, label). Both tables have the `carried` columns too. Margins are of rows as they are: roles decide what is trained on only.
    """
    found = search_trees(df, columns, plan, grid, keys, starts, rate, rounds, patience, penalty, bins, monotone, seed, carried, counts)
    state, final = refit_trees(found, plan, seed)
    if state is not None:
        state = settle(state)
    engine = found.engine
    engine.free()
    if not final:
        return None, None, list(found.record.values()), {}
    margins, oof = spread(state, [*keys, *engine.carried], [(at, r) for at, r, _ in final], plan, found.first)
    return margins, oof, list(found.record.values()), tree_models(found, final)


def refit_trees(found: Search, plan: dict, seed: int = 0) -> tuple[DataFrame | None, list[tuple]]:
    """What a search chose, grown on the whole folds and on the rotations: margins of all rows, of which nothing has run yet, and the models as
    ((fold, label), rotation or None, spec)."""
    engine, first, counts, spec, record = found.engine, found.first, found.counts, found.spec, found.record
    final = []
    for at, entry in record.items():
        if "chosen" in entry:
            final.append((at, None, spec(first[at], entry["chosen"], rounds=entry["M"], seed=seed + 1)))
            for r, slot in enumerate(plan[at]["rotations"]):
                if 0 < counts[first[at] + 1 + r]["p"] < counts[first[at] + 1 + r]["n"]:
                    final.append((at, slot.name, spec(first[at] + 1 + r, entry["chosen"], rounds=entry["M"], seed=seed + 2 + r)))
    return (engine.unwatched().grow([s for *_, s in final]) if final else None), final


def tree_models(found: Search, final: list[tuple]) -> dict:
    return {at: (found.engine.edges[found.engine.folds.index(at[0])], s) for at, r, s in final if r is None}


def ablate_trees(df: DataFrame, columns: list[str], plan: dict, record: list[dict], blocks: dict[str, list[str]], keys: list[str], starts: dict[str, str] | None = None, rate: float = 0.05, penalty: float = 1.0, bins: int = 32, monotone: dict[str, int] | None = None, seed: int = 0, carried: list[str] | None = None, search: Search | None = None) -> DataFrame | None:
    """Margins of tuned arms refitted without each block of columns, at the point and number of trees that the fold chose: a second search
    would mix the block's loss with another selection. All folds, labels and blocks are grown together. Blocks that
    share no column with the arm, or leave none, are no ablation and absent. The engine of a search over the same rows and plan is used where it is
    given. Rows (keys, model_fold, label, block, margin), of all rows of df."""
    folds = list(dict.fromkeys(f for f, _ in plan))
    slots = [replace(e["whole"], held=None) for e in plan.values()]
    first = search.first if search else {at: i for i, at in enumerate(plan)}
    counts = search.counts if search else slot_counts(df, slots, starts)
    specs, names = [], []
    for at in plan:
        i = first[at]
        chosen = next((r for r in record if (r["fold"], r["label"]) == at and "chosen" in r), None)
        if chosen is None:
            continue
        q, c = DEFAULT | chosen["chosen"], counts[i]
        p0 = c["p"] / c["n"]
        for name, cols in blocks.items():
            banned = tuple(k for k, c_ in enumerate(columns) if c_ in cols)
            if banned and len(banned) < len(columns):
                specs.append(Spec(i, depth=q["depth"], least=q["k_events"] * (c["p"] / max(1, c["runs"])) * p0 * (1 - p0), rounds=chosen["M"], rate=rate, penalty=penalty, colsample=q["colsample"], subsample=q["subsample"], seed=seed + 1, base=logit(p0), banned=banned))
                names.append((*at, name))
    if not specs:
        return None
    engine = search.engine.unwatched() if search else Boosters(df, columns, slots, folds, [_any([s.train for s in slots if s.fold == f]) for f in folds], keys, bins, monotone, carried)
    state = engine.grow(specs)
    engine.free()
    each = F.array(*[F.struct(F.lit(f).alias("model_fold"), F.lit(y).alias("label"), F.lit(b).alias("block"), F.col("_margin")[m].alias("margin")) for m, (f, y, b) in enumerate(names)])
    kept = [*keys, *engine.carried]
    return state.select(*kept, F.explode(each).alias("x")).select(*kept, "x.*")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


# linear models: moments and Newton steps of all slots and parameters in shared passes


def _arrays(df: DataFrame, columns: list[str], slots: list[Slot], kept: list[str] | None = None, starts: dict[str, str] | None = None) -> DataFrame:
    """Rows as arrays: labels, roles in every slot, values (NaN where they are missing), which of them are missing, and where runs start."""
    labels = dict.fromkeys(s.y for s in slots)
    up = [starts[y] if starts else y for y in labels]
    x = [F.col(c).cast("double") for c in columns]
    return df.select(
        *(kept or []), F.array(*[F.coalesce(F.col(y).cast("double"), F.lit(0.0)) for y in labels]).alias("_y"), F.array(*[_role(s) for s in slots]).alias("_role"),
        F.array(*[F.coalesce(v, F.lit(math.nan)) for v in x]).alias("_x"), F.array(*[v.isNull() for v in x]).alias("_null"),
        F.array(*[F.coalesce(F.col(c).cast("tinyint"), F.lit(0).cast("tinyint")) for c in up]).alias("_up"),
    )


def pack_rows(df: DataFrame, columns: list[str], slots: list[Slot], starts: dict[str, str] | None = None) -> RDD:
    """Roles, labels, values, missing values and starts of runs of all rows in packed chunks, for all that passes over them."""
    return packed(_arrays(df, columns, slots, None, starts), {"_role": np.int8, "_y": np.float64, "_x": np.float64, "_null": np.bool_, "_up": np.int8})


def packed_counts(chunks: RDD, slots: list[Slot]) -> list[dict]:
    """slot_counts of packed rows."""
    labels = list(dict.fromkeys(s.y for s in slots))
    at = np.array([labels.index(s.y) for s in slots], int)

    def run(parts):
        total = np.zeros((5, len(at)), np.int64)
        for role, y, _, _, up in parts:
            total += _tally(role, y.astype(np.int64), up, at)
        yield 0, total

    return _counts(added(chunks.mapPartitions(run)).get(0, np.zeros((5, len(slots)), np.int64)))


class Designs:
    """Rows as arrays for linear models of many slots. Missing values take the median of the slot's training rows, and
    every column has an indicator of them; both are standardised by the slot's training rows, and a column that does not vary there is 0.
    Packed rows of these slots and of more columns (`among`) may be given."""

    def __init__(self, df: DataFrame, columns: list[str], slots: list[Slot], keys: list[str] | None = None, carried: list[str] | None = None, chunks: RDD | None = None, among: list[str] | None = None):
        self.columns, self.slots, self.keys = columns, slots, [*(keys or []), *(carried or [])]
        self.labels = list(dict.fromkeys(s.y for s in slots))
        self.label_of = [self.labels.index(s.y) for s in slots]
        self.rows = _arrays(df, columns, slots, self.keys)
        self.pick, self.own = [(among or columns).index(c) for c in columns], chunks is None
        self.chunks = pack_rows(df, columns, slots) if chunks is None else chunks
        pick = self.pick
        medians = order_statistics(self.chunks.map(lambda x: (x[0] == TRAIN, x[2][:, pick])), len(slots), len(columns), [0.5])[:, :, 0]
        self.medians = np.where(np.isnan(medians), 0.0, medians)
        self.known: dict[int, dict[int, np.ndarray]] = {}

    def free(self) -> None:
        if self.own:
            self.chunks.unpersist()

    def _total(self, each, shape: dict[int, tuple[int, ...]]) -> dict[int, np.ndarray]:
        """Sums over all rows of what each(role, y, x) yields as (index, array)."""

        pick = self.pick

        def run(chunks):
            total: dict[int, np.ndarray] = {}
            for role, y, x, *_ in chunks:
                for m, part in each(role, y, x[:, pick]):
                    total[m] = total[m] + part if m in total else part
            yield from total.items()

        got = added(self.chunks.mapPartitions(run))
        return {m: got[m].reshape(s) if m in got else np.zeros(s) for m, s in shape.items()}

    def moments(self, role: int) -> dict[int, np.ndarray]:
        """Second moments of (1, columns, indicators, y) over each slot's rows of a role, taken once."""
        if role in self.known:
            return self.known[role]
        medians, label_of = self.medians, self.label_of
        q = 2 * len(self.columns) + 2

        def each(roles, ys, x):
            for i, label in enumerate(label_of):
                rows = roles[:, i] == role
                if rows.any():
                    z = np.concatenate([np.ones((rows.sum(), 1)), raw_design(x[rows], medians[i]), ys[rows, label][:, None]], axis=1)
                    yield i, z.T @ z

        self.known[role] = self._total(each, {i: (q, q) for i in range(len(label_of))})
        return self.known[role]

    def standards(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and deviations of the design's columns in each slot; a deviation of 0 marks one that does not vary."""
        m = np.stack([x for _, x in sorted(self.moments(TRAIN).items())])
        n = np.maximum(m[:, 0, 0], 1)[:, None]
        mean = m[:, 0, 1:-1] / n
        var = np.diagonal(m, axis1=1, axis2=2)[:, 1:-1] / n - mean**2
        scale = np.sqrt(np.maximum(var, 0))
        return mean, np.where(scale > 1e-9 * np.maximum(1, np.abs(mean)), scale, 0.0)


    def scored(self, final: list[tuple], mean: np.ndarray, scale: np.ndarray, plan: dict, first: dict) -> tuple[DataFrame, DataFrame]:
        """Margins of all rows by the models of whole folds, and of held rows by those of rotations; final: ((fold, label), rotation,
        slot, coefficients, shift)."""
        kept, medians = [self.rows.schema[k] for k in self.keys], self.medians
        picks = [x[2:] for x in final]

        def run(batches):
            for batch in batches:
                n = batch.num_rows
                if n:
                    x = _matrix(batch.column("_x"), n)
                    margin = np.stack([design(x, medians[i], mean[i], scale[i]) @ t - s for i, t, s in picks], axis=1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(picks), pa.int32()), pa.array(margin.ravel()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c.name) for c in kept), batch.column("_role"), lists], names=[*(c.name for c in kept), "_role", "_margin"])

        schema = T.StructType([*kept, self.rows.schema["_role"], T.StructField("_margin", T.ArrayType(T.DoubleType()))])
        return spread(self.rows.mapInArrow(run, schema), self.keys, [x[:2] for x in final], plan, first)


@dataclass
class Linear:
    """A fitted linear model over raw columns: what a missing value becomes, and coefficients by column and indicator."""

    columns: list[str]
    medians: list[float]
    mean: list[float]
    scale: list[float]
    theta: list[float]
    shift: float

    @classmethod
    def of(cls, d: Designs, columns: list[str], slot: int, theta: np.ndarray, shift: float, mean: np.ndarray, scale: np.ndarray) -> Linear:
        return cls(list(columns), *(list(map(float, v)) for v in (d.medians[slot], mean[slot], scale[slot], theta)), float(shift))

    def parts(self) -> dict[str, Column]:
        """What each column, with its indicator, adds to the margin."""
        p, out = len(self.columns), {}
        for j, c in enumerate(self.columns):
            out[c] = F.lit(0.0)
            for k, v in ((j, F.coalesce(F.col(c).cast("double"), F.lit(self.medians[j]))), (p + j, F.col(c).isNull().cast("double"))):
                if self.scale[k] > 0:
                    out[c] = out[c] + (v - self.mean[k]) / self.scale[k] * self.theta[1 + k]
        return out

    def margin(self) -> Column:
        return sum(self.parts().values(), F.lit(self.theta[0] - self.shift))


def raw_design(x: np.ndarray, medians: np.ndarray) -> np.ndarray:
    missing = np.isnan(x)
    return np.concatenate([np.where(missing, medians, x), missing.astype(float)], axis=1)


def design(x: np.ndarray, medians: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised columns and indicators after a column of ones."""
    z = (raw_design(x, medians) - mean) / np.where(scale > 0, scale, 1.0) * (scale > 0)
    return np.concatenate([np.ones((len(x), 1)), z], axis=1)


def varying(x: np.ndarray, medians: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The ones and those standardised columns and indicators of (column, row) that vary, as rows."""
    p, use = len(x), np.flatnonzero(scale > 0)
    z = np.ones((1 + len(use), x.shape[1]))
    for k, j in enumerate(use):
        missing = np.isnan(x[j % p])
        z[1 + k] = ((np.where(missing, medians[j], x[j]) if j < p else missing) - mean[j]) / scale[j]
    return z


@dataclass
class Ridge:
    """One penalised logistic model: penalty 1 / c on all but the intercept, classes weighted alike or balanced."""

    slot: int
    c: float = 1.0
    balanced: bool = False
    weights: tuple[float, float] = (1.0, 1.0)  # of y = 0 and y = 1
    theta: np.ndarray | None = None
    freedom: float = 0.0
    steps: int = 0

    @property
    def shift(self) -> float:
        return math.log(self.weights[1] / self.weights[0])


def fit_ridges(d: Designs, models: list[Ridge], tolerance: float = 1e-8, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps of all models together until each stands still; returns the slots' means and deviations. A step is halved
    where it would raise the loss."""
    mean, scale = d.standards()
    q = 2 * len(d.columns) + 1
    active = {m for m in range(len(models))}
    for m in models:
        m.theta = np.zeros(q)
    last: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    medians, label_of = d.medians, d.label_of
    for _ in range(most):
        todo = sorted(active)
        by_slot: dict[int, list[int]] = {}
        for m in todo:
            by_slot.setdefault(models[m].slot, []).append(m)
        at = {i: (ms, np.stack([models[m].theta for m in ms], axis=1), np.array([models[m].weights for m in ms])) for i, ms in by_slot.items()}

        def each(roles, ys, x, at=at):
            for i, (ms, theta, w) in at.items():
                rows = np.flatnonzero(roles[:, i] == TRAIN)
                if not len(rows):
                    continue
                use = np.append(0, 1 + np.flatnonzero(scale[i] > 0))  # other columns are 0
                z, y = varying(x[rows].T, medians[i], mean[i], scale[i]), ys[rows, label_of[i]]
                eta = theta[use].T @ z
                e = np.exp(-np.abs(eta))
                p = np.where(eta >= 0, 1, e) / (1 + e)
                wt = np.where(y == 1, w[:, 1:], w[:, :1])
                loss = (wt * (np.log1p(e) + np.maximum(eta, 0) - y * eta)).sum(axis=1)
                grad, curved = (wt * (p - y)) @ z.T, wt * p * (1 - p)
                a, b = np.triu_indices(len(use))
                upper = curved @ (z[a] * z[b]).T  # all models' second derivatives at once
                for k, m in enumerate(ms):
                    out = np.zeros((q + 2, q))
                    out[use[a], use[b]] = out[use[b], use[a]] = upper[k]
                    out[q, use], out[q + 1] = grad[k], loss[k]
                    yield m, out

        got = d._total(each, {m: (q + 2, q) for m in todo})
        for m in todo:
            model = models[m]
            penalty = np.full(q, 1 / model.c)
            penalty[0] = 0
            hess, grad, loss = got[m][:q], got[m][q] + penalty * model.theta, got[m][q + 1, 0] + (penalty * model.theta**2).sum() / 2
            if m in last and loss > last[m][0] + 1e-9 * abs(last[m][0]):
                _, theta, step = last[m]
                last[m] = (last[m][0], theta, step / 2)
                model.theta = theta - step / 2
                continue
            eigen = np.linalg.eigvalsh(hess[1:, 1:])
            model.freedom = float((np.maximum(eigen, 0) / (np.maximum(eigen, 0) + 1 / model.c)).sum())
            fixed = np.diag(hess) + penalty <= 1e-12  # columns that do not vary
            step = np.zeros(q)
            step[~fixed] = np.linalg.solve((hess + np.diag(penalty))[np.ix_(~fixed, ~fixed)], grad[~fixed])
            last[m] = (loss, model.theta, step)
            model.theta = model.theta - step
            model.steps += 1
            if np.abs(step).max() < tolerance:
                active.discard(m)
        if not active:
            return mean, scale
    raise RuntimeError(f"{len(active)} linear models do not stand still after {most} steps")


def held_losses(d: Designs, models: list[Ridge], mean: np.ndarray, scale: np.ndarray) -> list[float]:
    """Mean log-loss of each model on its slot's held rows, its balanced weights taken back; infinite where there are none."""
    medians, label_of = d.medians, d.label_of
    todo = [(m.slot, m.theta, m.shift) for m in models]
    by_slot: dict[int, list[int]] = {}
    for k, m in enumerate(models):
        by_slot.setdefault(m.slot, []).append(k)

    def each(roles, ys, x):
        for i, ks in by_slot.items():
            rows = roles[:, i] == HELD
            if rows.any():
                z, y = design(x[rows], medians[i], mean[i], scale[i]), ys[rows, label_of[i]]
                for k in ks:
                    p = np.clip(1 / (1 + np.exp(-(z @ todo[k][1] - todo[k][2]))), 1e-12, 1 - 1e-12)
                    yield k, np.array([-np.where(y == 1, np.log(p), np.log1p(-p)).sum(), rows.sum()])

    got = d._total(each, {k: (2,) for k in range(len(todo))})
    return [float(got[k][0] / got[k][1]) if got[k][1] else math.inf for k in range(len(todo))]


def tune_ridges(df: DataFrame, columns: list[str], plan: dict, cs: list[float], keys: list[str], weighting: str = "measure", designs: Designs | None = None, counts: list[dict] | None = None):
    """Linear arms tuned inside each fold, all folds, labels, rotations, penalties and weightings together.

    Balanced class weights are taken where they lower the rotations' mean log-loss at the middle of the grid
    (`weighting` "measure"), always ("balanced") or never ("none"); then C of the least loss, the smaller of equal ones. The plan, and
    what comes back, is as in tune_trees; a record has the curve, the effective freedom and whether C is at an end.
    Designs and counts of the plan's slots may be given; designs have the keys and carried columns then."""
    slots, first = plan_slots(plan)
    counts, d = counts or slot_counts(df, slots), designs or Designs(df, columns, slots, keys)
    final, record, mean, scale = rate_ridges(d, plan, cs, weighting, counts)
    margins, oof = d.scored(final, mean, scale, plan, first) if final else (None, None)
    designs or d.free()
    return margins, oof, record, linear_models(d, columns, final, mean, scale)


def linear_models(d: Designs, columns: list[str], final: list[tuple], mean: np.ndarray, scale: np.ndarray) -> dict:
    return {at: Linear.of(d, columns, i, theta, shift, mean, scale) for at, r, i, theta, shift in final if r is None}


def rate_ridges(d: Designs, plan: dict, cs: list[float], weighting: str, counts: list[dict]) -> tuple[list[tuple], list[dict], np.ndarray | None, np.ndarray | None]:
    """The choice of tune_ridges without scores: models ((fold, label), rotation or None, slot, coefficients, shift), the record, and the slots'
    means and deviations."""
    first = plan_slots(plan)[1]
    ways = {"measure": (False, True), "balanced": (True,), "none": (False,)}[weighting]
    models, index = [], {}
    for i, c in enumerate(counts):
        if 0 < c["p"] < c["n"]:
            for w in ways:
                for value in cs:
                    index[i, w, value] = len(models)
                    models.append(Ridge(i, value, w, (c["n"] / (2 * (c["n"] - c["p"])), c["n"] / (2 * c["p"])) if w else (1.0, 1.0)))
    record = {at: {"fold": at[0], "label": at[1], "blocked": bool(entry.get("blocked"))} for at, entry in plan.items()}
    if not models:
        for entry in record.values():
            entry["skipped"] = "training rows of one class"
        return [], list(record.values()), None, None
    mean, scale = fit_ridges(d, models)
    losses = held_losses(d, models, mean, scale)
    final, chosen = [], {}
    for at, entry in record.items():
        rotations = [first[at] + 1 + r for r in range(len(plan[at]["rotations"])) if 0 < counts[first[at] + 1 + r]["q"] < counts[first[at] + 1 + r]["m"]]
        rate = lambda w, c: [losses[index[i, w, c]] for i in rotations if (i, w, c) in index]  # noqa: B023, E731
        mean_loss = lambda w, c: float(np.mean(x)) if (x := rate(w, c)) else math.inf  # noqa: B023, E731
        middle = cs[len(cs) // 2]
        balanced = ways[0] if len(ways) == 1 else mean_loss(True, middle) < mean_loss(False, middle)
        curve = {c: mean_loss(balanced, c) for c in cs}
        if (first[at], balanced, cs[0]) not in index or min(curve.values()) == math.inf:
            entry["skipped"] = "training rows of one class" if (first[at], balanced, cs[0]) not in index else "no rotation with both classes"
            continue
        c = min(cs, key=lambda v: (curve[v], v))  # noqa: B023
        one = models[index[first[at], balanced, c]]
        entry |= {"chosen": {"C": c, "balanced": balanced}, "grid": [{"C": v, "score": s} for v, s in curve.items()], "edges": {"C": len(cs) > 1 and c in (min(cs), max(cs))}, "freedom": one.freedom, "freedom_at_ends": [models[index[first[at], balanced, v]].freedom for v in (cs[0], cs[-1])]}
        chosen[at] = one
        final.append((at, None, one))
        for r, s in enumerate(plan[at]["rotations"]):
            if (first[at] + 1 + r, balanced, c) in index:
                final.append((at, s.name, models[index[first[at] + 1 + r, balanced, c]]))
    return [(at, r, m.slot, m.theta, m.shift) for at, r, m in final], list(record.values()), mean, scale


def spread(state: DataFrame, keys: list[str], names: list[tuple], plan: dict, first: dict) -> tuple[DataFrame, DataFrame]:
    """Rows with `_role` and `_margin` of several models, as a row per model: those of whole folds for all rows, and those of
    rotations for the rows that they held out."""
    each: dict[bool, list[Column]] = {True: [], False: []}
    for m, (at, r) in enumerate(names):
        slot = first[at] + 1 + [s.name for s in plan[at]["rotations"]].index(r) if r is not None else first[at]
        each[r is None].append(F.struct(F.lit(at[0]).alias("model_fold"), F.lit(at[1]).alias("label"), F.lit(r).cast("string").alias("rotation"), F.col("_margin")[m].alias("margin"), F.col("_role")[slot].alias("role")))
    none = [x.withField("role", F.lit(NONE).cast("tinyint")) for x in each[True][:1]]  # where no rotation was fitted
    whole, held = (state.select(*keys, F.explode(F.array(*x)).alias("x")).select(*keys, "x.*") for x in (each[True], each[False] or none))
    return whole.drop("rotation", "role"), held.where(F.col("rotation").isNotNull() & (F.col("role") == HELD)).drop("role")


def krylov(s: np.ndarray, c: np.ndarray, most: int) -> list[np.ndarray]:
    """Coefficients of partial least squares with 1, 2, ... components from centred cross-products, each from the one before."""
    beta, left, basis, out = np.zeros(len(c)), c.copy(), [], []
    for _ in range(most):
        if np.linalg.norm(left) < 1e-12 * max(np.linalg.norm(c), 1e-300):
            break
        w = left / np.linalg.norm(left)
        for _ in range(2):  # twice, for rounding
            for b in basis:
                w = w - b * (b @ s @ w) / (b @ s @ b)
        if w @ s @ w <= 0:
            break
        beta = beta + w * ((w @ c) / (w @ s @ w))
        left = c - s @ beta
        basis.append(w)
        out.append(beta)
    return out


def _components(slots: list[Slot], train: dict, held: dict, mean: np.ndarray, scale: np.ndarray, most: int) -> tuple[list[list[np.ndarray]], list[dict]]:
    """Coefficients by slot and k, over all standardised columns, and the curve of their correlations."""
    betas, out = [], []
    for i, slot in enumerate(slots):
        betas.append([])
        use = np.flatnonzero(scale[i] > 0)
        if not len(use) or train[i][0, 0] < 2:
            continue
        parts = []
        for m in (train[i], held[i]):
            n = max(m[0, 0], 1)
            mu = m[0, 1:] / n
            unit = np.append(np.where(scale[i] > 0, scale[i], 1.0), 1)
            cov = (m[1:, 1:] / n - np.outer(mu, mu)) / np.outer(unit, unit)
            parts.append((cov[np.ix_(use, use)], cov[use, -1], cov[-1, -1]))
        for k, beta in enumerate(krylov(parts[0][0], parts[0][1], min(most, len(use)))):
            r = [float(beta @ c / math.sqrt(v * y)) if (v := float(beta @ s @ beta)) > 1e-18 and y > 1e-18 else None for s, c, y in parts]
            out.append({"fold": slot.fold, "rotation": slot.name, "label": slot.y, "k": k + 1, "r_model": r[0], "r_check": r[1]})
            full = np.zeros(len(scale[i]))
            full[use] = beta
            betas[-1].append(full)
    return betas, out


def component_curve(df: DataFrame, columns: list[str], slots: list[Slot], most: int) -> list[dict]:
    """Correlation of score and outcome of every slot for k = 1, 2, ... components, on the rows it was fitted to (r_model) and
    on those it held out (r_check); null where a score is constant. Everything comes from second moments of both sets of rows, taken
    in a pass each for all slots; no k is fitted by itself. Columns are standardised, with indicators of missing values."""
    d = Designs(df, columns, slots)
    train, held = d.moments(TRAIN), d.moments(HELD)
    mean, scale = d.standards()
    d.free()
    return _components(slots, train, held, mean, scale, most)[1]


def choose_k(curve: list[dict]) -> dict:
    """For each (fold, label) the number of components of the greatest mean r_check over rotations, the smallest of equal ones."""
    by: dict = {}
    for r in curve:
        if r["r_check"] is not None:
            by.setdefault((r["fold"], r["label"]), {}).setdefault(r["k"], []).append(r["r_check"])
    return {at: max(sorted(ks), key=lambda k, ks=ks: (round(float(np.mean(ks[k])), 12), -k)) for at, ks in by.items()}


def tune_components(df: DataFrame, columns: list[str], plan: dict, most: int, keys: list[str], designs: Designs | None = None):
    """Partial least squares arms with k of the greatest mean correlation on held rows, all folds, labels, rotations and k from the
    same moments. The plan, and what comes back, is as in tune_trees; margins are scores on the scale of the outcome."""
    slots, first = plan_slots(plan)
    d = designs or Designs(df, columns, slots, keys)
    final, record, mean, scale = rate_components(d, plan, most)
    margins, oof = d.scored(final, mean, scale, plan, first) if final else (None, None)
    designs or d.free()
    return margins, oof, record, linear_models(d, columns, final, mean, scale)


def rate_components(d: Designs, plan: dict, most: int) -> tuple[list[tuple], list[dict], np.ndarray, np.ndarray]:
    """The choice of tune_components without scores, as rate_ridges has it."""
    slots, first = plan_slots(plan)
    train, held = d.moments(TRAIN), d.moments(HELD)
    mean, scale = d.standards()
    betas, curve = _components(slots, train, held, mean, scale, most)
    best, final, record = choose_k(curve), [], []
    for at, entry in plan.items():
        said = {"fold": at[0], "label": at[1], "blocked": bool(entry.get("blocked")), "grid": [r for r in curve if (r["fold"], r["label"]) == at and r["rotation"] != entry["whole"].name]}
        record.append(said)
        k = best.get(at)
        if k is None or k > len(betas[first[at]]):
            said["skipped"] = "no number of components can be rated"
            continue
        said |= {"chosen": {"k": k}, "edges": {"k": most > 1 and k in (1, most)}}
        for r, s in enumerate([entry["whole"], *entry["rotations"]]):
            i = first[at] + r
            if len(betas[i]) >= k:
                final.append((at, s.name if r else None, i, np.concatenate([[train[i][0, -1] / train[i][0, 0]], betas[i][k - 1]]), 0.0))
    return final, record, mean, scale
