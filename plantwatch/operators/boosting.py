"""Histogram boosting for several classes: trees grown best first from gradient sums per bin.

A round grows one tree per class, up to `leaves`. Of two nodes below a cut only the one of fewer
rows is added up; the other's sums are those of the node above less these. Gradients are whole
numbers of 2**-20, so sums don't depend on the order of rows or tasks, and both ways of growing
give the same trees:

- Up to `WHOLE` rows, a task holds all rows of a model (in cross-validation, of a fold's model) and
  runs `keep_rounds` rounds in one job. Rounds need each other's scores, and a job for each level
  of each round would take far longer than the sums.
- With more rows, a level is one Spark job for all trees of the round: each task adds its rows'
  gradients up per (tree, node, feature, bin), one shuffle merges the sums, with those of the level
  above, and the best cut of each node comes back, never a row. Levels are computed ahead of the
  order of cuts, but only below cuts that it takes as far as is known, so a level never has more
  than 2 * `leaves` nodes. The trees of all folds grow in the same jobs.

Rows go in blocks of arrays, as elements of an RDD, which spares planning a query per job. Scores
are kept from job to job and written out every few rounds (`STORED_JOBS`, `keep_rounds`), so a lost
executor costs at most those rounds. Rounds end when the loss of the rows set aside hasn't fallen
for `patience` rounds.
"""

from __future__ import annotations

import json
import pickle
import sys
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantwatch.session import forget, remove, stored

# Tasks get this code by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = float(1 << 20)
CHUNK = 1 << 16  # rows of a block: a task adds them up at once
SMALL = 1 << 14  # rows that a task with whole models adds up at once: they stay in the cache
WHOLE = 5_000_000  # rows up to which a task holds a whole model's (some 100 bytes each); with more, trees grow by levels
STORED_JOBS = 5  # jobs of whole models after which their scores are written out


@dataclass(frozen=True)
class Boosting:
    # The declared candidate and the defaults it implies.
    depth: int = 8
    rate: float = 0.08
    rounds: int = 350
    leaves: int = 31
    leaf_rows: int = 20
    bins: int = 255
    least_hessian: float = 1e-3
    aside_percent: int = 10   # rows by whose loss the rounds end
    patience: int = 10
    tolerance: float = 1e-7
    seed: int = 42
    classes: int = 3
    keep_rounds: int = 10     # rounds after which scores are written out


@dataclass
class Tree:
    """Nodes in arrays: a cut sends bins up to `cut` to the left; a leaf has feature -1."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, a, a + 1
        for v in values:
            for column, new in zip((self.feature, self.cut, self.left, self.right, self.value), (-1, 0, 0, 0, v)):
                column.append(new)
        return a, a + 1

    def places(self, columns: np.ndarray, rows: np.ndarray, wanted: set[int]):
        """(node, its rows) for every wanted node; rows are dealt on from cut to cut, on the ways to these nodes only."""
        ways = set(wanted)
        for n in range(len(self.feature) - 1, -1, -1):  # a node comes before those below it
            if self.feature[n] >= 0 and (self.left[n] in ways or self.right[n] in ways):
                ways.add(n)
        held = [(0, rows)]
        while held:
            node, rows = held.pop()
            if node not in ways or not len(rows):
                continue
            if node in wanted:
                yield node, rows
            f = self.feature[node]
            if f >= 0:
                left = columns[f].take(rows) <= self.cut[node]
                held += [(n, rows[side]) for n, side in ((self.left[node], left), (self.right[node], ~left)) if n in ways]

    def added(self, columns: np.ndarray) -> np.ndarray:
        """The value of the leaf of each row; columns are features x rows."""
        out = np.zeros(columns.shape[1])
        for node, rows in self.places(columns, np.arange(columns.shape[1]), {n for n, f in enumerate(self.feature) if f < 0}):
            out[rows] = self.value[node]
        return out

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), dtype=np.int64)
        for node, rows in self.places(np.ascontiguousarray(bins.T), np.arange(len(bins)), {n for n, f in enumerate(self.feature) if f < 0}):
            at[rows] = node
        return at


@dataclass(frozen=True)
class Cut:
    gain: float
    feature: int
    bin: int
    left: tuple[float, float]   # gradient and hessian sums
    right: tuple[float, float]
    fewer: str                  # the side of fewer rows, L or R

    def values(self, cfg: Boosting) -> tuple[float, float]:
        return tuple(-cfg.rate * g / h if h else 0.0 for g, h in (self.left, self.right))


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, cfg: Boosting):
    """(gain, feature, bin, (gl, hl), (gr, hr), side of fewer rows) of the best cut; arrays are features x bins. The first of equals."""
    gl, hl, nl = (np.cumsum(x, axis=1) for x in (g, h, n))
    gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
    gr, hr, nr = gt - gl, ht - hl, nt - nl
    ok = (nl >= cfg.leaf_rows) & (nr >= cfg.leaf_rows) & (hl >= cfg.least_hessian) & (hr >= cfg.least_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, gl ** 2 / hl + gr ** 2 / hr - gt ** 2 / ht, -np.inf)
    at = int(np.argmax(gain))
    f, b = divmod(at, g.shape[1])
    if not gain[f, b] > 1e-9:
        return None
    return (float(gain[f, b]), f, b, (float(gl[f, b]), float(hl[f, b])), (float(gr[f, b]), float(hr[f, b])),
            "L" if nl[f, b] <= nr[f, b] else "R")


def grown(cuts: dict, cfg: Boosting) -> tuple[Tree, dict]:
    """The tree that known cuts give best first, and its leaves by path. A path is a text of L and R."""
    tree, at = Tree(), {"": 0}
    open_ = {"": cuts.get("")}
    while len(open_) < cfg.leaves:
        ready = [(c.gain, p) for p, c in open_.items() if c is not None]
        if not ready:
            break
        path = min(ready, key=lambda x: (-x[0], len(x[1]), x[1]))[1]
        cut = open_.pop(path)
        a, b = tree.split(at[path], cut.feature, cut.bin, cut.values(cfg))
        for side, node in (("L", a), ("R", b)):
            at[path + side] = node
            open_[path + side] = cuts.get(path + side) if len(path) + 1 < cfg.depth else None
    return tree, {p: at[p] for p in open_}


def softmax(raw: np.ndarray) -> np.ndarray:
    """Shares of the classes; scores are classes x rows."""
    e = np.exp(raw - reduce(np.maximum, raw))  # row by row of the array: a reduction along its short axis takes longer
    return e / reduce(np.add, e)


def edges(df: DataFrame, features: list[str], cfg: Boosting) -> list[list[float]]:
    """Upper edges of the bins but the last, per feature: quantiles of all rows."""
    steps = [i / cfg.bins for i in range(1, cfg.bins)]
    found = df.approxQuantile(features, steps, 0.25 / cfg.bins)
    return [sorted(set(q)) for q in found]


def _join(fold, label, aside, bins, raw) -> tuple[int, bytes]:
    """A block of rows as bytes. Bins are features x rows, scores (models and classes) x rows."""
    parts = (fold.astype(np.int32), label.astype(np.int32), aside, bins, raw)
    return len(fold), b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


def _part(n: int, data: bytes, features: int) -> tuple:
    """fold, label, aside, bins and scores of a block."""
    at, out = 0, []
    for kind, wide in ((np.int32, 1), (np.int32, 1), (np.bool_, 1), (np.uint8, features), (np.float64, None)):
        many = n * wide if wide else (len(data) - at) // 8
        out.append(np.frombuffer(data, kind, many, at))
        at += out[-1].nbytes
    return out[0], out[1], out[2], out[3].reshape(features, n), out[4].reshape(-1, n)


BLOCKS = "n int, data binary"


def binned(df: DataFrame, features: list[str], edge: list[list[float]], fold: Column, aside: Column) -> DataFrame:
    """Rows for boosting, in packed blocks: fold, label, whether set aside and bin per feature, no scores yet."""
    source = df.select(fold.cast("int").alias("fold"), F.col("label").cast("int").alias("label"), aside.alias("aside"),
                       *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])

    def block(held):
        fold, label, aside, *x = (np.concatenate(c) for c in zip(*held))
        bins = np.stack([np.searchsorted(e, c) for e, c in zip(edge, x)]).astype(np.uint8)
        n, data = _join(fold, label, aside, bins, np.zeros((0, len(fold))))
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([data], pa.binary())], names=["n", "data"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            for start in range(0, b.num_rows, CHUNK):
                part = b.slice(start, CHUNK)
                if rows and rows + part.num_rows > CHUNK:
                    yield block(held)
                    held, rows = [], 0
                held.append([c.to_numpy(zero_copy_only=False) for c in part.columns])
                rows += part.num_rows
        if held:
            yield block(held)
    return source.mapInArrow(run, BLOCKS)


def blocks(stored_blocks: DataFrame, features: int) -> RDD:
    """Blocks as tuples of arrays: what tasks pass on is of no class of this package."""
    return stored_blocks.rdd.map(lambda r: _part(r[0], bytes(r[1]), features))


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one value."""
    size = rows.itemsize * (rows.size // len(rows) if len(rows) else 0)
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(column: pa.Array, dtype) -> np.ndarray:
    """The values of a column, all of one size and none null, end to end."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]].view(dtype)


def _parts(total: np.ndarray) -> tuple:
    """Sums (3 x places) in few bytes: where rows are, if that is less than half, and the smallest type that holds them."""
    at = np.flatnonzero(total[2])
    if 2 * len(at) < total.shape[1]:
        total = total[:, at]
    else:
        at = None
    return (None if at is None else at.astype(np.int32),
            [x.astype(np.int32 if len(x) and np.abs(x).max() < 1 << 31 else np.int64) for x in total])


def level_cuts(rows: RDD, above: RDD | None, trees: dict, asked: dict, weights: np.ndarray, features: int, cfg: Boosting):
    """The sums of a level's nodes as RDD, and the best cuts found there: [((model, class), path, cut)]; and, with roots,
    the mean weighted log loss of each model on its rows set aside.

    `asked`: {(model, class): [(path, node of the tree so far)]} of the nodes to add up; those beside them follow
    from `above`, the sums of the level above."""
    models, size = len(weights), features * cfg.bins
    keys = sorted(asked)
    many = min(len(keys), rows.context.defaultParallelism)
    task = {k: i % many for i, k in enumerate(keys)}  # where the parts of a tree's sums meet
    judged = sorted({m for m, _ in keys}) if above is None else []

    def sums(elements):
        held, loss = {}, np.zeros((models, 2))
        for e in elements:
            if isinstance(e, tuple):
                add(*e, held, loss)
                continue
            for k, nodes in e.items():  # of the level above
                if k in task:
                    yield task[k], (k, {p[:-1]: nodes[p[:-1]] for p, _ in asked[k]})
        for k, total in held.items():  # features x (node, bin) to (node, feature, bin)
            total = total.reshape(3, features, -1, cfg.bins).swapaxes(1, 2).reshape(3, -1).astype(np.int64)
            yield task[k], (k, _parts(total))
        for m in judged if held else ():
            yield 0, (m, loss[m])

    def add(fold, label, aside, bins, raw, held, loss):
        raw = raw.reshape(models, cfg.classes, -1)
        for m in sorted({m for m, _ in keys}):
            p, w, other = softmax(raw[m]), weights[m][label], fold != m
            mine = np.flatnonzero(other & ~aside)
            if m in judged:
                use = np.flatnonzero(other & aside)
                loss[m] += (w[use] * -np.log(np.maximum(p[label[use], use], 1e-15))).sum(), w[use].sum()
            for c in range(cfg.classes):
                if (m, c) not in asked:
                    continue
                nodes = asked[m, c]
                number = {n: i for i, (_, n) in enumerate(nodes)}
                total = held.get((m, c))
                if total is None:
                    total = held[m, c] = np.zeros((3, features, len(nodes) * cfg.bins))
                parts = [(at, np.full(len(at), number[n] * cfg.bins)) for n, at in trees[m, c].places(bins, mine, set(number))]
                if not parts:
                    continue
                use, slot = (np.concatenate(x) for x in zip(*parts))
                pc, wc = p[c].take(use), w.take(use)
                g = np.rint(wc * (pc - (label.take(use) == c)) * UNIT)
                h = np.rint(wc * pc * (1 - pc) * UNIT)
                for f in range(features):
                    place = slot + bins[f].take(use)
                    for i, x in enumerate((g, h, None)):
                        total[i, f] += np.bincount(place, x, minlength=total.shape[2])

    def merge(elements):
        total, parents, loss = {}, {}, {}
        for _, (k, part) in elements:
            if isinstance(part, dict):
                parents[k] = part
            elif isinstance(part, np.ndarray):
                loss[k] = loss.get(k, 0) + part
            else:
                dense = total.setdefault(k, np.zeros((3, len(asked[k]) * size), dtype=np.int64))
                at, columns = part
                for row, x in zip(dense, columns):
                    if at is None:
                        row += x
                    else:
                        row[at] += x
        out = {}
        for k, dense in total.items():
            out[k] = {}
            for (path, _), own in zip(asked[k], dense.reshape(3, -1, size).swapaxes(0, 1)):
                out[k][path] = own
                if path:
                    out[k][path[:-1] + ("R" if path[-1] == "L" else "L")] = parents[k][path[:-1]] - own
        yield out | loss

    def choose(elements):
        for e in elements:
            for k, found in e.items():
                if not isinstance(found, dict):
                    yield k, None, found
                    continue
                for path, own in found.items():
                    g, h, n = own.reshape(3, features, cfg.bins)
                    cut = best_cut(g / UNIT, h / UNIT, n, cfg)
                    if cut is not None:
                        yield k, path, cut
    source = rows if above is None else rows.context.union([rows, above])
    # One shuffle: the parts of a node's sums meet where its cut is chosen.
    merged = source.mapPartitions(sums).partitionBy(many, int).mapPartitions(merge)
    found, loss = merged.mapPartitions(choose).collect(), np.full(models, np.nan)
    for m, path, x in found:
        if path is None and x[1]:
            loss[m] = round(x[0] / x[1], 12)
    return merged, [(k, path, Cut(*x)) for k, path, x in found if path is not None], loss


def advanced(rows: RDD, trees: dict, cfg: Boosting) -> RDD:
    """Rows with the scores of a round's trees added."""
    def run(block):
        fold, label, aside, bins, raw = block
        raw = raw.copy()
        for (m, c), tree in trees.items():
            raw[m * cfg.classes + c] += tree.added(bins)
        return fold, label, aside, bins, raw
    return rows.map(run)


# ---- models whose rows fit one task ------------------------------------------------

def dealt(rows: RDD, models: int, cfg: Boosting) -> RDD:
    """The rows of each model in a partition of its own: (model, ((whether set aside, place), label, bins, scores))."""
    def deal(number, found):
        for i, (fold, label, aside, bins, _) in enumerate(found):
            for m in range(models):
                for late in (False, True):
                    use = np.flatnonzero((fold != m) & (aside == late))
                    if len(use):
                        yield m, ((late, number, i), label[use].astype(np.uint8), bins[:, use], np.zeros((cfg.classes, len(use))))
    return rows.mapPartitionsWithIndex(deal).partitionBy(models, int)


class Rows:
    """Bins of the rows that a model learns from, laid out so that a row's bins lie together."""

    def __init__(self, bins: list[np.ndarray], most: float):
        self.bins = bins
        words = np.zeros((-(-len(bins) // 8), len(bins[0]), 8), dtype=np.uint8)
        for f, column in enumerate(bins):
            words[f // 8, :, f % 8] = column
        self.words = words.view(np.uint64)[:, :, 0]
        # A hessian and a row are added up as one number, where a chunk's sums of both fit a float's 53 bits.
        unit = 2.0 ** np.ceil(np.log2((most * UNIT / 4 + 1) * SMALL + 1))
        self.row = unit if unit * SMALL < 1 << 53 else 0.0

    def sums(self, pairs: np.ndarray, rows: np.ndarray | None, cfg: Boosting) -> np.ndarray:
        """Gradients, hessians and rows per feature and bin, of these rows or of all."""
        out = np.zeros((3, len(self.bins), cfg.bins))
        both = np.zeros(out.shape[1:])
        whole = pairs.view(np.int64 if pairs.itemsize == 4 else np.complex128)[:, 0]
        for start in range(0, len(pairs) if rows is None else len(rows), SMALL):
            if rows is None:
                part = slice(start, min(start + SMALL, len(pairs)))
                held, words = pairs[part], [x[part] for x in self.words]
            else:
                part = rows[start:start + SMALL].astype(np.int64)
                held, words = whole.take(part).view(pairs.dtype).reshape(-1, 2), [x.take(part) for x in self.words]
            g, h = held[:, 0].astype(np.float64), held[:, 1].astype(np.float64)
            if self.row:
                h += self.row
            for f in range(len(self.bins)):
                place = words[f // 8].view(np.uint8)[f % 8::8].astype(np.int64)
                out[0, f] += np.bincount(place, g, cfg.bins)
                both[f] = np.bincount(place, h, cfg.bins)
                if not self.row:
                    out[2, f] += np.bincount(place, None, cfg.bins)
            if self.row:
                n = np.floor(both / self.row)
                out[2] += n
                both -= n * self.row
            out[1] += both
        return out


def whole_tree(source: Rows, pairs: np.ndarray, cfg: Boosting) -> tuple[Tree, list]:
    """The tree that `grown` gives with the cuts of all levels, and the rows of its leaves (none: all); `pairs` are the
    rows' gradients and hessians."""
    tree = Tree()

    def looked(path, node, rows, sums):
        cut = best_cut(sums[0] / UNIT, sums[1] / UNIT, sums[2], cfg) if sums is not None and len(path) < cfg.depth else None
        return path, node, rows, sums, cut and Cut(*cut)
    held = [looked("", 0, None, source.sums(pairs, None, cfg))]
    while len(held) < cfg.leaves:
        ready = [(-cut.gain, len(path), path, i) for i, (path, *_, cut) in enumerate(held) if cut is not None]
        if not ready:
            break
        path, node, rows, sums, cut = held.pop(min(ready)[-1])
        column = source.bins[cut.feature]
        left = (column if rows is None else column.take(rows)) <= cut.bin
        parts = [np.flatnonzero(x).astype(np.int32) if rows is None else rows[x] for x in (left, ~left)]
        new = tree.split(node, cut.feature, cut.bin, cut.values(cfg))
        both: list = [None, None]
        if len(held) + 2 < cfg.leaves and len(path) + 1 < cfg.depth:  # else neither is cut
            few = "LR".index(cut.fewer)
            both[few] = source.sums(pairs, parts[few], cfg)
            both[1 - few] = sums - both[few]
        held += [looked(path + s, n, r, x) for s, n, r, x in zip("LR", new, parts, both)]
    return tree, [(node, rows) for _, node, rows, *_ in held]


def some_rounds(elements, histories: list[list[float]], start: int, weights: np.ndarray, cfg: Boosting):
    """The next rounds of the one model whose rows these are: (model, None, trees by round, losses), then its rows with new scores."""
    held = sorted(elements, key=lambda e: e[1][0])  # rows set aside come last
    if not held:
        return
    m, places = held[0][0], [(x[0], len(x[1])) for _, x in held]
    label, bins, raw = (np.concatenate([x[i] for _, x in held], axis=-1) for i in (1, 2, 3))
    del held
    n, w = sum(size for (late, *_), size in places if not late), weights[m]
    history, out, going = list(histories[m]), [], True
    source = Rows([column[:n] for column in bins], w.max())
    pairs = np.empty((cfg.classes, n, 2), dtype=np.int32 if w.max() * UNIT < 1 << 31 else np.float64)
    for number in range(start, min(start + cfg.keep_rounds, cfg.rounds)):
        if number:
            p, y = softmax(raw[:, n:]), label[n:]
            total = w[y].sum()
            history.append(round(float((w[y] * -np.log(np.maximum(p[y, np.arange(len(y))], 1e-15))).sum() / total), 12) if total
                           else float("nan"))
            if _stops(history, cfg):
                going = False
                break
        for at in range(0, n, SMALL):
            part = slice(at, min(at + SMALL, n))
            p, y = softmax(raw[:, part]), label[part]
            wy = w[y]
            for c in range(cfg.classes):
                pairs[c, part, 0] = np.rint(wy * (p[c] - (y == c)) * UNIT)
                pairs[c, part, 1] = np.rint(wy * p[c] * (1 - p[c]) * UNIT)
        for c in range(cfg.classes):
            tree, leaves = whole_tree(source, pairs[c], cfg)
            for node, rows in leaves:
                if rows is not None:  # a tree of one leaf adds nothing
                    raw[c, rows] += tree.value[node]
            raw[c, n:] += tree.added(bins[:, n:])
            out.append((c, tree.__dict__))
    yield m, None, out, history
    if going and start + cfg.keep_rounds < cfg.rounds:
        at = 0
        for place, size in places:
            part = slice(at, at + size)
            at += size
            yield m, (place, label[part], bins[:, part], raw[:, part])


def _clean(rdd: RDD) -> None:
    """Delete the files of the shuffles behind an RDD that isn't read again; Spark itself waits for a collection of garbage."""
    rdd._jrdd.rdd().cleanShuffleDependencies(False)


def fit_whole(rows: RDD, models: int, weights: np.ndarray, spark: SparkSession, cfg: Boosting) -> list[list[tuple[int, Tree]]]:
    """Trees of every model, each grown in one task; a job runs `keep_rounds` rounds."""
    trees: list[list[tuple[int, Tree]]] = [[] for _ in range(models)]
    histories: list[list[float]] = [[] for _ in range(models)]
    state, kept, older = dealt(rows, models, cfg), None, None
    for start in range(0, cfg.rounds, cfg.keep_rounds):
        known = histories.copy()
        state = state.mapPartitions(lambda e, known=known, start=start: some_rounds(e, known, start, weights, cfg)).persist(
            StorageLevel.MEMORY_AND_DISK)
        found = state.filter(lambda e: e[1] is None).collect()
        if older is not None:
            older.unpersist()
        older, state = state, state.filter(lambda e: e[1] is not None)
        for m, _, new, history in found:
            trees[m] += [(c, Tree(**t)) for c, t in new]
            histories[m] = history
        if not found:
            break
        if start // cfg.keep_rounds % STORED_JOBS == STORED_JOBS - 1:
            fresh = stored(spark.createDataFrame(state.map(lambda e: (pickle.dumps(e),)), "data binary", verifySchema=False), "boosting")
            older.unpersist()
            _clean(older)
            if kept is not None:
                forget(kept)
            kept, older = fresh, None
            state = kept.rdd.map(lambda r: pickle.loads(r[0])).partitionBy(models, int)
    if older is not None:
        older.unpersist()
        _clean(older)
    if kept is not None:
        forget(kept)
    return trees


class BoostedModel:
    """Fitted trees. `transform` adds prediction and probability, as Spark ML's models do."""

    def __init__(self, features: list[str], edge: list[list[float]], trees: list[tuple[int, Tree]], cfg: Boosting):
        self.features, self.edge, self.trees, self.cfg = features, edge, trees, cfg

    @property
    def rounds(self) -> int:
        return len(self.trees) // self.cfg.classes

    def transform(self, df: DataFrame) -> DataFrame:
        edge, trees, classes = self.edge, self.trees, self.cfg.classes

        @F.pandas_udf("array<double>")
        def score(x: pd.DataFrame) -> pd.Series:
            bins = np.stack([np.searchsorted(e, x.iloc[:, i].to_numpy(dtype=float)) for i, e in enumerate(edge)])
            raw = np.zeros((classes, len(x)))
            for c, tree in trees:
                raw[c] += tree.added(bins)
            return pd.Series(list(np.ascontiguousarray(softmax(raw).T)) if len(x) else [], dtype=object)
        inputs = F.struct(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in self.features])
        out = df.withColumn("probability", score(inputs))
        top = F.array_position("probability", F.array_max("probability")) - 1  # the first of equals
        return out.withColumn("prediction", top.cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        remove(spark, path)
        rows = [(k, c, json.dumps(t.__dict__)) for k, (c, t) in enumerate(self.trees)]
        spark.createDataFrame(rows, "position int, class int, tree string").write.mode("overwrite").parquet(f"{path}/trees")
        about = json.dumps({"features": self.features, "edges": self.edge, "settings": self.cfg.__dict__})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/boosting")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedModel":
        about = json.loads(spark.read.text(f"{path}/boosting").first()[0])
        rows = spark.read.parquet(f"{path}/trees").orderBy("position").collect()  # bounded by rounds and leaves
        return BoostedModel(about["features"], about["edges"], [(r["class"], Tree(**json.loads(r["tree"]))) for r in rows],
                            Boosting(**about["settings"]))


def _stops(history: list[float], cfg: Boosting) -> bool:
    """Whether none of the last rounds has a lower loss than the one before them."""
    if np.isnan(history[-1]):
        return False
    return len(history) > cfg.patience and min(history[-cfg.patience:]) > history[-cfg.patience - 1] - cfg.tolerance


def fit_folds(df: DataFrame, features: list[str], folds: int = 0, cfg: Boosting = Boosting()) -> list[BoostedModel]:
    """One model per fold, fitted on the rows of the others; without folds, one model of all rows.

    `df` has the features, label and (with folds) fold 0..folds-1. Classes weigh the same in
    every model's rows, so scores start at zero.
    """
    models = max(folds, 1)
    fold = F.col("fold") if folds else F.lit(-1)
    edge = edges(df, features, cfg)
    aside = F.pmod(F.xxhash64(*features, F.lit(cfg.seed)), F.lit(100)) < cfg.aside_percent
    base = stored(binned(df, features, edge, fold, aside), "boosting")
    rows = blocks(base, len(features))
    counts: dict = {}
    for per in rows.map(_distinct).collect():
        for f, c, n in per:
            counts[f, c] = counts.get((f, c), 0) + n
    weights = np.zeros((models, cfg.classes))
    for m in range(models):
        per = [sum(n for (f, c), n in counts.items() if f != m and c == k) for k in range(cfg.classes)]
        weights[m] = [sum(per) / (sum(p > 0 for p in per) * n) if n else 0.0 for n in per]
    if counts and sum(counts.values()) <= WHOLE:
        trees = fit_whole(rows, models, weights, df.sparkSession, cfg)
        forget(base)
        return [BoostedModel(features, edge, t, cfg) for t in trees]
    trees = [[] for _ in range(models)]
    running, history = list(range(models)) if counts else [], [[] for _ in range(models)]
    rows = rows.map(lambda b: (*b[:4], np.zeros((models * cfg.classes, len(b[0]))))).persist(StorageLevel.MEMORY_AND_DISK)
    older = None
    for number in range(cfg.rounds):
        if not running:
            break
        keys = [(m, c) for m in running for c in range(cfg.classes)]
        cuts: dict = {k: {} for k in keys}
        state = {k: grown(cuts[k], cfg) for k in keys}
        asked, above = {k: [("", 0)] for k in keys}, None
        for level in range(cfg.depth):
            above, found, loss = level_cuts(rows, above, {k: state[k][0] for k in asked}, asked, weights, len(features), cfg)
            if not level and number:  # the job of the roots also judges the round before
                older.unpersist()
                for m in running:
                    history[m].append(loss[m])
                running = [m for m in running if not _stops(history[m], cfg)]
                keys = [k for k in keys if k[0] in running]
            fresh: dict = {}
            for key, path, cut in found:
                if key[0] in running:
                    fresh.setdefault(key, []).append(path)
                    cuts[key][path] = cut
            state = {k: grown(cuts[k], cfg) if k in fresh else state[k] for k in keys}
            # the leaves below cuts of this level: of two, the one of fewer rows
            asked = {}
            for k, paths in fresh.items():
                small = [p + cuts[k][p].fewer for p in sorted(paths)]
                small = [(p, state[k][1][p]) for p in small if p in state[k][1] and len(p) < cfg.depth]
                if small:
                    asked[k] = small
            if not asked:
                break
        _clean(above)
        done = {k: state[k][0] for k in keys}
        for (m, c), t in done.items():
            trees[m].append((c, t))
        if not running or number + 1 == cfg.rounds:
            break
        older, rows = rows, advanced(rows, done, cfg)
        if (number + 1) % cfg.keep_rounds == 0:
            kept = stored(df.sparkSession.createDataFrame(rows.map(lambda b: _join(*b)), BLOCKS, verifySchema=False), "boosting")
            rows = blocks(kept, len(features))
            older.unpersist()
            forget(base)
            base = kept
        rows.persist(StorageLevel.MEMORY_AND_DISK)
    rows.unpersist()
    forget(base)
    return [BoostedModel(features, edge, t, cfg) for t in trees]


def _distinct(block: tuple) -> list:
    """(fold, label, rows) for those met in a block."""
    pairs, n = np.unique(np.stack(block[:2]), axis=1, return_counts=True)
    return [(*pair, k) for pair, k in zip(pairs.T.tolist(), n.tolist())]
