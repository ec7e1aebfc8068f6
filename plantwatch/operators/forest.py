"""Random forest for several classes: class counts per bin, one aggregation per level of all trees.

The method and its settings are those of Spark ML's RandomForestClassifier: Poisson counts for
each row and tree, sqrt(features) drawn per node, Gini impurity of weighted classes, leaves of at
least `leaf_rows` rows, sibling leaves of one class merged, shares of classes averaged over trees.
Spark ML keeps some hundred numbers per row and looks every row up by tree and node; here a level
is one Spark job: each task adds its rows' counts up per (tree, node, feature, bin, class) in numpy,
one shuffle merges the sums of a tree, and the best cut of each node comes back, never a row.

A row's counts come from a hash of the row, so that neither the order nor the number of tasks
changes them, and sums are of whole numbers. Random draws differ from Spark ML's for the same seed.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass
from math import ceil, exp, factorial, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

from plantwatch.operators.boosting import _packed, _unpacked
from plantwatch.session import forget, remove, stored

# Tasks get this code by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 15  # rows that a task adds up at once: their bins stay in the cache


@dataclass(frozen=True)
class Settings:
    # The declared candidate and Spark ML's defaults.
    trees: int = 120
    depth: int = 10
    leaf_rows: int = 20
    bins: int = 32
    classes: int = 3
    seed: int = 42


def poisson_table() -> np.ndarray:
    """Poisson counts of mean 1 by a number of 16 bits."""
    share = np.cumsum([exp(-1) / factorial(k) for k in range(9)])
    return np.searchsorted(share, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def drawn(keys: np.ndarray, tree: int, seed: int, table: np.ndarray) -> np.ndarray:
    """How often a tree takes each row."""
    x = keys + np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return table[x >> np.uint64(48)]


class Tree:
    """Nodes in arrays. A cut sends bins up to `cut` to the node `left`, others to the one behind it; a leaf sends all to itself."""

    def __init__(self, counts: np.ndarray):
        self.feature, self.cut, self.left = (np.array([v], dtype=np.int64) for v in (0, 255, 0))
        self.gain, self.counts = np.zeros(1), np.asarray(counts, dtype=np.int64).reshape(1, -1)

    @property
    def leaf(self) -> np.ndarray:
        return self.cut == 255

    @property
    def depth(self) -> int:
        deep = np.zeros(len(self.cut), dtype=np.int64)
        for n in np.flatnonzero(~self.leaf):  # a node comes before those below it
            deep[self.left[n]:self.left[n] + 2] = deep[n] + 1
        return int(deep.max())

    def split(self, nodes, feature, cut, gain, left, right) -> np.ndarray:
        """Cut `nodes`; their new nodes, left and right in turn."""
        new = len(self.cut) + np.arange(2 * len(nodes))
        self.feature[nodes], self.cut[nodes], self.left[nodes], self.gain[nodes] = feature, cut, new[::2], gain
        both = np.stack([left, right], axis=1).reshape(-1, left.shape[1])
        for name, values in (("feature", 0 * new), ("cut", 0 * new + 255), ("left", new), ("gain", 0.0 * new), ("counts", both)):
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        return new

    def walk(self, bins: np.ndarray, base: np.ndarray, steps: int, width: int) -> np.ndarray:
        """The node of each row after so many steps; its bins begin at `base`."""
        after = (self.left[:, None] + (np.arange(width) > self.cut[:, None])).ravel()  # by node and bin
        at = np.zeros(len(base), dtype=np.int64)
        for _ in range(steps):
            at = after.take(at * width + bins.take(base + self.feature.take(at)))
        return at

    def merge(self, weights: np.ndarray) -> None:
        """Sibling leaves of the same class become one leaf."""
        leaf, top = self.leaf, np.argmax(self.counts * weights, axis=1)
        for n in range(len(leaf) - 1, -1, -1):
            a = self.left[n]
            if not leaf[n] and leaf[a] and leaf[a + 1] and top[a] == top[a + 1]:
                leaf[n] = True
        self.feature[leaf], self.cut[leaf], self.left[leaf] = 0, 255, np.flatnonzero(leaf)


def impurity(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gini impurity and total of weighted class counts (last axis)."""
    total = counts.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, 1 - (counts ** 2).sum(axis=-1) / total ** 2, 0.0), total


def best_cuts(total: np.ndarray, subset: np.ndarray, weights: np.ndarray, leaf_rows: int):
    """Per node: feature, bin, gain (0: no cut) and class counts left and right; `total` is nodes x features drawn x bins x classes."""
    left = np.cumsum(total, axis=2)
    right = left[:, :, -1:] - left
    ok = (left.sum(axis=-1) >= leaf_rows) & (right.sum(axis=-1) >= leaf_rows)
    whole, n = impurity(left[:, :, -1:] * weights)
    (il, nl), (ir, nr) = impurity(left * weights), impurity(right * weights)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, whole - (il * nl + ir * nr) / n, 0.0).reshape(len(total), -1)
    at = np.argmax(gain, axis=1)  # the first of equals
    j, b = np.divmod(at, total.shape[2])
    i = np.arange(len(total))
    return subset[i, j], b, gain[i, at], left[i, j, b], right[i, j, b]


GRID = 256  # quantiles per class that the bins' edges are chosen from


def edges(df: DataFrame, size: int, mass: dict[int, float], cfg: Settings) -> list[list[float]]:
    """Upper edges of the bins but the last, per feature: quantiles of all rows, weighted by class (`mass`: the weight of
    each class's rows), so that rare classes have their share of the edges; `df` has the features as array `x`."""
    names = [f"f{i}" for i in range(size)]

    def columns(batches):  # each row's array is computed once, not once a feature
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, size)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(c)) for c in x.T]], names=["label", *names])
    each = df.select(F.col("label").cast("int").alias("label"), "x").mapInArrow(
        columns, ", ".join(["label int", *[f"{n} double" for n in names]]))
    steps = [(k + 0.5) / GRID for k in range(GRID)]
    found = each.groupBy("label").agg(*[F.percentile_approx(n, steps, 4 * GRID).alias(n) for n in names]).collect()
    share = np.repeat([mass[r["label"]] / GRID for r in found], GRID)
    out = []
    for n in names:
        points = np.array([r[n] for r in found]).ravel()
        order = np.argsort(points, kind="stable")
        at = np.searchsorted(np.cumsum(share[order]) / share.sum(), np.arange(1, cfg.bins) / cfg.bins - 1e-9)
        out.append(np.unique(points[order][at]).tolist())
    return out


def binned(df: DataFrame, key, label: str, edge: list[list[float]]) -> DataFrame:
    """(key, label, bins) of every row; `df` has the features as array `x`."""
    def run(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(edge))
            bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edge)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed(bins)], names=["key", "label", "bins"])
    return df.select(key.alias("key"), F.col(label).cast("int").alias("label"), "x").mapInArrow(
        run, "key long, label int, bins binary")


def level_cuts(rows: DataFrame, trees: list[Tree], wanted: dict[int, np.ndarray], subsets: dict[int, np.ndarray], steps: int,
               weights: np.ndarray, features: int, cfg: Settings) -> dict[int, list[np.ndarray]]:
    """Per tree the best cuts of its wanted nodes."""
    size = cfg.bins * cfg.classes

    def sums(batches):
        table, held, plan = poisson_table(), {}, {}
        for t, nodes in wanted.items():
            number = np.full(len(trees[t].cut), -1)
            number[nodes] = np.arange(len(nodes))
            held[t] = np.zeros((subsets[t].shape[1], len(nodes) * size), dtype=np.int32)
            plan[t] = number, np.ascontiguousarray(subsets[t].T)

        def add(keys, labels, bins):
            base = np.arange(len(keys)) * features
            code = (bins.reshape(len(keys), -1) * np.int16(cfg.classes) + labels[:, None].astype(np.int16)).ravel()
            for t, (number, subset) in plan.items():
                times = drawn(keys, t, cfg.seed, table)
                use = np.flatnonzero(times)
                node = number.take(trees[t].walk(bins, base[use], steps, cfg.bins))
                met = np.flatnonzero(node >= 0)
                use, node = use[met], node[met]
                place, start, many = node * size, base[use], times[use].astype(np.float64)
                for j, total in enumerate(held[t]):
                    total += np.bincount(place + code.take(start + subset[j].take(node)), many, len(total)).astype(np.int32)
        waiting, many = [], 0
        for b in batches:
            if b.num_rows:
                waiting.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), _unpacked(b.column(2), np.uint8)))
                many += b.num_rows
            if many >= CHUNK:
                add(*map(np.concatenate, zip(*waiting)))
                waiting, many = [], 0
        if waiting:
            add(*map(np.concatenate, zip(*waiting)))
        for t, total in held.items():
            total = total.ravel()
            at = np.flatnonzero(total).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([np.concatenate([at, total[at]]).tobytes()])],
                                             names=["tree", "sums"])

    def choose(batches):
        total: dict = {}
        for batch in batches:
            for t, part in zip(*(c.to_pylist() for c in batch.columns)):
                at, counts = np.frombuffer(part, dtype=np.int32).reshape(2, -1)
                total.setdefault(t, np.zeros(subsets[t].size * size, dtype=np.int64))[at] += counts
        for t, sums in total.items():
            sums = sums.reshape(subsets[t].shape[1], -1, cfg.bins, cfg.classes).swapaxes(0, 1)
            found = best_cuts(sums, subsets[t], weights, cfg.leaf_rows)
            feature, cut, gain, left, right = found
            yield pa.RecordBatch.from_arrays(
                [pa.array([t], pa.int32()), *[pa.array([x.tobytes()]) for x in (feature.astype(np.int64), cut, gain, left, right)]],
                names=["tree", "feature", "cut", "gain", "nl", "nr"])
    # One shuffle: the parts of a tree's sums meet where its cuts are chosen.
    parts = rows.mapInArrow(sums, "tree int, sums binary").repartition("tree")
    found = parts.mapInArrow(choose, "tree int, feature binary, cut binary, gain binary, nl binary, nr binary").collect()
    return {r["tree"]: [np.frombuffer(r[c], np.float64 if c == "gain" else np.int64) for c in ("feature", "cut", "gain")]
            + [np.frombuffer(r[c], np.int64).reshape(-1, cfg.classes) for c in ("nl", "nr")] for r in found}


class Forest(Estimator):
    """`fit` takes `features` (vector), `label` (0, 1, ...) and `weight`, one per class."""

    def __init__(self, cfg: Settings = Settings()):
        super().__init__()
        self.cfg = cfg

    def _fit(self, df: DataFrame) -> "ForestModel":
        cfg = self.cfg
        own = sorted(f.name for f in df.schema if not isinstance(f.dataType, VectorUDT))
        per = {r["label"]: r for r in df.groupBy(F.col("label").cast("int").alias("label")).agg(
            F.first("weight").alias("w"), F.count("*").alias("n")).collect()}
        weights = np.array([per[c]["w"] if c in per else 0.0 for c in range(cfg.classes)])
        x = df.withColumn("x", vector_to_array("features"))
        size = len(x.select("x").first()[0]) if per else 0
        edge = edges(x, size, {c: r["w"] * r["n"] for c, r in per.items()}, cfg) if per else []
        if not per:
            return ForestModel(edge, [Tree(np.zeros(cfg.classes)) for _ in range(cfg.trees)], weights)
        rows = stored(binned(x, F.xxhash64(*own), "label", edge), "forest")
        kept = rows.persist()
        trees = [Tree(np.zeros(cfg.classes)) for _ in range(cfg.trees)]
        wanted = {t: np.zeros(1, dtype=np.int64) for t in range(cfg.trees)}
        several = ceil(sqrt(size))
        for level in range(cfg.depth):
            draws = {t: np.random.default_rng([cfg.seed, t, level]).random((len(n), size)) for t, n in wanted.items()}
            subsets = {t: np.sort(np.argsort(d, axis=1)[:, :several], axis=1) for t, d in draws.items()}
            found = level_cuts(kept, trees, wanted, subsets, level, weights, size, cfg)
            for t, nodes in wanted.items():
                feature, cut, gain, left, right = found[t]
                if not level:
                    trees[t].counts[0] = left[0] + right[0]
                ok = gain > 1e-12
                new = trees[t].split(nodes[ok], feature[ok], cut[ok], gain[ok], left[ok], right[ok])
                wanted[t] = new[impurity(trees[t].counts[new] * weights)[0] > 1e-12]
            wanted = {t: n for t, n in wanted.items() if len(n)}
            if not wanted:
                break
        kept.unpersist()
        forget(rows)
        for tree in trees:
            tree.merge(weights)
        return ForestModel(edge, trees, weights)


class ForestModel(Model, MLWritable, MLReadable):
    """Fitted trees. Adds prediction and probability, as Spark ML's models do."""

    def __init__(self, edge: list[list[float]], trees: list[Tree], weights: np.ndarray):
        super().__init__()
        self.edge, self.trees, self.weights = edge, trees, weights

    @property
    def featureImportances(self):
        """Gain of the cuts by feature, weighted by rows; every tree counts the same."""
        out = np.zeros(len(self.edge))
        for t in self.trees:
            met, cuts = [0], []  # merged leaves leave nodes that no way leads to
            while met:
                n = met.pop()
                if t.cut[n] != 255:
                    cuts.append(n)
                    met += [t.left[n], t.left[n] + 1]
            gain = t.gain[cuts] * (t.counts[cuts] * self.weights).sum(axis=1)
            if gain.sum():
                out += np.bincount(t.feature[cuts], gain, len(out)) / gain.sum()
        return Vectors.dense(out / out.sum() if out.sum() else out)

    def _transform(self, df: DataFrame) -> DataFrame:
        edge, trees, weights = self.edge, self.trees, self.weights
        votes, width = [], 1 + max(map(len, edge), default=0)
        for t in trees:
            held = t.counts * weights
            total = held.sum(axis=1, keepdims=True)
            votes.append(np.divide(held, total, out=np.zeros(held.shape), where=total > 0))

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            values = np.stack(x.to_numpy())
            bins = np.stack([np.searchsorted(e, values[:, i]) for i, e in enumerate(edge)], axis=1).astype(np.uint8).ravel()
            base, raw = np.arange(len(x)) * len(edge), np.zeros((len(x), len(weights)))
            for tree, vote in zip(trees, votes):
                raw += vote[tree.walk(bins, base, tree.depth, width)]
            total = raw.sum(axis=1, keepdims=True)
            return pd.Series(list(np.divide(raw, total, out=np.zeros(raw.shape), where=total > 0)), dtype=object)
        out = df.withColumn("_p", score(vector_to_array("features")))
        top = F.array_position("_p", F.array_max("_p")) - 1  # the first of equals
        return out.withColumns({"probability": array_to_vector("_p"), "prediction": top.cast("double")}).drop("_p")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


COLUMNS = ("feature", "cut", "left", "gain", "counts")


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, m = self.sparkSession, self.model
        remove(spark, path)
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"edges": m.edge, "weights": m.weights.tolist()})
        rows = [(k, json.dumps({c: getattr(t, c).tolist() for c in COLUMNS})) for k, t in enumerate(m.trees)]
        spark.createDataFrame(rows, "position int, tree string").write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        spark = self.sparkSession
        about = DefaultParamsReader.loadMetadata(path, spark)
        trees = []
        for r in spark.read.parquet(f"{path}/trees").orderBy("position").collect():  # bounded by trees and depth
            t = Tree(np.zeros(len(about["weights"])))
            for c, v in json.loads(r["tree"]).items():
                setattr(t, c, np.array(v, dtype=np.float64 if c == "gain" else np.int64))
            trees.append(t)
        return ForestModel(about["edges"], trees, np.array(about["weights"]))
