"""9. Quality rules and an isolation forest over their statistics.

One narrow pass counts the rule statistics of every document and stores them.
The forest grows on a bounded sample of statistics (`TREES` x `PSI` rows, by
digest, so reruns agree); every document then gets its mean path length. The
cut between kept and rejected comes from all labelled rows: of the anomaly
scores, the one that best separates quality 1 from 0 while it rejects at most
`MAX_GOOD_LOST` of the good ones. Without labels of both kinds only the base
rules reject.

Defined cases: null and empty texts have no words and fail the base rules;
repeated rows and ids are judged row by row (a label counts for each row with
its id); empty tables give empty results.
"""

from __future__ import annotations

import math
import operator

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from plantwatch.llm.catalog import query
from plantwatch.llm.rows import append, col, raw, read, shared, without
from plantwatch.session import stored

SYMBOLS = b"#*$%&|<>"
TREES, PSI = 100, 256
MAX_GOOD_LOST = 0.01
BINS = 10_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_distinct", "n_doubled")
STATS = T.StructType([T.StructField(n, T.LongType()) for n in (*BASE, *EXTRA)])


def repeated_words(ws: list[bytes], width: int = 5) -> int:
    """Words covered by `width`-word windows that occur twice or more. Exact: windows get dense ids."""
    n = len(ws)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    one = np.array([ids.setdefault(w, len(ids)) for w in ws], dtype=np.int64)
    key, size, span = one, len(ids), 1
    while span < width:
        key = key[:n - span] * len(ids) + one[span:]
        size *= len(ids)
        span += 1
        if span < width and size > 2 ** 62 // len(ids):
            seen, key = np.unique(key, return_inverse=True)
            size = len(seen)
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[at] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: bytes | None) -> tuple:
    text = text or b""
    ws = text.split()  # ASCII white space
    joined = b"".join(ws)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(ws), len(joined.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(ws), len(set(ws)), sum(map(operator.eq, ws, ws[1:])))


def rule_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`docs` with the rule statistics of `text`, counted over whole texts."""
    return append(docs, [raw("text")], STATS, lambda texts: [*zip(*map(statistics, texts))] or [[]] * len(STATS), keep)


def features(rows: np.ndarray) -> np.ndarray:
    """Rates, one row per document, from columns in the order of STATS."""
    words, _, symbols, _, repeat, distinct, doubled = rows.T.astype(np.float64)
    n = np.maximum(words, 1)
    return np.stack([np.log1p(words), symbols / n, repeat / n, doubled / n, distinct / n ** 0.9], axis=1)


def average_path(n):
    """Mean path length of a failed search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1),
                    np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as flat arrays: feature (-1 at leaves), cut, left child (right is left + 1), path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.psi = max(2, min(psi, len(rows)))
        self.trees = [self._grow(rows[rng.permutation(len(rows))[:self.psi]], rng) for _ in range(trees)]

    def _grow(self, rows, rng):
        nodes, deepest = [[-1, 0.0, 0, 0.0]], math.ceil(math.log2(self.psi))
        todo = [(0, rows, 0)]
        while todo:
            at, part, depth = todo.pop()
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
            spread = np.flatnonzero(high > low)
            if depth >= deepest or len(part) < 2 or not len(spread):
                nodes[at] = [-1, 0.0, 0, depth + float(average_path(len(part)))]
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(low[f], high[f]))
            left = len(nodes)
            nodes[at] = [f, cut, left, 0.0]
            nodes += [None, None]
            below = part[:, f] < cut
            todo += [(left, part[below], depth + 1), (left + 1, part[~below], depth + 1)]
        a = np.array(nodes)
        return a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly 0..1 by mean path length; higher is odder."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, left[at] + (rows[each, np.maximum(f, 0)] >= cut[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(average_path(self.psi)), 1e-9))


def fitted(stats: DataFrame, trees: int = TREES, psi: int = PSI) -> Forest | None:
    """A forest on at most about trees x psi rows of `stats`, chosen by digest."""
    names = list(STATS.names)
    count = stats.count()
    if not count:
        return None
    share = min(1.0, trees * psi / count)
    part = F.pmod(F.xxhash64("_row", *names), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = np.array(sorted(tuple(r) for r in stats.where(part).select(*names).collect()), dtype=np.int64)
    return Forest(features(sample), trees, psi) if len(sample) else None


def threshold(scored: DataFrame, labels: DataFrame, max_good_lost: float = MAX_GOOD_LOST) -> float:
    """The anomaly from which documents are rejected, from all labelled rows; 2 (none) without both kinds."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_row"), "quality").distinct()
    bins = (scored.join(known, "_row").groupBy(F.ceil(F.col("anomaly") * BINS).alias("bin"))
            .agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).orderBy("bin").collect())
    good, bad = sum(r[1] for r in bins), sum(r[2] for r in bins)
    best, cut, lost, caught = 0.0, 2.0, 0, 0
    for b, g, w in reversed(bins if good and bad else []):
        lost, caught = lost + g, caught + w
        if lost <= max_good_lost * good and caught / bad - lost / good > best:
            best, cut = caught / bad - lost / good, (b - 1) / BINS
    return cut


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`docs` with the rule statistics, base_failed, anomaly and kept."""
    kept = without(docs.select(*[col(c) for c in (keep or docs.columns)]),
                   (*STATS.names, "base_failed", "anomaly", "kept", "_row"))
    stats = stored(rule_statistics(docs.withColumn("_row", F.col("doc_id")), [*kept, "_row"]), "rule-statistics")
    forest = shared(docs.sparkSession, fitted(stats))

    def score(*columns):
        rows = np.array(columns, dtype=np.int64).T
        return [forest().score(features(rows)).tolist() if len(rows) and forest() else [0.0] * len(rows)]
    scored = append(stats, [F.col(n) for n in STATS.names],
                    T.StructType([T.StructField("anomaly", T.DoubleType())]), score, rows=1 << 14)
    scored = scored.withColumn("base_failed", (F.col("n_words") < 10) |
                               (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    cut = threshold(scored.where(~F.col("base_failed")), labels)
    return (scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= cut))
            .select(*[col(c) for c in kept], *STATS.names, "base_failed", "anomaly", "kept"))


@query("op9_quality")
def op9_quality(spark, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ["doc_id"])
    return judged.select("doc_id", *BASE, "base_failed", "kept", "anomaly")
