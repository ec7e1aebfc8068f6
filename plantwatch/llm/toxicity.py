"""4. Toxicity by maximum-scoring segments of token log-odds.

Units are words and their first four and five letters. From a bounded sample of
labelled rows (`FIT_ROWS`, by digest of the id; ids whose crc32 is 0 mod 5 are
never used) every unit gets log-odds between toxic and clean documents under an
informative Dirichlet prior; units with a clear z-score make the model, every
other token costs a little. A linear scan of each whole text finds all maximal
scoring segments. Segment scores become extreme-value units (lambda * score -
log(K * words), lambda solving the Karlin-Altschul equation on clean text, K from
clean documents), significant segments add up, and a logistic curve fitted on
labelled rows left out of the counts turns the sum into a score of 0 to 1.

Defined cases: null and empty texts have no tokens and score like a text without
any toxic token; a null id counts as held out; labels other than 0 and 1 are
ignored, an id labelled both ways counts as toxic; without labels of both kinds
every score is the smoothed share of toxic labels. Rows are scored one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plantwatch.llm.catalog import query
from plantwatch.llm.rows import append, col, raw, read, shared, without, words
from plantwatch.session import stored

FIT_ROWS = 40_000    # bound of the labelled sample
MAX_UNITS = 100_000  # bound of the model
MIN_DOCS = 3
PRIOR = 0.1          # prior mass as a share of all counts
CLEAR = 3.0          # least z-score of a unit in the model
SIGNIFICANT = 0.05   # most expected chance segments of a significant passage
FLUSH = 200_000      # units held by a counting task at once


def units(word: bytes) -> list[bytes]:
    """The word, and marked first letters of longer ones."""
    text = word.decode("utf-8", "replace")
    return [word] + [(text[:k] + "*").encode() for k in (5, 4) if len(text) > k]


def segments(hits: list[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a row of tokens: `hits` have positive
    scores, every token between them costs `cost`. Linear time (Ruzzo and Tompa)."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total, last = 0.0, 0
    for at, score in hits:
        total -= cost * (at - last)
        start, before = at, total
        total += score
        last = at + 1
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= before:
                k -= 1
            if k < 0 or found[k][3] >= total:
                found.append((start, at + 1, before, total))
                break
            start, before = found[k][0], found[k][2]
            del found[k:]
    return [(s, e, b - a) for s, e, a, b in found]


class Model:
    """Unit scores, the cost of other tokens, extreme-value constants and the final curve."""

    def __init__(self, scores: dict[bytes, float], cost: float, decay: float):
        self.scores, self.cost, self.decay = scores, cost, decay
        self.shift, self.slope, self.base = 0.0, 0.0, 0.0  # log K, and the curve
        self.known: dict[bytes, float] = {}

    def token(self, word: bytes) -> float:
        got = self.known.get(word)
        if got is None:
            got = next((self.scores[u] for u in units(word) if u in self.scores), 0.0)
            if len(self.known) > FLUSH:
                self.known.clear()
            self.known[word] = got
        return got

    def passages(self, text: bytes | None) -> tuple[list[tuple[int, int, float]], int]:
        ws = words(text)
        known, token = self.known, self.token
        hits = [(i, s) for i, w in enumerate(ws) if (s := known[w] if w in known else token(w))]
        return segments(hits, self.cost), len(ws)

    def evidence(self, found, n: int) -> float:
        """Extreme-value units of the significant segments together, or of the best one."""
        level = math.log(max(n, 1)) + self.shift
        each = [self.decay * s - level for _, _, s in found]
        clear = [x for x in each if x > -math.log(SIGNIFICANT)]
        return sum(clear) if clear else max(each, default=-level)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.base + self.slope * evidence))))


def counts(rows: DataFrame, only=None) -> DataFrame:
    """(unit, toxic, clean): documents with each unit, by label; unit b"" counts unit-document pairs
    and b"\\x00" documents. With `only`, other units are left out."""
    def run(batches):
        known = only() if only else None
        tally: dict[bytes, list[int]] = {}

        def out():
            part = list(tally.items())
            tally.clear()
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in part], pa.binary()),
                                               *[pa.array([c[k] for _, c in part], pa.int64()) for k in (0, 1)]],
                                              names=["unit", "toxic", "clean"])
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = {u for w in set(words(text)) for u in units(w)}
                side = 0 if toxic else 1
                tally.setdefault(b"", [0, 0])[side] += len(seen)
                tally.setdefault(b"\x00", [0, 0])[side] += 1
                for u in seen if known is None else seen & known:
                    tally.setdefault(u, [0, 0])[side] += 1
                if len(tally) > FLUSH:
                    yield out()
        if tally:
            yield out()
    return (rows.select(raw("text").alias("text"), "toxic").mapInArrow(run, "unit binary, toxic long, clean long")
            .groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic, part) of at most about `fit_rows` labelled rows that aren't held out."""
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
             .groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
             .withColumn("part", F.crc32(F.col("_id").cast("string")) % 5).where(F.col("part") != 0))
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), "_id")  # fit_rows bounds it
    return stored(rows.select("text", F.col("_toxic").alias("toxic"), "part"), "labelled")


def log_odds(y: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds toxic : clean of each row of (toxic, clean) counts under an informative Dirichlet
    prior, their z-scores, and the smoothed frequency in clean text."""
    mass = PRIOR * total.sum()
    prior = PRIOR * y.sum(axis=1, keepdims=True)
    odds = np.log((y + prior) / (total + mass - y - prior))
    z = (odds[:, 0] - odds[:, 1]) / np.sqrt((1 / (y + prior)).sum(axis=1))
    return odds[:, 0] - odds[:, 1], z, (y[:, 1] + prior[:, 0]) / (total[1] + mass)


def solve_decay(scores: np.ndarray, freq: np.ndarray, cost: float) -> float:
    """The positive lambda with E[exp(lambda * score)] = 1 over clean tokens."""
    rest = max(1e-9, 1 - freq.sum())
    def excess(x):
        return float((freq * np.exp(x * scores)).sum() + rest * math.exp(-x * cost)) - 1
    low, high = 1e-3, 1e-3
    while excess(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Logistic regression of y on one variable (Newton, small ridge on the slope)."""
    a = b = 0.0
    m = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        step = np.linalg.solve(m.T @ (m * w[:, None]) + np.diag([1e-9, ridge]), m.T @ (y - p) - np.array([0.0, ridge * b]))
        step = np.clip(step, -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, max_units: int = MAX_UNITS) -> Model:
    rows = labelled(docs, labels, fit_rows)
    spark, fit, held = docs.sparkSession, rows.where("part < 4"), rows.where("part = 4")
    toxic = counts(fit.where("toxic = 1")).where((F.length("unit") < 2) | (F.col("toxic") >= MIN_DOCS))
    toxic = {bytes(r.unit): r.toxic for r in toxic.orderBy(F.desc("toxic"), "unit").limit(max_units).collect()}
    pairs = toxic.pop(b"", 0)
    n_toxic = toxic.pop(b"\x00", 0)
    clean = {bytes(r.unit): r.clean for r in counts(fit.where("toxic = 0"), shared(spark, set(toxic))).collect()}
    n_clean = clean.pop(b"\x00", 0)
    model = Model({}, 0.01, 1.0)
    model.base = math.log((n_toxic + 1) / (n_clean + 20))
    if not n_toxic or not n_clean:
        return model
    names = sorted(toxic)
    y = np.array([(toxic[u], clean.get(u, 0)) for u in names], dtype=np.float64).reshape(-1, 2)
    odds, z, freq = log_odds(y, np.array([pairs, clean.get(b"", 0)], dtype=np.float64))
    keep = (z >= CLEAR) & (odds > 0)
    if not keep.any():
        return model
    # A token outside the model tells a little for clean: that share of toxic text is inside it.
    inside = y[keep, 0].sum() / max(pairs, 1)
    model.cost = float(np.clip(-math.log(1 - min(0.9, inside)), 0.005, 0.5))
    model.scores = {names[i]: float(odds[i]) for i in np.flatnonzero(keep)}
    model.decay = solve_decay(odds[keep], freq[keep], model.cost)
    sent = shared(spark, model)

    def measure(texts):
        got = [sent().passages(t) for t in texts]
        return [[max((s for _, _, s in f), default=0.0) for f, _ in got], [n for _, n in got],
                [[s for _, _, s in f] for f, _ in got]]
    fields = T.StructType([T.StructField("best", T.DoubleType()), T.StructField("n", T.LongType()),
                           T.StructField("all", T.ArrayType(T.DoubleType()))])
    if held.groupBy("toxic").count().count() < 2:
        held = rows  # too few labels to leave some out
    seen = append(held, [raw("text")], fields, measure, ["toxic"]).collect()  # bounded by fit_rows
    quiet = [model.decay * r.best - math.log(max(r.n, 1)) for r in seen if not r.toxic]
    model.shift = float(np.mean(quiet)) - 0.5772156649 if quiet else 0.0  # the mean of the Gumbel law
    x = np.array([model.evidence([(0, 0, s) for s in r["all"]], r.n) for r in seen])
    base, slope = curve(x, np.array([r.toxic for r in seen], dtype=np.float64))
    if slope > 0:
        model.base, model.slope = base, slope
    return model


PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                     T.StructField("score", T.DoubleType())]))
SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                       T.StructField("passages", PASSAGES)])


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """`docs` with score, predicted and passages (word spans of the significant segments)."""
    model = shared(docs.sparkSession, fitted(docs, labels, fit_rows))

    def run(texts):
        m, out = model(), ([], [], [])
        for t in texts:
            found, n = m.passages(t)
            score = m.score(m.evidence(found, n))
            level = math.log(max(n, 1)) + m.shift - math.log(SIGNIFICANT)
            for o, v in zip(out, (score, int(score >= 0.5), [{"start": a, "end": b, "score": s} for a, b, s in found
                                                             if m.decay * s > level])):
                o.append(v)
        return out
    kept = without(docs.select(*[col(c) for c in (keep or docs.columns)]), SCORED.names)
    return append(docs, [raw("text")], SCORED, run, kept)


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, read(spark, sf_dir, "labels"), ["doc_id"])
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
