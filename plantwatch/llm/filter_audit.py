"""12. Filter interaction audit by the Hart and Mas-Colell potential.

Which of five filters a document fails is one of 32 masks, so the whole audit follows from the
documents counted per part and mask. The removal game gives a coalition S of filters the
documents that fail any of them, v(S). Its potential is P({}) = 0 and

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,

computed level by level over the 32 coalitions (times 120, so that it stays a whole number).
A filter's Shapley value is the potential of all five less that of the others; times the 120
orders it is what the filter removes over all orders. Each step of an order is the difference
of two coalitions: what its prefix with and without the filter removes.

Text flags are computed in one narrow pass that leaves a mask and a digest per document.
Copies are found on digests only: documents are counted per digest and id, then per digest,
so that a text that a third of all rows share is added up where it lies before it moves.

Defined cases: a null text is the empty text; a null lang is the part of the empty text; a
repeated id with one text is no copy of itself; a null id is no smaller and no larger than
any other, so it is never a copy; labels that repeat an id say yes if one of them does. Without
documents there are no parts, so no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plantwatch.llm.catalog import query
from plantwatch.llm.rows import append, raw, read, small
from plantwatch.session import stored

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 100
MIN_DISTINCT = 80      # percent of words
MAX_CAPITALS = 10      # percent of code points
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(0x41, 0x5B))
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of a character after its first
FLAGS = T.StructType([T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())])


def text_mask(text: bytes | None) -> int:
    """Bits of the failed filters that look at the text alone (A first)."""
    text = text or b""
    words = text.split()
    short = len(words) < MIN_WORDS
    repeats = 100 * len(set(words)) < MIN_DISTINCT * len(words)
    capitals = 100 * (len(text) - len(text.translate(None, CAPITALS)))
    loud = capitals > 0 and capitals > MAX_CAPITALS * len(text.translate(None, CONTINUED))
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    return short | repeats << 1 | loud << 2 | symbols << 3


def flagged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns of `docs` with `mask` (all filters but the last) and the `digest` of the text."""
    return append(docs, [raw("text")], FLAGS,
                  lambda texts: [[text_mask(t) for t in texts], [hashlib.sha256(t or b"").digest() for t in texts]], keep)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and failed filters, copies included."""
    slim = flagged(docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")), ["doc_id", "part"])
    one = stored(slim.groupBy("digest", "mask", "part", "doc_id").agg(F.count("*").alias("n")), "filter-flags")
    known = stored(labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")),
        "filter-labels")
    # Null ids have no label; dealt by digest they don't meet in one task.
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    one = one.withColumn("_salt", salt).join(
        small(known.withColumn("_salt", F.lit(0).cast("long")), known.count(), 24), ["doc_id", "_salt"], "left")
    mark = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    group = ["digest", "mask", "part", "good", "toxic"]
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    held = one.select("digest", "mask", "part", "doc_id", "n", *mark).groupBy(*group, (F.col("doc_id").isNull()).alias("_none")).agg(
        F.sum("n").alias("n"), least.alias("first"))
    held = stored(held, "filter-groups")
    ids = held.where("first is not null").groupBy("digest").agg(F.min("first.doc_id").alias("smallest"), F.sum("n").alias("_all"))
    several = held.where("first is not null").join(ids.where("_all > 1").drop("_all"), "digest", "left")
    stay = F.when(F.col("smallest").isNull(), F.col("n")).when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    copied = several.select("mask", "part", "good", "toxic", "n", stay.alias("stay"))
    copied = copied.union(held.where("first is null").select("mask", "part", "good", "toxic", "n", "n"))
    parts = copied.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("stay").alias("n")),
        F.struct(F.col("mask").bitwiseOR(1 << 4).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))).alias("m"))
    return parts.groupBy("part", "m.mask").agg(F.sum("m.n").alias("n"), F.sum(F.col("good") * F.col("m.n")).alias("good"),
                                                F.sum(F.col("toxic") * F.col("m.n")).alias("toxic"))


def coalitions(counts: DataFrame) -> DataFrame:
    """Per part: n, and arrays v, good and toxic over the 32 coalitions of what each removes."""
    def removed(of: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(of)).otherwise(0)) for s in range(ALL + 1)])
    return counts.groupBy("part").agg(F.sum("n").alias("n"), removed("n").alias("v"), removed("good").alias("good"),
                                      removed("toxic").alias("toxic"))


def potentials(games: DataFrame, orders: int = len(ORDERS)) -> DataFrame:
    """`games` with `p`: the potential of every coalition times the number of orders."""
    rest = [c for c in games.columns]
    now = games.withColumn("p0", F.lit(0).cast("long"))
    for level in range(1, len(FILTERS) + 1):
        made = [s for s in range(ALL + 1) if s.bit_count() == level]
        # the sum is a multiple of the level, as potentials times 120 are whole numbers
        now = now.select("*", *[F.expr("(" + " + ".join([f"v[{s}] * {orders}L"] + [f"p{s & ~(1 << i)}" for i in range(len(FILTERS)) if s >> i & 1])
                                       + f") div {level}").alias(f"p{s}") for s in made])
    return now.select(*rest, F.array(*[F.col(f"p{s}") for s in range(ALL + 1)]).alias("p"))


def steps(games: DataFrame) -> DataFrame:
    """One row per part, order and step, from differences of coalitions."""
    before = [sum(1 << FILTERS.index(c) for c in o[:k]) for o in ORDERS for k in range(len(o))]
    bit = [1 << FILTERS.index(c) for o in ORDERS for c in o]
    n = len(FILTERS)
    rows = games.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(len(before) - 1))))
    at = F.col("_k") + 1
    rows = rows.select("*", F.element_at(F.lit(before), at).alias("_s"),
                       F.element_at(F.lit(bit), at).alias("_i"))
    new, alone, others = F.col("_s").bitwiseOR(F.col("_i")), F.col("_i"), F.lit(ALL).bitwiseXOR(F.col("_i"))

    def step(of: str) -> Column:
        return F.get(of, new) - F.get(of, F.col("_s"))
    order = F.element_at(F.lit(ORDERS), (F.floor(F.col("_k") / n) + 1).cast("int"))
    return rows.select("part", order.alias("filter_order"), (F.col("_k") % n + 1).cast("int").alias("step"),
                       (F.col("n") - F.get("v", new)).alias("kept"), step("v").alias("removed"),
                       (F.get("v", alone) - step("v")).alias("redundant"), (F.get("v", F.lit(ALL)) - F.get("v", others)).alias("unique_fails"),
                       step("good").alias("good_lost"), step("toxic").alias("toxic_lost"),
                       (F.get("p", F.lit(ALL)) - F.get("p", others)).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of every order, per part, with its Shapley value times 120."""
    return steps(potentials(stored(coalitions(mask_counts(docs, labels)), "coalitions")))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t) THEN 4 ELSE 0 END)
             + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
             + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
           FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
           JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::BIGINT AS prefix
      FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER ((mask & (prefix | bit)) = 0), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & prefix) = 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & prefix) <> 0), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER ((mask & bit) <> 0 AND (mask & prefix) = 0), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER ((mask & bit) <> 0 AND (mask & prefix) = 0), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


@query("op12_filter_audit", OP12_SQL)
def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
