"""3. Mixing sources to target weights along a time-varying curriculum.

Every source gets a target in words: its weight's share of all words, at most
`ceiling` times its own size, the excess reshared by weight. A source's weight
also has a shape over training time 0..1; the shape is integrated to a cumulative
demand, and inverting that at a document's running word offset gives the
document's training position. Passes over a source follow one another, and the
document that crosses the target is cut there, so every source meets its target
to within a word. Copies are range-sorted by position.

Offsets within a source come from bucket totals plus a running sum inside each
bucket, so a source that holds a third of all rows is spread like the others.

Defined cases: a null or empty text has size 0 and is never taken; a null source
is a source of its own, last in order; null and repeated ids are allowed (order
within a source is by digest of id and text). An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantwatch.llm.catalog import query
from plantwatch.llm.rows import col, hidden, read, without
from plantwatch.session import stored

WEIGHTS = (5, 2, 1)
CEILING = 3
#: Shape of each weight over training time, as (time, height) knots: large sources early, small ones late.
SHAPES = (((0.0, 1.2), (1.0, 0.8)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.6), (0.5, 0.8), (1.0, 1.8)))
RESULT = ("size", "source_size", "target", "taken", "position")
SIZE = r"[^\x20\x09-\x0D]+"


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with each row's 0-based place in the whole order, from sorted ranges and their counts."""
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = (placed.groupBy(part.alias("_part")).count()
              .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")))
    return (placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_at"))


def targets(sources: DataFrame, weights=WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(_src, source, source_size) with `weight` number, target: capped shares of all words.

    Water filling by aggregates over the sources: every round fixes the sources
    whose share exceeds their cap; only sums reach the driver.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    placed = ranked(sources, [F.col("source").asc_nulls_last()], "_rank")
    placed = stored(placed.withColumn("kind", (F.col("_rank") % len(weights)).cast("int"))
                    .withColumn("weight", F.element_at(cycle, F.col("kind") + 1)).drop("_rank"), "sources")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    cap, share, fixed = F.col("source_size") * ceiling, F.lit(0.0), -1
    over = F.lit(False)
    while True:
        n, held, free = placed.agg(F.count_if(over), F.sum(F.when(over, cap).otherwise(0)),
                                   F.sum(F.when(~over, F.col("weight")).otherwise(0))).first()
        if n == fixed or not free:
            return placed.select("_src", "kind", "source_size",
                                 F.when(over, cap.cast("double")).otherwise(share).alias("target"))
        fixed = n
        share = F.col("weight") * F.lit(float(total - held)) / F.lit(float(free))
        over = share >= cap


def when_due(done: Column, knots) -> Column:
    """Training time at which the share `done` (0..1) of a shape's area is reached."""
    area = sum((b[1] + a[1]) / 2 * (b[0] - a[0]) for a, b in zip(knots, knots[1:]))
    out, before = F.lit(float(knots[-1][0])), 0.0
    parts = []
    for (t0, h0), (t1, h1) in zip(knots, knots[1:]):
        size = (h0 + h1) / 2 * (t1 - t0)
        v = done * area - before
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(h0 * h0) + v * F.lit(2 * (h1 - h0) / (t1 - t0))))
        parts.append((v <= size, F.when(v <= 0, F.lit(float(t0))).otherwise(F.lit(float(t0)) + v * 2 / (root + h0))))
        before += size
    for test, value in reversed(parts):
        out = F.when(test, value).otherwise(out)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, ceiling: int = CEILING, shapes=SHAPES) -> DataFrame:
    """Each document of `docs` (doc_id, text, source) with size, source_size, target, taken and
    `passes`: an array of (pass, words, position) for the copies that the mix takes."""
    names = (*RESULT, "passes")
    kept = without(docs, names)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), text).cast("binary"))
    spread = F.shiftright(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") * buckets, 32)
    sized = (docs.select(*[col(c).alias(f"k{i}") for i, c in enumerate(kept)],
                         F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                         F.regexp_count(text, F.lit(SIZE)).cast("long").alias("size"), digest.alias("_digest"))
             .withColumn("_src", F.when(F.col("_source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("_source"))))
             .withColumn("_bucket", spread))
    totals = stored(sized.groupBy("_src", "_source", "_bucket").agg(F.sum("size").alias("_size")), "buckets")
    before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_src", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    goals = targets(totals.groupBy("_src", F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")),
                    weights, ceiling)
    inside = (Window.partitionBy("_src", "_bucket").orderBy("_digest", "_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    offset = F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = (sized.join(starts.join(goals, "_src"), ["_src", "_bucket"]).withColumn("_offset", offset))
    goal = F.round("target").cast("long")
    passes = []
    for k in range(ceiling):
        at = F.col("_offset") + F.col("source_size") * k
        due = F.lit(None)
        for kind, knots in enumerate(shapes):
            due = F.when(F.col("kind") == kind, when_due(at / F.col("target"), knots)).otherwise(due)
        took = F.least(F.col("size"), goal - at)
        passes.append(F.when(took > 0, F.struct(F.lit(k).alias("pass"), took.alias("words"),
                                                F.round(due, 9).alias("position"))))
    return (placed.withColumn("passes", F.array_compact(F.array(*passes)))
            .withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"]))
            .withColumn("position", F.get("passes", F.lit(0))["position"])
            .select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *RESULT, "passes",
                    F.col("_digest").alias("_order")))


def by_position(df: DataFrame, digest: str = "_order") -> DataFrame:
    """Range-sorted along training time; the digest breaks ties and spreads rows that aren't taken."""
    order = [F.col("position").asc_nulls_last(), F.col(digest)]
    return df.repartitionByRange(*order).sortWithinPartitions(*order).drop(digest)


def training_rows(docs: DataFrame, **how) -> DataFrame:
    """One row per copy that the mix takes, in training order: the document's columns, its words
    (`take`) of `size` and its `position`. A document that crosses its source's target is cut to
    the words taken, joined by spaces."""
    docs = docs.select(*[col(c) for c in without(docs, ("size", "pass", "take", "position"))])
    n_chars = "n_chars" in docs.columns
    docs, back = hidden(docs, ("doc_id", "text", "source", "n_chars"))
    mixed = mix(docs, **how).withColumn("_p", F.explode("passes"))
    cut = F.col("_p.words") < F.col("size")
    first = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(SIZE), F.lit(0)), 1, F.col("_p.words").cast("int")))
    mixed = mixed.withColumn("text", F.when(cut, first).otherwise(F.col("text")))
    if n_chars:
        mixed = mixed.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return by_position(mixed.select(*back, "size", F.col("_p.pass").alias("pass"), F.col("_p.words").alias("take"),
                                    F.col("_p.position").alias("position"), F.col("_order").alias("__order")), "__order")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(concat_ws(':', CAST(doc_id AS VARCHAR), coalesce(text, ''))) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM d GROUP BY source),
w AS (SELECT *, CASE kind WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
c AS (SELECT *, CAST(coalesce(sum(3 * source_size) OVER r, 0) AS DOUBLE) AS held, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER r, 0) AS DOUBLE) AS free,
             CAST(sum(source_size) OVER () AS DOUBLE) AS total, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS k FROM w
      WINDOW r AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(k) AS first FROM c WHERE weight * (total - held) / free < 3 * source_size),
g AS (SELECT source, source_size, kind, CASE WHEN first IS NULL OR k < first THEN CAST(3 * source_size AS DOUBLE)
             ELSE weight * (SELECT total - held FROM c, f WHERE k = first) / (SELECT free FROM c, f WHERE k = first) END AS target FROM c, f),
p AS (SELECT doc_id, size, source_size, target, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, CAST(round(target) AS BIGINT) - off))
       + greatest(0, least(size, CAST(round(target) AS BIGINT) - off - source_size))
       + greatest(0, least(size, CAST(round(target) AS BIGINT) - off - 2 * source_size)) AS BIGINT) AS taken
FROM p
"""


@query("op3_mix", OP3_SQL)
def op3_mix(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return by_position(mix(docs).drop("text", "source", "passes")).select(
        "doc_id", "size", "source_size", "target", "taken")
