"""7. Near-duplicate documents: Jaccard join by chosen paths.

A document is the set of its five-word shingles. Documents with the same words
form a class first, so copies cost one set. In each of `RUNS` runs every set
draws shingles by a shared random order (`BRANCH` / threshold of them on
average) and lands in their buckets; two sets that reach the threshold share at
least `BRANCH` draws on average, so a run misses a pair with probability below
exp(-BRANCH) per level. Buckets of up to `BUCKET` sets are compared whole. Larger
ones are split by further draws, unless their sets resemble one another anyway:
those are compared in blocks, each pair of blocks in a task of its own, and only
counts and one link per set leave a task. A pair is counted in the first bucket it
shares. Pairs with few common draws in all runs and levels (under `FEWEST` of what
the threshold makes us expect) are far below it; for the others, whole sets are
fetched and intersected exactly. `expected_recall` gives the recall that the
parameters promise.

Links between classes make groups (connected components).

Defined cases: null and empty texts have no shingles and link to nothing; a text
of fewer than five words is one shingle; repeated rows and copies link to each
other (a text without words excepted); null ids are allowed; a group's class_id
is its smallest id. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plantwatch.llm.catalog import query
from plantwatch.llm.components import components
from plantwatch.llm.hashes import mixed, sequence_hashes, word_hashes
from plantwatch.llm.rows import WORD_BYTES, append, hidden, raw, read, small
from plantwatch.session import stored

WIDTH = 5
NUM, DEN = 4, 5      # threshold 0.8
BRANCH, RUNS, LEVELS = 5, 3, 3
BUCKET = 64
BLOCK_SETS, BLOCK_ITEMS = 1024, 2_000_000
RESEMBLE = 0.4       # mean overlap from which a large bucket is compared instead of split
PROBE = 128          # sets of a large bucket that tell whether it is split
FEWEST = 0.35        # share of the expected common draws below which a pair isn't compared


def expected_recall(levels: int = LEVELS, runs: int = RUNS, branch: float = BRANCH) -> float:
    """Least expected share of links found, for pairs just at the threshold that need all levels."""
    missed = (1 - (1 - math.exp(-branch)) ** levels) ** runs
    mean = branch * runs * levels  # common draws of such a pair, about Poisson
    few = sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(math.ceil(FEWEST * mean)))
    return 1 - missed - few


def shingles(one: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word windows, from the words' hashes."""
    n = len(one)
    size = min(n, width)
    out = np.full(max(n - width + 1, 1) if n else 0, size, dtype=np.uint64)
    for k in range(size):
        out = mixed(out, 1) + one[k:k + len(out)]
    return np.unique(mixed(out, 2))


def draws(items: np.ndarray, branch: float = BRANCH) -> list[np.ndarray]:
    """For each run and level, the drawn shingles as keys."""
    share = branch * DEN / NUM / max(1, len(items))
    bound = np.uint64(min(2 ** 64 - 1, int(share * 2.0 ** 64))) if share < 1 else np.uint64(2 ** 64 - 1)
    out = []
    for k in range(RUNS * LEVELS):
        keys = mixed(items, 10 + k)
        out.append(keys[keys <= bound].view(np.int64))
    return out


SKETCH = T.StructType([T.StructField("cls", T.BinaryType()), T.StructField("n", T.LongType()),
                       T.StructField("keys", T.ArrayType(T.ArrayType(T.LongType())))])


def class_of(one: np.ndarray) -> bytes | None:
    """128 bits that stand for the whole word sequence."""
    return b"".join(h.tobytes() for h in sequence_hashes(one, np.array([len(one)]))) if len(one) else None


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id with the class of its words, the size of its set and its draws."""
    def run(texts):
        classes, sizes, keys = [], [], []
        for t in texts:
            one = word_hashes((t or b"").translate(WORD_BYTES))[0]
            items = shingles(one)
            classes.append(class_of(one))
            sizes.append(len(items))
            keys.append(draws(items) if len(items) else [])
        return classes, sizes, keys
    return append(docs, [raw("text")], SKETCH, run, ["doc_id"])


def buckets(classes: DataFrame) -> DataFrame:
    """(id, path, blocks): sets in buckets that are compared whole, in that many blocks."""
    def drawn(level):
        return F.array(*[F.struct(F.lit(r).alias("run"), F.get("keys", F.lit(r * LEVELS + level)).alias("k"))
                         for r in range(RUNS)])
    now = (classes.select("id", F.explode(drawn(0)).alias("d"))
           .select("id", F.col("d.run").alias("run"), F.explode("d.k").alias("path")))
    leaves = []
    for level in range(LEVELS):
        sizes = stored(now.groupBy("path").agg(F.count("*").alias("c")).where("c > 1"), "buckets")
        met = stored(now.join(sizes, "path"), "met")
        large = met.where(F.col("c") > BUCKET)
        if level + 1 == LEVELS or large.isEmpty():
            leaves.append(met.select("id", "path"))
            break
        def split(rows):
            return (rows.join(classes.select("id", "keys"), "id")
                    .select("path", "id", "run", F.explode(F.get("keys", F.col("run") * LEVELS + level + 1)).alias("key")))
        # About PROBE sets of each bucket tell whether its sets resemble one another; the result is the same.
        probe = stored(large.where(F.pmod(F.xxhash64("id", "path"), F.col("c")) < PROBE), "probe")
        chosen = probe.groupBy("path").agg(F.count("*").alias("s"))
        alike = (split(probe).groupBy("path", "key").agg(F.count("*").alias("k"))
                 .groupBy("path").agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("pairs"), F.sum("k").alias("all"))
                 .join(chosen, "path").where(F.col("pairs") >= RESEMBLE * (F.col("s") - 1) * F.col("all")).select("path"))
        alike = stored(alike, "alike")
        leaves += [met.where(F.col("c") <= BUCKET).select("id", "path"),
                   large.join(alike, "path", "left_semi").select("id", "path")]
        now = stored(split(large.join(alike, "path", "left_anti"))
                     .select("id", "run", F.xxhash64("path", "key").alias("path")), "split")
    every = leaves[0]
    for x in leaves[1:]:
        every = every.union(x)
    every = stored(every.distinct(), "leaves")
    # Buckets of the same sets do the same work: one of them stays.
    sizes = (every.join(classes.select("id", "n"), "id").groupBy("path").agg(
        F.count("*").alias("c"), F.sum("n").alias("s"), F.bit_xor(F.xxhash64("id")).alias("sets"))
        .groupBy("c", "s", "sets").agg(F.min("path").alias("path")))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_ITEMS)).cast("int")
    return every.join(stored(sizes.select("path", blocks.alias("blocks")), "places"), "path")


PLACE = ["path", "low", "high"]


def parts(column) -> list[np.ndarray]:
    """The lists of an Arrow column."""
    lists = column.combine_chunks()
    edge = lists.offsets.to_numpy()
    return np.split(lists.flatten().to_numpy(), edge[1:-1] - edge[0])


def bits(lists: list[np.ndarray]) -> np.ndarray:
    """Rows of bits, one column per value that two rows or more have."""
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    keep = count[where] > 1
    out = np.zeros((len(lists), -(-max(int((count > 1).sum()), 1) // 64)), dtype=np.uint64)
    c = column[where[keep]]
    np.bitwise_or.at(out, (owner[keep], c // 64), np.uint64(1) << (c % 64).astype(np.uint64))
    return out


def meetings(rows: pa.Table, values: np.ndarray, size: np.ndarray, enough):
    """For each set of a place, the later ones that meet it here first and share enough values.
    Sets of one block meet in the place of that block only."""
    path, one, other = (rows.column(c)[0].as_py() for c in PLACE)
    block = rows.column("block").to_numpy()
    earlier = bits([x[x < path] for x in parts(rows.column("paths"))])
    for i in range(len(size)):
        j = np.arange(i + 1, len(size))
        if one != other:
            j = j[block[j] != block[i]]
        lo, hi = np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
        j = j[lo * DEN >= hi * NUM]
        j = j[~(earlier[j] & earlier[i]).any(axis=1)]
        if len(j):
            both = np.bitwise_count(values[j] & values[i]).sum(axis=1).astype(np.int64)
            j = j[enough(both, size[i], size[j])]
            if len(j):
                yield i, j


def meet(rows: pa.Table) -> pa.Table:
    """Marks the sets that share enough draws with another set of their place."""
    values = bits(parts(rows.column("sketch")))
    share = FEWEST * RUNS * LEVELS * NUM / DEN

    def enough(both, a, b):
        return both >= share * np.minimum(BRANCH * DEN / NUM, np.maximum(a, b))
    hit = np.zeros(rows.num_rows, dtype=bool)
    for i, j in meetings(rows, values, rows.column("n").to_numpy(), enough):
        hit[i] = hit[j] = True
    return rows.select([*PLACE, "block", "id"]).filter(pa.array(hit))


def compare(rows: pa.Table) -> pa.Table:
    """Links inside a place by exact intersection: per set the documents it links to here, and the
    first set of its group here."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("items").to_pylist()]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    copies, n = rows.column("m").to_numpy(), len(sets)
    weight, root = np.zeros(n, dtype=np.int64), list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def enough(both, a, b):
        return both * DEN >= NUM * (a + b - both)
    for i, j in meetings(rows, bits(sets), size, enough):
        weight[i] += copies[j].sum()
        weight[j] += copies[i]
        for x in j:
            root[find(int(x))] = find(i)
    ids = rows.column("id").to_numpy()
    hit = np.flatnonzero(weight)
    return pa.table({"id": pa.array(ids[hit], pa.int64()), "links": pa.array(weight[hit], pa.int64()),
                     "peer": pa.array(ids[[find(int(x)) for x in hit]], pa.int64())})


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, links, peer): per place, how many documents a class links to there, and a class of its group."""
    own = buckets(classes).groupBy("id").agg(F.collect_list(F.struct("path", "blocks")).alias("at"))
    sketch = F.transform(F.flatten("keys"), lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    own = own.join(classes.select("id", "doc", "cls", "m", "n", sketch.alias("sketch")), "id")
    own = stored(own.withColumn("paths", F.transform("at", lambda x: x["path"])), "meeting")
    spread = (own.withColumn("x", F.explode("at"))
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("x.blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("x.blocks") - 1)))
              .select(F.col("x.path").alias("path"), F.least("block", "other").alias("low"),
                      F.greatest("block", "other").alias("high"), "block", "id", "n", "paths", "sketch"))
    marked = stored(spread.groupBy(*PLACE).applyInArrow(
        meet, "path long, low int, high int, block int, id long"), "marked")
    ids = stored(marked.select("id").distinct(), "marked")
    wanted = stored(own.select("id", "doc", "cls", "m", "paths").join(small(ids, ids.count(), 16), "id"), "wanted")
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text"))
    texts = texts.join(small(wanted, wanted.count(), 250), F.expr("text is not null and _doc <=> doc"))

    def run(cls, texts):
        out = ([], [])
        for c, t in zip(cls, texts):
            one = word_hashes((t or b"").translate(WORD_BYTES))[0]
            same = class_of(one) == c  # an id may stand for several texts
            out[0].append(shingles(one).tobytes() if same else None)
            out[1].append(same)
        return out
    fields = T.StructType([T.StructField("items", T.BinaryType()), T.StructField("same", T.BooleanType())])
    sets = append(texts, [F.col("cls"), raw("text")], fields, run, ["id", "m", "paths"]).where("same").drop("same")
    # an id and its text may come in several rows
    sets = sets.groupBy("id").agg(*[F.first(c).alias(c) for c in ("m", "paths", "items")])
    found = marked.join(sets, "id").groupBy(*PLACE).applyInArrow(compare, "id long, links long, peer long")
    return stored(found, "links")


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, cls) of every row, and classes (cls, doc, m, links, class_id, keep) of all texts
    with words that have copies or links: smallest id, rows, documents linked to, group id, and
    whether the class is the one that stays of its group."""
    members = stored(sketched(docs), "sketches")
    classes = members.where(F.col("n") > 0).groupBy("cls").agg(
        F.min("doc_id").alias("doc"), F.count("*").alias("m"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    found = links(docs, classes)
    roots = components(found.select(F.col("id").alias("a"), F.col("peer").alias("b"))).withColumnRenamed("node", "id")
    linked = stored(found.groupBy("id").agg(F.sum("links").alias("links")).join(roots, "id", "left"), "linked")
    info = (classes.select("id", "cls", "doc", "m").join(small(linked, linked.count(), 48), "id", "left")
            .where("m > 1 or links is not null")
            .select("cls", "doc", "m", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root")))
    info = stored(info, "classes")
    first = info.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "cls")).alias("f"))
    return members.select("doc_id", "cls"), stored(
        info.join(first, "root").select("cls", "doc", "m", "links", F.col("f.doc").alias("class_id"),
                                        (F.col("cls") == F.col("f.cls")).alias("keep")), "groups")


def join(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, class_id (smallest id of its group) and n_links (other documents at
    the threshold or above, copies included)."""
    members, groups = near_duplicates(docs)
    groups = small(groups.drop("doc", "keep"), groups.count(), 64)
    return members.join(groups, "cls", "left").select(
        "doc_id", F.when(F.col("m").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("m") - 1, F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group: the one with the smallest id."""
    docs, back = hidden(docs, ("doc_id", "text"))
    _, groups = near_duplicates(docs)
    n = groups.count()
    field = T.StructType([T.StructField("_cls", T.BinaryType())])
    marked = append(docs, [raw("text")], field, lambda texts: [[
        class_of(word_hashes((t or b"").translate(WORD_BYTES))[0]) for t in texts]])
    groups = groups.select(F.col("cls").alias("_cls"), F.col("doc").alias("_doc"), "m", "keep")
    groups = small(groups.toDF("_cls", "_doc", "_m", "_keep"), n, 64)
    kept = marked.join(groups, "_cls", "left").where(F.col("_m").isNull() | F.col("_keep") & F.col("doc_id").eqNullSafe(F.col("_doc")))
    # Rows of one id and the same words may repeat; they are few, and one of them stays.
    once = kept.where(F.col("_m") > 1).dropDuplicates(["_cls"])
    return kept.where("_m is null or _m = 1").unionByName(once).select(*back)


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM both_have JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * k >= 4 * (nx.n + ny.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT x AS doc_id, min(y) AS class_id, CAST((SELECT count(*) FROM l WHERE l.x = r.x) AS BIGINT) AS n_links FROM r GROUP BY x
"""


@query("op7_jaccard", OP7_SQL)
def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents").select("doc_id", "text"))
