"""11. Centroid clustering by bisector tournaments over integer vectors.

Vectors become integers, so every comparison is exact. For a pair of centroids a < b, the
vectors nearer to b are those on one side of a plane: x . normal > threshold with the integer
normal 2 (b - a) and threshold |b|^2 - |a|^2. With all planes of a round computed once, a
vector's nearest centroid is found by a tournament of k - 1 sign tests: the champion meets the
next centroid, the sign of one linear form eliminates one of the two, and zero favours the
champion, which has the smaller number. Only the winner's distance is computed.

A round is one pass: a task returns sums and counts of its rows per cluster, Spark adds them
up, and k rows reach the driver. No vector is shuffled, so copies and hot clusters don't
matter. Vectors are stored once as whole numbers; each round reads them again.

Defined cases: a vector is kept if it has exactly `SIZE` components, none null or not finite;
repeated rows and ids count each time; a null id is hashed as the text 3:null and comes with
the others, equal hashes go by components; with fewer than `K` kept vectors each is a
centroid; none kept gives no rows. Components of more than `SMALL` after scaling are computed
with unbounded integers; a distance or sum that is no long is null. Columns other than id and
embedding are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plantwatch.llm.catalog import query
from plantwatch.llm.rows import col, read
from plantwatch.session import stored

SIZE = 64
SCALE = 1024
K = 8
ROUNDS = 10
SEED = 3
SMALL = 1 << 26   # up to here sums over a vector fit 64 bits
PART_ROWS = 1 << 14


def whole_vectors(df: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the kept vectors, as doubles that are whole numbers."""
    source = df.select("vec_id", col("embedding").cast("array<double>").alias("x"))
    source = source.where(F.size("x") == size)
    out = pa.schema([("x", pa.list_(pa.float64()))]).field(0)

    def run(batches):
        for batch in batches:
            x = batch.column(1)
            flat = x.flatten()
            rows = flat.to_numpy(zero_copy_only=False).reshape(-1, size)  # nulls become NaN
            keep = np.isfinite(rows).all(axis=1)
            done = np.floor(rows[keep] * scale)
            if not np.isfinite(done).all():
                raise ValueError(f"a component times {scale} is out of range")
            ends = pa.array(np.arange(0, done.size + 1, size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), pa.ListArray.from_arrays(ends, pa.array(done.ravel()))],
                names=["vec_id", out.name])
    id_type = source.schema["vec_id"].dataType.simpleString()
    return source.mapInArrow(run, f"vec_id {id_type}, x array<double>")


def matrix(column: pa.Array, size: int, exact: bool) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    if not exact:
        return rows.astype(np.int64)
    return np.array([int(v) for v in rows.ravel()], dtype=object).reshape(-1, size)


class Planes:
    """Integer normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]], exact: bool):
        kind = object if exact else np.int64
        self.centroids = np.array(centroids, dtype=kind)
        squares = (self.centroids * self.centroids).sum(axis=1)
        k = len(centroids)
        self.normal = {(a, b): 2 * (self.centroids[b] - self.centroids[a]) for b in range(k) for a in range(b)}
        self.threshold = {(a, b): squares[b] - squares[a] for b in range(k) for a in range(b)}

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid per row: one sign test against each further centroid."""
        champion = np.zeros(len(x), dtype=np.int64)
        for b in range(1, len(self.centroids)):
            for a in range(b):
                rows = np.flatnonzero(champion == a)
                if len(rows):
                    side = x[rows] @ self.normal[a, b] - self.threshold[a, b]
                    champion[rows[(side > 0).astype(bool)]] = b
        return champion

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        apart = x - self.centroids[cluster]
        return (apart * apart).sum(axis=1)


def _batches(batches, size: int, exact: bool):
    """Rows of Arrow batches as integer matrices, a bounded number at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            part = batch.slice(at, PART_ROWS)
            yield part, matrix(part.column(part.num_columns - 1), size, exact)


def totals(vectors: DataFrame, centroids: list[list[int]], exact: bool) -> list:
    """(cluster, count, inertia, sums) of the clusters that have vectors: at most k rows."""
    size = len(centroids[0])

    def run(batches):
        planes = Planes(centroids, exact)
        counts = np.zeros(len(centroids), dtype=np.int64)
        sums = np.zeros((len(centroids), size + 1), dtype=object if exact else np.int64)
        for _, x in _batches(batches, size, exact):
            cluster = planes.nearest(x)
            apart = planes.distances(x, cluster)
            counts += np.bincount(cluster, minlength=len(counts))
            for c in np.unique(cluster):
                sums[c, :size] += x[cluster == c].sum(axis=0)
                sums[c, size] += apart[cluster == c].sum()
        used = np.flatnonzero(counts)
        rows = [[Decimal(int(v)) for v in sums[c]] for c in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(rows, pa.list_(pa.decimal128(38, 0)))],
            names=["cluster", "n", "sums"])
    parts = vectors.select("x").mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size + 1)]
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect()
    return [(r["cluster"], r["n"], int(r[f"s{size}"]), [int(r[f"s{i}"]) for i in range(size)]) for r in found]


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors whose seeded ids have the smallest digests."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return [[int(v) for v in r["x"]] for r in rows]


def as_long(value: int) -> int | None:
    return value if -(1 << 63) <= value < 1 << 63 else None


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid."""
    vectors = stored(whole_vectors(df, size, scale), "vectors")
    most = vectors.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0]
    exact = (most or 0) > SMALL
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    kind = "decimal(38,0)" if exact else "long"
    shape = f"vec_id {id_type}, cluster int, distance {kind}"
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        for c, n, _, sums in totals(vectors, centroids, exact):
            centroids[c] = [s // n for s in sums]
    last = {c: inertia for c, _, inertia, _ in totals(vectors, centroids, exact)} if centroids else {}
    all_inertia = as_long(sum(last.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches):
        planes = Planes(centroids, exact) if centroids else None
        for part, x in _batches(batches, size, exact):
            found = planes.nearest(x)
            apart = planes.distances(x, found)
            apart = pa.array([Decimal(int(d)) for d in apart], pa.decimal128(38, 0)) if exact else pa.array(apart)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(np.int32)), apart],
                                             names=["vec_id", "cluster", "distance"])
    done = vectors.select("vec_id", "x").mapInArrow(run, shape)

    def per_cluster(values, kind):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)
    return done.select("vec_id", "cluster", F.expr("try_cast(distance AS bigint)").alias("distance"),
                       per_cluster([as_long(last.get(c, 0)) for c in range(len(centroids))], "long").alias("cluster_inertia"),
                       F.lit(all_inertia).cast("long").alias("inertia"),
                       per_cluster(digests, "string").alias("centroid_sha256"),
                       per_cluster([",".join(map(str, c)) for c in centroids], "string").alias("centroid"))


def _sql() -> str:
    """Fixed seed, scale and rounds, written out: each round is assignment and means."""
    nearest = """
a{r} AS MATERIALIZED (SELECT vec_id, rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
      SELECT v.vec_id, v.rid, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
      FROM v, m{r} m) GROUP BY vec_id, rid)"""
    means = """
m{s} AS MATERIALIZED (SELECT m.c, coalesce(n.x, m.x) AS x FROM m{r} m LEFT JOIN (
      SELECT c, list(floor_mean ORDER BY i) AS x FROM (
        SELECT c, i, CAST((sum(u) - ((sum(u) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS floor_mean FROM (
          SELECT a.c, unnest(v.x) AS u, generate_subscripts(v.x, 1) AS i FROM a{r} a JOIN v ON v.rid = a.rid) GROUP BY c, i) GROUP BY c) n ON m.c = n.c)"""
    parts = [f"""
v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
      FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = {SIZE}),
m0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x
      FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, x FROM v ORDER BY h, x LIMIT {K}))"""]
    for r in range(ROUNDS):
        parts += [nearest.format(r=r), means.format(r=r, s=r + 1)]
    parts.append(nearest.format(r=ROUNDS))
    return "WITH" + ",".join(parts) + f"""
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN m{ROUNDS} m ON a.c = m.c
"""


@query("op11_centroids", _sql())
def op11_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings")).drop("centroid")
