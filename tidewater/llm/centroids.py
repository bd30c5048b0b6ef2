"""Centroid clustering of integer vectors (k-means), with Ptolemaic pivots.

The first round measures every distance. The centroids that it yields are the pivots from then on, and every vector's
distances to them are kept beside it in a written table. By Ptolemy's inequality, d(v,c) is at least
|d(v,p) d(c,q) - d(v,q) d(c,p)| / d(p,q) for any pivots p and q. A centroid is bounded over fixed pairs: the pivot that it
was when the pivots were taken, with each of the PARTNERS pivots that the vector is closest to. The greatest bound,
rounded down, leaves out every centroid that is farther than the one whose pivot is closest; the survivors are measured
exactly in 64-bit integers. No vector is shuffled: a round is one scan that sends back at most one row of sums per
centroid and task, and the driver holds the centroids alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructType

from .common import clear_of, read, shared_table, sheltered

DIM, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
PARTNERS = 4
LIMIT = 1 << 27          # components beyond it count as it, so that a squared distance fits 64 bits
SLACK = 2.0 ** -20       # above the relative error of a bound: distances are kept in 32 bits
SLICE = 1000             # rows compared at once
MOST = np.iinfo(np.int64).max


def integers(column: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component x, taken as a double."""
    def one(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    return F.transform(column, one)


def whole(column: str, dim: int) -> Column:
    """Whether a vector has ``dim`` components, none null, not a number or infinite."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.coalesce((F.size(column) == dim) & F.forall(column, finite), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer arrays."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances from each vector to each pivot."""
    out = np.zeros((len(vectors), len(pivots)))
    for i, p in enumerate(pivots):
        out[:, i] = np.sqrt(squared(vectors, p[None, :]).astype(np.float64))
    return out


class Pivots:
    """Fixed pivots, one per centroid, and their distances from each other."""

    def __init__(self, at: np.ndarray):
        self.at, self.between = at, distances(at, at)

    def lower_bounds(self, near: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """For each vector and centroid a squared distance that the true one is never below. ``near``: vectors to pivots."""
        far = distances(centroids, self.at)
        own, bound = np.diagonal(far), np.zeros(near.shape)
        closest = np.argpartition(near, min(PARTNERS, near.shape[1]) - 1, axis=1)[:, :PARTNERS]
        for q in closest.T:
            between = self.between[q]
            a, b = near * far.T[q], near[np.arange(len(q)), q][:, None] * own
            np.divide(np.abs(a - b) - (a + b) * SLACK, between, out=a, where=between > 0)
            np.maximum(bound, a, out=bound, where=between > 0)
        return bound * bound * (1 - SLACK)


def nearest(vectors: np.ndarray, centroids: np.ndarray, pivots: Pivots | None = None,
            near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, exact squared distance) of each vector, the smaller number on ties, and how many distances were measured.

    Without ``pivots`` and the vectors' distances ``near`` to them, all are."""
    clusters, found, measured = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for at in range(0, len(vectors), SLICE):
        v = vectors[at:at + SLICE]
        low = (np.zeros((len(v), len(centroids))) if pivots is None
               else pivots.lower_bounds(near[at:at + SLICE].astype(np.float64), centroids))
        rows = np.arange(len(v))
        first = low.argmin(axis=1) if pivots is None else near[at:at + SLICE].argmin(axis=1)
        exact = np.full(low.shape, MOST)
        exact[rows, first] = best = squared(v, centroids[first])
        low[rows, first] = np.inf
        r, c = np.nonzero(low <= best[:, None] * (1 + SLACK))
        exact[r, c] = squared(v[r], centroids[c])
        cluster = exact.argmin(axis=1)
        clusters.append(cluster)
        found.append(exact[rows, cluster])
        measured += len(v) + len(r)
    return np.concatenate(clusters), np.concatenate(found), measured


def _start(kept: DataFrame, key: str, k: int, dim: int) -> np.ndarray:
    name = F.concat(F.lit("2:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = kept.select(F.sha2(name, 256).alias("h"), "_v").orderBy("h", "_v").limit(k).collect()
    return np.array([r._v for r in rows], np.int64).reshape(-1, dim)


def _moved(table: DataFrame, centroids: np.ndarray, pivots: Pivots | None = None) -> np.ndarray:
    """The centroids after one round: floors of the exact means of their vectors; those without vectors stay."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            v = matrix(b.column(0), dim).astype(np.int64)
            cluster, _, _ = nearest(v, centroids, pivots, matrix(b.column(1), k) if pivots else None)
            np.add.at(total, cluster, v)
            count += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]),
                                          pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["c", "n", "s"])

    wide = [F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    rows = (table.select("_v", *["_p"] * bool(pivots)).mapInArrow(sums, "c int, n long, s array<long>")
            .groupBy("c").agg(F.sum("n").alias("n"), *wide))
    out = centroids.copy()
    for r in rows.collect():
        out[r.c] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
    return out


@sheltered("_v", "_p")
def cluster_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = CENTROIDS,
                    rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(columns of ``vectors`` but ``column``, cluster, distance (squared, to its centroid), cluster_inertia, inertia,
    centroid (integers)) of every row whose ``column`` has ``dim`` finite components.

    Components become floor(scale * x), at most LIMIT from 0. The start: the k vectors whose hash of ``2:<key>`` is
    least (a null key counts as empty; equal hashes by their components); with fewer vectors there are fewer
    centroids. Rows are judged one by one: repeated rows and copies are clustered like any others, other vectors
    (null, of other length, with null or non-finite components) are left out, and an empty table gives no rows. Columns
    with the names added are replaced. Inertias beyond 64 bits stand at the greatest long.
    """
    added = ("cluster", "distance", "cluster_inertia", "inertia", "centroid")
    spark = vectors.sparkSession
    kept = vectors.filter(whole(column, dim)).withColumn("_v", integers(column, scale)).drop(column)
    centroids = _start(kept, key, k, dim)
    kept = clear_of(kept, *added)
    k, at, outer = len(centroids), kept.columns.index("_v"), [i for i, c in enumerate(kept.columns) if c != "_v"]
    centroids = _moved(kept, centroids) if k and rounds else centroids
    pivots = Pivots(centroids)

    def cache(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = distances(matrix(b.column(at), dim).astype(np.int64), pivots.at).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.tolist(), pa.list_(pa.float32()))],
                                             names=[*b.schema.names, "_p"])

    schema = StructType([*kept.schema.fields]).add("_p", ArrayType(FloatType()))
    table = shared_table(kept.mapInArrow(cache, schema), "pivot-distances")
    for _ in range(rounds - 1 if k else 0):
        centroids = _moved(table, centroids, pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, near = matrix(b.column(at), dim).astype(np.int64), matrix(b.column(b.num_columns - 1), k)
            cluster, distance, _ = nearest(v, centroids, pivots, near)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in outer], pa.array(cluster, pa.int32()), pa.array(distance)],
                                             names=[*[b.schema.names[i] for i in outer], "cluster", "distance"])

    schema = (StructType([table.schema.fields[i] for i in outer]).add("cluster", IntegerType())
              .add("distance", LongType()))
    assigned = shared_table(table.mapInArrow(assign, schema), "clusters")
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    every = sum(inertia.values())
    facts = [(c, min(s, int(MOST)), min(every, int(MOST)), centroids[c].tolist()) for c, s in inertia.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    out = assigned.join(F.broadcast(known), "cluster")  # a row per centroid
    return out.select(*[c for c in assigned.columns if c not in added], *added)


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    out = cluster_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                      F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _sql() -> str:
    """The query in SQL: every distance of every round, the rounds written out."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT i, c, s FROM (
    SELECT e.i, c{r}.c, sum((e.x - c{r}.y) * (e.x - c{r}.y)) AS s,
           row_number() OVER (PARTITION BY e.i ORDER BY sum((e.x - c{r}.y) * (e.x - c{r}.y)), c{r}.c) AS place
    FROM e JOIN c{r} ON e.d = c{r}.d GROUP BY e.i, c{r}.c) WHERE place = 1)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS (SELECT a{r}.c, e.d, sum(e.x) AS s, count(*) AS n FROM e JOIN a{r} ON e.i = a{r}.i GROUP BY a{r}.c, e.d),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, c{r}.d, coalesce((m{r}.s - ((m{r}.s % m{r}.n) + m{r}.n) % m{r}.n) // m{r}.n, c{r}.y)::BIGINT AS y
    FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c AND c{r}.d = m{r}.d)""")
    last = ROUNDS
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS i, vec_id, v FROM v),
e AS MATERIALIZED (SELECT i, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM n),
c0 AS MATERIALIZED (SELECT i AS c, d, x AS y FROM e WHERE i < {CENTROIDS}),{','.join(steps)},
h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT n.vec_id, a{last}.c::INT AS cluster, a{last}.s::BIGINT AS distance,
       (sum(a{last}.s) OVER (PARTITION BY a{last}.c))::BIGINT AS cluster_inertia, (sum(a{last}.s) OVER ())::BIGINT AS inertia,
       h.centroid_sha256
FROM a{last} JOIN n ON n.i = a{last}.i JOIN h ON h.c = a{last}.c
"""


OP11_SQL = _sql()
