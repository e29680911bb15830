"""Centroid clustering: Lloyd's rounds on integer vectors, each vector's nearest centroid found by annulus search.

Centroids are sorted by norm. A vector's upper bound is its exact distance to the centroid of the nearest norm; by the
triangle inequality any centroid at least as near has a norm within that bound of the vector's own, so binary search
gives the vector's annulus of candidates, and only those are compared: exactly, in integers, ties on the annulus's
border included. No state of a vector is carried from round to round, so no round rewrites the vectors: it reads them,
adds up each cluster inside its task, and the driver sees K rows of sums. Means are floor(sum / count) in whole numbers.

Defined cases: a vector takes part if it has DIMENSIONS components, none null, NaN or infinite, and none above LARGEST in
size once scaled, so that every squared distance fits in a long; others have no row. Repeated rows are vectors each. A
row without an id takes part, but seeds only where fewer than K vectors have ids. Fewer vectors than K give as many
centroids as vectors; equal seeds are centroids each, and the smaller number wins their ties; an empty table gives an
empty result; sums of distances are exact, and null should one not fit in a long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, read

K, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
LARGEST = 1 << 26


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors that take part."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * F.lit(float(scale))))
    fine = F.forall(F.col("embedding").cast("array<double>"), lambda v: v.isNotNull() & (F.abs(v) * F.lit(float(scale)) < F.lit(float(LARGEST))))
    # NaN is above every number here, so it is no less than the bound
    return vectors.select("vec_id", "embedding").filter((F.size("embedding") == dimensions) & fine).select(F.col("vec_id").cast("long"), scaled.cast("array<int>").alias("x"))


def seeds(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed:vec_id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy(F.asc_nulls_last("key"), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), len(rows[0].x) if rows else 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid, the smaller of equal ones, and the squared distance. All integers."""
    norms = np.sqrt((centroids**2).sum(axis=1).astype(np.float64))
    order = np.argsort(norms, kind="stable")
    sorted_norms = norms[order]
    own = np.sqrt((x**2).sum(axis=1).astype(np.float64))
    right = np.minimum(np.searchsorted(sorted_norms, own), len(order) - 1)
    left = np.maximum(right - 1, 0)
    first = order[np.where(own - sorted_norms[left] <= sorted_norms[right] - own, left, right)]
    best, distance = first.copy(), ((x - centroids[first]) ** 2).sum(axis=1)
    # wide enough for what roots lose in rounding; an extra candidate costs a comparison and changes nothing
    bound = np.sqrt(distance.astype(np.float64))
    slack = 1e-9 * (own + bound + 1)
    low = np.searchsorted(sorted_norms, own - bound - slack, "left")
    high = np.searchsorted(sorted_norms, own + bound + slack, "right")
    for at, c in enumerate(order.tolist()):
        rows = np.flatnonzero((low <= at) & (at < high) & (first != c))
        if len(rows):
            d = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
            closer = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
            best[rows[closer]], distance[rows[closer]] = c, d[closer]
    return best, distance


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums): one row a cluster, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Python integers beyond a batch: no sum can overflow
        n, sums = [0] * len(centroids), np.zeros(centroids.shape, object)
        for batch in batches:
            x = _matrix(batch)
            best, _ = nearest(x, centroids)
            for c in np.unique(best).tolist():
                n[c] += int((best == c).sum())
                sums[c] += x[best == c].sum(axis=0).astype(object)
        found = [c for c in range(len(n)) if n[c]]
        yield pa.RecordBatch.from_pydict({"cluster": found, "n": [n[c] for c in found], "sums": [[str(v) for v in sums[c]] for c in found]}, schema=pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]))

    parts = vectors.select("x").mapInArrow(run, "cluster int, n long, sums array<string>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return cells.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("sums"))


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids after so many rounds, k rows at most. vectors: (vec_id, x)."""
    centroids = seeds(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for r in cluster_sums(vectors, centroids).collect():  # k rows of sums
            centroids[r.cluster] = [int(s.s) // r.n for s in r.sums]
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, distance = nearest(_matrix(batch), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], schema=schema)

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, cluster int, distance long")


def fingerprint(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector. vectors: (vec_id, embedding)."""
    spark = vectors.sparkSession
    kept = cut(integer_vectors(vectors))
    centroids = fit(kept, k, rounds, seed)
    found = cut(assign(kept, centroids))
    # one row a cluster: at most k
    total = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole = sum(int(r.s) for r in total)
    fits = lambda v: v if v < 1 << 63 else None
    rows = [(r.cluster, fits(int(r.s)), fits(whole), fingerprint(centroids[r.cluster])) for r in total]
    beside = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(beside), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_annulus_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read(spark, sf_dir, "embeddings"))


def oracle(k: int = K, rounds: int = ROUNDS) -> str:
    """The same rounds in SQL: every vector against every centroid, by sums over components."""
    near = lambda c: f"SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT v.rid, c.cluster, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN {c} c) GROUP BY rid"
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND NOT isnan(e) AND NOT isinf(e))) = {DIMENSIONS}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k}))"""]
    for r in range(rounds):
        parts.append(f"""a{r} AS MATERIALIZED ({near(f'c{r}')}),
m{r} AS (SELECT cluster, list(m ORDER BY i) AS x FROM (SELECT cluster, i, CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) + CASE WHEN (CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) + 1) * n <= s THEN 1 WHEN CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) * n > s THEN -1 ELSE 0 END AS m
  FROM (SELECT cluster, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, unnest(range(1, {DIMENSIONS} + 1)) AS i FROM a{r} JOIN v USING (rid)) GROUP BY 1, 2)) GROUP BY 1),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    parts.append(f"f AS MATERIALIZED ({near(f'c{rounds}')})")
    return f"""WITH {', '.join(parts)} SELECT vec_id, f.cluster, distance, CAST(sum(distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM f JOIN v USING (rid) JOIN c{rounds} c ON c.cluster = f.cluster"""
