"""Lloyd's clustering of integer vectors by differences between rounds.

Every vector's owner and its distance are persisted. Between two rounds most centroids come to rest, so a vector whose
owner stayed where it was is compared only with the centroids that changed; only a vector whose owner moved is
compared with all. Sums over clusters aren't taken anew either: the vectors that changed hands, and no others, are
read back and leave one cluster's sums and join another's, as signed integers. All is exact in 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, staged, table

#: Components are held within this on either side of 0, so that squared distances of 64 of them fit 64 bits.
MOST = 1 << 26
STATE = "vec_id {kind}, v array<int>, cluster int, distance bigint, was int, moved boolean"


def whole_numbers(name: str, scale: int, width: int) -> Column:
    """floor(scale * x) of each component as double, within MOST; null for vectors that are null, of another width,
    or hold null or non-finite components."""
    x = F.col(name)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    clipped = lambda v: F.least(F.greatest(v.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))
    return F.when((F.size(x) == width) & ~bad, F.transform(x, lambda v: F.floor(clipped(v)).cast("int")))


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vectors, centroids), exact."""
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * vectors.shape[1] * largest * largest < 1 << 53:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    v = vectors.astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids.astype(np.int64)], 1)


def reassign(vectors: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) after the centroids marked as changed have moved; an owner below 0 is none yet. Of equally
    near centroids the one with the smaller number owns."""
    owner, distance = owner.copy(), distance.copy()
    stale = (owner < 0) | changed[owner]
    if stale.any():
        d = distances(vectors[stale], centroids)
        owner[stale] = d.argmin(1)
        distance[stale] = d.min(1)
    if changed.any() and not stale.all():
        rest, moved = np.flatnonzero(~stale), np.flatnonzero(changed)
        d = distances(vectors[rest], centroids[moved])
        best = d.argmin(1)
        near, number = d[np.arange(len(rest)), best], moved[best]
        wins = (near < distance[rest]) | ((near == distance[rest]) & (number < owner[rest]))
        owner[rest[wins]], distance[rest[wins]] = number[wins], near[wins]
    return owner, distance


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assign(centroids: np.ndarray, changed: np.ndarray):
    """Rows of the state to the state of the next round."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            owner = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            after, distance = reassign(_matrix(batch, centroids.shape[1]), owner, batch.column("distance").to_numpy(zero_copy_only=False), centroids, changed)
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(after, pa.int32()), pa.array(distance, pa.int64()), pa.array(owner, pa.int32()), pa.array(after != owner)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "cluster", "distance", "was", "moved"])

    return run


def _transfers(k: int, width: int):
    """Vectors that changed hands to one row for each cluster of the task: what its count and sums gain or lose."""

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            v = _matrix(batch, width).astype(np.int64)
            for name, sign in (("cluster", 1), ("was", -1)):
                at = batch.column(name).to_numpy(zero_copy_only=False)
                for c in np.unique(at[at >= 0]).tolist():
                    n[c] += sign * int((at == c).sum())
                    sums[c] += sign * v[at == c].sum(0)
        own = np.flatnonzero((n != 0) | sums.any(1))
        columns = [pa.array(own, pa.int32()), pa.array(n[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "gain"])

    return run


def transfers(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) that clusters gain by the last assignment: at most k rows come to the driver."""
    parts = state.where("moved").select("v", "cluster", "was").mapInArrow(_transfers(k, width), "cluster int, n bigint, gain array<bigint>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("gain")[i]).alias(f"g{i}") for i in range(width))).collect()
    n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for r in rows:
        n[r["cluster"]] = r["n"]
        sums[r["cluster"]] = r[2:]
    return n, sums


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The v of the k rows with the smallest sha256 of `seed:vec_id`; rows of equal ids by v, null ids last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in vectors.select("v", name.alias("name")).orderBy(F.asc_nulls_last("name"), "v").limit(k).collect()], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, width: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector after `rounds` rounds and a last assignment, and the centroids.

    vectors: vec_id of any simple type, v (array of int of `width`, within MOST); rows with null v take no part, other
    columns are left alone, repeated rows and null ids are vectors like any other. Fewer than k vectors make as
    many clusters; none make none. A cluster that loses all its vectors keeps its centroid. The state is written once a
    round and the round before it is deleted; nothing is shuffled but a row a task and cluster. Mappers hold one batch."""
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    start = vectors.where("v is not null").select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    state = staged(start, "vectors")
    centroids = seeds(state, k, seed)
    if not len(centroids):
        return state.select("vec_id", "cluster", "distance"), np.zeros((0, width), np.int64)
    k = len(centroids)
    counts, sums, changed = np.zeros(k, np.int64), np.zeros((k, width), np.int64), np.ones(k, bool)
    for r in range(rounds + 1):
        after = staged(state.select("vec_id", "v", "cluster", "distance").mapInArrow(_assign(centroids, changed), STATE.format(kind=kind)), "clusters")
        forget(state)
        state = after
        if r == rounds:
            break
        n, gain = transfers(state, k, width)
        counts, sums = counts + n, sums + gain
        moved = centroids.copy()
        moved[counts > 0] = sums[counts > 0] // counts[counts > 0, None]  # floor, exact
        changed = (moved != centroids).any(1)
        centroids = moved
        if not changed.any():  # no later round could change anything
            break
    return state.select("vec_id", "cluster", "distance"), centroids


def op12_clusters(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whole_numbers("embedding", 64, 64).alias("v"))
    found, centroids = cluster_vectors(rows)
    inertia = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    held = lambda x: min(int(x), (1 << 63) - 1)
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    about = [(c, held(x), held(sum(inertia.values())), digest(centroids[c])) for c, x in sorted(inertia.items())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assigned(i: int) -> str:
    return f"""
d{i} AS (SELECT v.uid, c.c, list_sum(list_transform(list_zip(v.e, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i} c),
a{i} AS (SELECT uid, min({{'d': CAST(d AS BIGINT), 'c': c}}) AS b FROM d{i} GROUP BY uid)"""


def _centred(i: int) -> str:
    return f"""
s{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT a.b.c AS c, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS i FROM a{i - 1} a JOIN v USING (uid)) GROUP BY c, i),
n{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{i} GROUP BY c),
c{i} AS (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{i - 1} o LEFT JOIN n{i} n USING (c)),"""


OP12_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS INTEGER) AS c, e AS m FROM v QUALIFY c < 16),
{_assigned(0)},{_centred(1)}{_assigned(1)},{_centred(2)}{_assigned(2)},{_centred(3)}{_assigned(3)}
SELECT v.vec_id, a.b.c AS cluster, a.b.d AS distance, CAST(sum(a.b.d) OVER (PARTITION BY a.b.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.m, ',')) AS centroid_sha256
FROM a3 a JOIN v USING (uid) JOIN c3 c ON c.c = a.b.c
"""
