"""Exact top-k by inner product over an impact-ordered index, score at a time.

A vector's components, as integers, are postings. In a block of the index each dimension's postings are
quantised to a few impacts; members of equal impact form a segment, and impact 0 has none. A query takes the
segments of all its dimensions by descending weight times impact and adds to the members' scores. What is
still to come can change a score by no more than the largest unprocessed segment of each dimension, and what
quantising left out by no more than the product of two norms. Once that proves most members out, the query
stops; those that remain are scored exactly from their vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, staged, table

#: Vectors in a block of the index, and queries that meet a block in one task; only speed depends on them.
BLOCK, QUERIES = 32_768, 4096
#: Members of one index and queries whose scores are added to side by side: they fit a core's cache.
MEMBERS, TOGETHER = 4096, 64
#: Impacts of a dimension, without their sign.
LEVELS = 12


class ImpactIndex:
    """Segments of a block of integer vectors (members, dimensions)."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        wide = vectors.astype(np.int64)
        step = np.maximum(1, -(-np.abs(wide).max(0, initial=0) // levels))
        level = np.sign(wide) * ((np.abs(wide) + step // 2) // step)
        rest = (wide - level * step).astype(np.float64)
        self.error = np.sqrt((rest * rest).sum(1)) * (1 + 1e-9)
        dims, impacts, self.members = [], [], []
        for d in range(wide.shape[1]):
            order = np.argsort(level[:, d], kind="stable").astype(np.int32)
            values, first = np.unique(level[order, d], return_index=True)
            for value, part in zip(values.tolist(), np.split(order, first[1:]), strict=True):
                if value:
                    dims.append(d)
                    impacts.append(value * int(step[d]))
                    self.members.append(part)
        self.dims, self.impacts = np.array(dims, np.int64), np.array(impacts, np.int64)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, bar: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each query (members, their exact scores, segments processed). The members hold all of the k best
        and all that equal the k-th, of those that reach the query's bar. own: the member that a query is not to
        be given, or -1."""
        n, weight = len(self.vectors), np.abs(queries).sum(0)
        size = weight[self.dims] * np.abs(self.impacts)
        order = np.lexsort((-np.abs(self.impacts), self.dims))  # in each dimension the next segment is the largest to come
        after = np.zeros(len(size), np.int64)
        same = self.dims[order][1:] == self.dims[order][:-1]
        after[order[:-1]] = np.where(same, np.abs(self.impacts[order])[1:], 0)
        order = np.lexsort((-np.abs(self.impacts), self.dims, -size))
        order = order[size[order] > 0]
        drop = (np.abs(self.impacts) - after)[order] * weight[self.dims[order]]
        to_come = drop.sum() - np.cumsum(drop)
        largest = np.zeros(self.vectors.shape[1], np.int64)
        np.maximum.at(largest, self.dims, np.abs(self.impacts))

        active, out = np.arange(len(queries)), [None] * len(queries)
        exact = np.abs(queries).sum(1).max(initial=0) * (np.abs(self.impacts).max(initial=0) + 1) < 1 << 24
        score = np.zeros((n, len(queries)), np.float32 if exact else np.float64)
        mine = np.flatnonzero(own >= 0)
        score[own[mine], mine] = -np.inf
        norm = np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        used, total = 0, float(drop.sum())
        # proof is sought each time that what is to come has halved, from a sixteenth on
        for part in (16, 32, 64, 0):
            end = len(order) if not part else min(len(order), int(np.searchsorted(-to_come, -total / part)) + 1)
            for at in order[used:end].tolist():
                d = self.dims[at]
                score[self.members[at]] += (queries[active, d] * self.impacts[at]).astype(score.dtype)
                largest[d] = after[at]
            used = max(used, end)
            left = []
            rest = np.abs(queries[active]) @ largest
            for j, i in enumerate(active.tolist()):
                own_score = score[:, j].astype(np.float64)
                bound = self.error * norm[i] + (float(rest[j]) + 1e-6)
                low = own_score - bound
                least = max(float(bar[i]), float(np.partition(low, n - k)[n - k])) if n > k else float(bar[i])
                members = np.flatnonzero((own_score + bound >= least) & np.isfinite(own_score))
                if part and len(members) > max(4 * k, n // 16):
                    left.append(j)
                else:
                    out[i] = (members, self.vectors[members].astype(np.int64) @ queries[i], used)
            if not left:
                break
            active, score = active[left], np.ascontiguousarray(score[:, left]) if len(left) < len(active) else score
        return out


def integers(scale: int = 64):
    """floor(scale * x), x as double; null for vectors that are null or hold null or non-finite components."""

    def of(name: str):
        x = F.col(name)
        bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")))

    return of


def _narrow(rows: list) -> tuple[str, bytes]:
    """The vectors in the narrowest type that holds them."""
    v = np.array(rows, np.int64)
    most = int(np.abs(v).max(initial=0))
    kind = next(t for t, top in (("<i1", 1 << 7), ("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if most < top)
    return kind, v.astype(kind).tobytes()


def _blocks(size: int):
    """Rows (uid, vec_id, v) of a task to blocks of at most `size` rows and one width."""

    def run(batches):
        waiting: dict[int, list] = {}

        def out(rows):
            uid, vec, v = zip(*rows, strict=True)
            kind, data = _narrow(v)
            columns = [pa.array([x], t) for x, t in ((uid, pa.list_(pa.int64())), (vec, pa.list_(pa.int64())), (len(v[0]), pa.int32()), (kind, pa.string()), (data, pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["uids", "vec_ids", "width", "kind", "data"])

        for batch in batches:
            for r in zip(batch.column("uid").to_pylist(), batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                rows = waiting.setdefault(len(r[2]), [])
                rows.append(r)
                if len(rows) == size:
                    yield out(waiting.pop(len(r[2])))
        for rows in waiting.values():
            yield out(rows)

    return run


BLOCKS = "uids array<bigint>, vec_ids array<bigint>, width int, kind string, data binary"


def _vectors(kind: str, width: int, n: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, width)


def _search(k: int, held: int = 65_536):
    """Rows (a block of the index, a list of blocks of queries) to the best members. A task merges what its
    blocks give for a query, and what it has so far is the bar for the next block."""

    def run(batches):
        best: dict[int, tuple] = {}

        def out():
            rows = [(quid, query, *x) for quid, (query, found) in best.items() for x in found]
            best.clear()
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["quid", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                n, place = len(r["uids"]), {u: j for j, u in enumerate(r["uids"])}
                vectors = _vectors(r["kind"], r["width"], n, r["data"])
                unknown = np.array([v is None for v in r["vec_ids"]])
                vec = np.array([v or 0 for v in r["vec_ids"]], np.int64)
                for low, q in ((low, q) for low in range(0, n, MEMBERS) for q in r["queries"]):
                    if q is r["queries"][0]:
                        index = ImpactIndex(vectors[low : low + MEMBERS])
                    queries = _vectors(q["kind"], r["width"], len(q["uids"]), q["data"]).astype(np.int64)
                    before = [best.get(u, (None, []))[1] for u in q["uids"]]
                    bar = np.array([x[-1][1] if len(x) == k else -np.inf for x in before])
                    own = np.array([place.get(u, -1) - low for u in q["uids"]])
                    own[(own < 0) | (own >= MEMBERS)] = -1
                    for uid, query_id, old, (members, score, _) in zip(q["uids"], q["vec_ids"], before, index.search(queries, own, k, bar), strict=True):
                        members = members + low
                        first = np.lexsort((vec[members], unknown[members], -score))[:k]
                        found = [(None if unknown[m] else int(vec[m]), int(s)) for m, s in zip(members[first].tolist(), score[first].tolist(), strict=True)]
                        best[uid] = (query_id, sorted(old + found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k])
                    if len(best) >= held:
                        yield out()
        yield out()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, together: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k rows with the highest inner product, the query's
    own row left out; ties go to the smaller vec_id (null ids last).

    Both: uid (long, unique over the rows; equal for a query and its own row), vec_id, v (array of long,
    below 2**40 in sum of products); other columns are left alone. Null v takes no part; vectors meet only
    those of their own width. A task holds a block of the index and a group of at most about `together`
    queries; an index block is copied once for each group."""
    spark = vectors.sparkSession
    cores = spark.sparkContext.defaultParallelism
    good = vectors.where("v is not null").select("uid", "vec_id", "v")
    parts = max(1, math.ceil(good.count() / block))
    index = good.repartition(parts).mapInArrow(_blocks(block), BLOCKS).withColumn("p", F.pmod(F.spark_partition_id(), F.lit(parts)))
    index = staged(index, "index")
    asked = queries.where("v is not null").select("uid", "vec_id", "v")
    n = asked.count()
    groups = max(1, math.ceil(n / together), min(math.ceil(2 * cores / parts), n // 64))
    asked = asked.repartition(groups).mapInArrow(_blocks(min(TOGETHER, together)), BLOCKS).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups)))
    asked = asked.groupBy("g", "width").agg(F.collect_list(F.struct("uids", "vec_ids", "kind", "data")).alias("queries"))
    asked = staged(asked, "queries").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = index.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(max(cores, parts * groups), "p", "g", "width")
    pairs = pairs.join(asked, ["p", "g", "width"]).select("uids", "vec_ids", "width", "kind", "data", "queries")
    found = staged(pairs.mapInArrow(_search(k), "quid bigint, query_id bigint, vec_id bigint, score bigint"), "best")
    forget(index)
    forget(asked)
    best = Window.partitionBy("quid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", integers(64)("embedding").alias("v"))
    rows = staged(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
