"""Delta Lloyd against Lloyd with whole recomputation, in whole numbers."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.llm import centroids as C

SF = "/root/testdata/sf0.001"


def plain(rows, k, rounds, width):
    """rows: (vec_id, vector). Full distances in Python integers, every round anew."""
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centres = [list(map(int, v)) for _, v in sorted(rows, key=lambda r: (name(r[0]), list(r[1])))[:k]]
    near = lambda v: min((sum((int(a) - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for r in range(rounds + 1):
        own = [near(v) for _, v in rows]
        if r < rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), (_, c) in zip(rows, own, strict=True) if c == j]
                centres[j] = [int(sum(int(x) for x in col)) // len(mine) for col in zip(*mine, strict=True)] if mine else centres[j]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(rows, own, strict=True)), key=str), centres


@pytest.mark.parametrize("width, k, rounds, top", [(3, 4, 5, 4), (2, 16, 3, 3), (64, 5, 2, C.MOST), (1, 3, 6, 10)])
def test_like_whole_recomputation(spark, width, k, rounds, top):
    """Few values make many ties, repeated vectors and clusters that lose all; the largest take the integer path."""
    rng = np.random.default_rng(width)
    rows = [(i if i != 7 else None, v) for i, v in enumerate(rng.integers(-top, top + 1, (150, width)).tolist())]
    rows += rows[:5] * 3
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows] + [(999, None, 0, None)], "vec_id long, v array<int>, cluster int, was string")
    found, centres = C.cluster_vectors(frame.repartition(5), k, rounds, width=width)
    want, expected = plain(rows, k, rounds, width)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert centres.tolist() == expected


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(1, [5] * 64), (2, [6] * 64)], "vec_id long, v array<int>")
    found, centres = C.cluster_vectors(frame)
    assert len(centres) == 2 and sorted(r.distance for r in found.collect()) == [0, 0]
    found, centres = C.cluster_vectors(frame.limit(0))
    assert found.count() == 0 and centres.shape == (0, 64)


def test_only_what_moved_is_compared_and_summed(spark, monkeypatch):
    """A vector whose owner rests never meets a centroid that rests; transfers are of vectors that changed hands."""
    met = []
    whole = C.distances
    monkeypatch.setattr(C, "distances", lambda v, c: met.append((len(v), len(c))) or whole(v, c))
    v, c = np.array([[0], [1], [10], [11], [20]]), np.array([[0], [10], [21]])
    owner, d = np.array([0, 0, 1, 1, 2]), np.array([0, 1, 0, 1, 0])
    assert C.reassign(v, owner, d, c, np.array([False, False, True]))[0].tolist() == [0, 0, 1, 1, 2]
    assert met == [(1, 3), (4, 1)]
    state = spark.createDataFrame([([1, 2], 0, 1, True), ([5, 5], 1, 1, False), ([3, 3], 1, -1, True)], "v array<int>, cluster int, was int, moved boolean")
    n, gain = C.transfers(state, 3, 2)
    assert (n.tolist(), gain.tolist()) == ([1, 0, 0], [[1, 2], [2, 1], [0, 0]])


def test_components(spark):
    inf, nan = float("inf"), float("nan")
    rows = [[0.999, -0.001], [1e300, -1e300], [inf, 0.0], [nan, 0.0], [None, 0.0], [1.0], [], None, [0.5, -inf]]
    got = spark.createDataFrame([(r,) for r in rows], "e array<double>").select(C.whole_numbers("e", 64, 2).alias("v")).collect()
    assert [r.v for r in got] == [[63, -1], [C.MOST, -C.MOST]] + [None] * 7


def test_query_like_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    cur = con.execute(C.OP12_SQL)
    names, want = [d[0] for d in cur.description], cur.fetchall()
    got = C.op12_clusters(spark, SF)
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want) and len({r[1] for r in want}) > 3
    assert got.where(F.col("distance") < 0).count() == 0
