"""Operators that work by blocks of places, with blocks far smaller than usual; queries that must not broadcast."""

import random

import pytest

from lumaframe import registry
from lumaframe.operators import entropy

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [1, 7, 64])
def test_reached_across_blocks(spark, block):
    """Long and short streams, ends inside a block and at its edge, steps over whole blocks, repeated and backward steps."""
    rng = random.Random(block)
    steps = [(s, a, a + rng.randrange(1, 20), a * 3) for s in range(3) for a in range(400)]
    steps += [(7, 0, 63, 1), (7, 63, 64, 2), (7, 64, 64, 3), (8, 0, 300, 4), (8, 300, None, 5), (8, 6, 300, 6), (9, 64, 65, 7), (None, 0, 1, 8), (7, 0, 63, 1)]
    want = set()
    for s in (*range(3), 7, 8, 9):
        at, to = 0, {a: (n, v) for t, a, n, v in steps if t == s}
        while at in to:
            want.add((s, at, to[at][1]))
            if to[at][0] is None or to[at][0] <= at:
                break
            at = to[at][0]
    got = entropy.reached(spark.createDataFrame(steps, "stream int, at long, next long, v int").repartition(3), block)
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["stream", "at", "v"] and set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_copies_across_blocks(spark, block):
    """Chains of copies through many blocks, copies of several blocks' length, copies of nothing."""
    rng = random.Random(block)
    tokens = {"chain": [5, *[(1, 1)] * 300], "long": [1, 2, 3, (500, 3), 4, (300, 250)], "wrong": [(3, 1), 7, (2, 9), (70, 1), (1, None), (5, 5)]}
    tokens |= {f"r{k}": [1, *(rng.choice([rng.randrange(99), (rng.randrange(1, 30), rng.randrange(1, 200))]) for _ in range(100))] for k in range(3)}
    rows, want = [], {}
    for s, own in tokens.items():
        out = []
        for i, t in enumerate(own):
            rows.append((s, i, t, None, None) if isinstance(t, int) else (s, i, None, *t))
            for _ in range(t[0] if isinstance(t, tuple) else 1):
                out.append(t if isinstance(t, int) else out[len(out) - t[1]] if t[1] and 0 < t[1] <= len(out) else None)
        want |= {(s, k): v for k, v in enumerate(out)}
    frame = entropy.placed(spark.createDataFrame(rows, "stream string, seq int, value int, length int, distance int").repartition(3))
    got = [(r.stream, r["at"], r.value) for r in entropy.resolve_copies(frame, block).collect()]
    assert len(got) == len(want) and {(s, k): v for s, k, v in got} == want


@pytest.mark.parametrize("name", ["l10_decoded_symbols"])
def test_no_broadcast(spark, name):
    """Small compressed tables may have many rows: a broadcast of places asked for more than the driver's memory."""
    setting = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(setting, "1")
    try:
        assert registry.queries()[name](spark, SF).count()
    finally:
        spark.conf.unset(setting)
