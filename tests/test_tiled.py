"""Tiles against the one-row forms: all small sizes, tile edges included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.kernels import compose
from lumaframe.operators import tiled

RNG = np.random.default_rng(11)
SIZES = [(w, h) for w in (1, 2, 3, 4, 7, 9) for h in (1, 3, 4, 5, 8)]
PICTURES = {f"{w}x{h}": RNG.integers(0, 1 << 32, (h, w), dtype=np.uint64).astype(np.uint32) for w, h in SIZES}


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(k, 0, p.shape[1], p.shape[0], p.ravel().view(np.int32).tolist(), "more") for k, p in PICTURES.items()]
    return spark.createDataFrame([*rows, ("none", 0, None, None, None, "x")], "image_id string, frame_no int, width int, height int, argb array<int>, x string").repartition(3)


def whole(rows):
    out = {}
    for r in rows.collect():
        assert r.width > r.tx * r.side and r.height > r.ty * r.side and len(r.argb) <= r.side**2
        p = out.setdefault(r.image_id, np.full((r.height, r.width), 0, np.uint32))
        y, x = r.ty * r.side, r.tx * r.side
        part = p[y : y + r.side, x : x + r.side]
        part[:] = np.array(r.argb, np.int32).view(np.uint32).reshape(part.shape)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    assert all((got[k] == want[k]).all() for k in want)


@pytest.mark.parametrize("side", [1, 3, 4, 100])
def test_tiles_and_back(frames, side):
    same(whole(tiled.tiles(frames, side)), PICTURES)


@pytest.mark.parametrize("smooth", [True, False])
@pytest.mark.parametrize("side, target, size", [(3, 4, (13, 6)), (4, 3, (2, 20)), (2, 100, (1, 1)), (1, 2, (3, 0)), (100, 3, (5, 5))])
def test_scaled_like_one_row(frames, smooth, side, target, size):
    got = whole(tiled.scale(tiled.tiles(frames, side), *size, smooth=smooth, side=target))
    one = compose.bilinear if smooth else compose.nearest
    want = {}
    for k, p in PICTURES.items():
        w, h = compose.target_size(p.shape[1], p.shape[0], *size, False)
        want[k] = one(p, w, h) if (w, h) != p.shape[::-1] else p
    same(got, want)


def test_ratio_and_nothing(frames):
    got = whole(tiled.scale(tiled.tiles(frames, 3), 6, 6, preserve_ratio=True, side=4))
    assert {k: p.shape[::-1] for k, p in got.items()} == {k: compose.target_size(*p.shape[::-1], 6, 6, True) for k, p in PICTURES.items()}
    assert tiled.scale(tiled.tiles(frames.limit(0)), 5, 5).count() == 0


def test_blend_like_one_row(frames):
    under = frames.withColumn("argb", F.reverse("argb"))
    got = whole(tiled.blend(tiled.tiles(frames, 3), tiled.tiles(under, 3)))
    same(got, {k: compose.blend(p, p[::-1, ::-1]) for k, p in PICTURES.items()})


def test_a_large_frame_has_no_large_row(spark):
    side, n = 64, 1000
    p = RNG.integers(0, 1 << 32, (n, n), dtype=np.uint64).astype(np.uint32)
    frames = spark.createDataFrame([("a", 0, n, n, p.ravel().view(np.int32).tolist())], "image_id string, frame_no int, width int, height int, argb array<int>")
    rows = tiled.scale(tiled.tiles(frames, side), 333, 70, side=side)
    assert rows.select(F.max(F.size("argb"))).first()[0] <= side * side
    same(whole(rows), {"a": compose.bilinear(p, 333, 70)})


def test_small_tiles_of_one_form_go_together(monkeypatch):
    """One call for each form of tile and target tile, not one for each tile; nulls and edges as row by row."""
    import pyarrow as pa

    n, calls, between = 500, [], compose.between
    monkeypatch.setattr(compose, "between", lambda *a: (calls.append(1), between(*a))[1])
    ints = lambda v: pa.array([v] * n, pa.int32())
    lists = lambda k: pa.array([None if k is None else RNG.integers(0, 1 << 31, k).tolist() for _ in range(n)], pa.list_(pa.int32()))
    columns = {"image_id": pa.array([None, *map(str, range(n - 1))], pa.string()), "frame_no": ints(0), "width": ints(8), "height": ints(8), "side": ints(3), "tx": ints(1), "ty": ints(2), "argb": lists(6), "right": lists(2), "below": lists(None), "corner": ints(None)}
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    got = pa.Table.from_batches(tiled._fragments(13, 6, False, True, 4)(iter([batch])))
    assert len(calls) <= 4
    one = pa.concat_tables([pa.Table.from_batches(tiled._fragments(13, 6, False, True, 4)(iter([batch.slice(k, 1)]))) for k in range(n)])
    key = lambda r: (r["image_id"] or "", r["tx"], r["ty"])
    assert sorted(got.to_pylist(), key=key) == sorted(one.to_pylist(), key=key)
