"""Segments, random access and arrival in pieces of animations, against one canvas that gets all frames in order."""

import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_images import RNG, chunk, payload, riff

from lumaframe.kernels import compose, container, vp8l
from lumaframe.operators import animation
from lumaframe.sources import images

SCHEMA = (
    "image_id string, frame_no int, source_width int, source_height int, x int, y int, width int, height int, duration_ms int, blend boolean, dispose boolean, "
    "argb array<int>, _corrupt string"
)
W, H = 5, 4


def some_frames(image, n, resets=0.25):
    rng = np.random.default_rng(len(image) * 1000 + n)
    out = []
    for k in range(n):
        whole = rng.random() < resets
        w, h = (W, H) if whole else (int(rng.integers(1, W + 1)), int(rng.integers(1, H + 1)))
        x, y = int(rng.integers(0, W - w + 1)), int(rng.integers(0, H - h + 1))
        pixels = rng.integers(0, 1 << 32, w * h, dtype=np.uint64).astype(np.uint32)
        out.append((image, k, W, H, x, y, w, h, 10 + k, bool(rng.random() < 0.5), bool(rng.random() < 0.4), pixels.view(np.int32).tolist(), None))
    return out


def in_order(rows):
    """{(image, number): pixels}"""
    out, canvases = {}, {}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        f = SimpleNamespace(**dict(zip(names, r, strict=True)))
        canvas = canvases.setdefault(f.image_id, compose.Canvas(W, H))
        out[f.image_id, f.frame_no] = canvas.add(f, np.array(f.argb, np.int32).view(np.uint32).reshape(f.height, f.width)).ravel().view(np.int32).tolist()
    return out


def got(frame):
    return {(r.image_id, r.frame_no): r.argb for r in frame.collect()}


ROWS = some_frames("a", 60) + some_frames("bb", 25, 0) + some_frames("ccc", 1) + some_frames("dddd", 12, 1)


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("more", F.lit(1)).repartition(4)


def test_segments_give_what_one_canvas_gives(frames):
    assert got(images.frames_by_segment(frames)) == in_order(ROWS)


def test_a_segment_needs_nothing_earlier(frames):
    """Each segment composed from its own rows alone; many of the long animation, so many tasks may share it."""
    rows = animation.segments(frames).collect()
    every = in_order(ROWS)
    found = {}
    for image, segment in {(r.image_id, r.segment) for r in rows}:
        own = sorted((tuple(r)[:13] for r in rows if (r.image_id, r.segment) == (image, segment)), key=lambda r: r[1])
        assert own[0][1] == segment
        found |= in_order(own)
    assert found == every and len({r.segment for r in rows if r.image_id == "a"}) > 10


def test_random_access(spark, frames):
    wanted = [("a", 59), ("a", 59), ("a", 3), ("bb", 24), ("ccc", 0), ("ccc", 7), ("none", 0)]
    want = {k: v for k, v in in_order(ROWS).items() if k in wanted}
    picked = images.frames_at(frames, spark.createDataFrame(wanted, "image_id string, frame_no int"))
    assert got(picked) == want and picked.count() == 4
    small = images.frames_at(frames, spark.createDataFrame(wanted, "image_id string, frame_no int"), images.Wishes(2, 9, smooth=False))
    assert {(r.width, r.height, len(r.argb)) for r in small.collect()} == {(2, 9, 18)}


def test_random_access_composes_from_the_nearest_segment_only(spark):
    """What lies before it may even be corrupt; a corrupt frame of the segment itself is the answer."""
    rows = some_frames("a", 20, 0)
    rows[10] = ("a", 10, W, H, 0, 0, W, H, 5, False, False, [7] * (W * H), None)
    rows[4] = (*rows[4][:11], None, "broken")
    frames = spark.createDataFrame(rows, SCHEMA)
    at = lambda k: images.frames_at(frames, spark.createDataFrame([("a", k)], "image_id string, frame_no int")).first()
    assert at(15).argb == in_order(rows[10:16])["a", 15] and at(10).argb == [7] * (W * H)
    assert at(3)._corrupt is None and at(6)._corrupt == "broken" and at(6).argb is None
    shown = images.frames_by_segment(frames).collect()
    assert sorted(r.frame_no for r in shown) == [*range(5), *range(10, 20)]


def test_segments_of_files(spark):
    from lumaframe.plans import encode

    pictures = [RNG.integers(0, 1 << 32, 64, dtype=np.uint64).tolist() for _ in range(6)]
    raw = spark.createDataFrame([(str(i), encode.composed_file(i, p)) for i, p in enumerate(pictures)] + [("bad", b"RIFF")], "image_id string, content binary")
    want = {(r.image_id, r.frame_no): (r.argb, r._corrupt) for r in images.frames(raw).collect()}
    rows = images.frames_by_segment(images.frames_encoded(raw)).collect()
    assert {(r.image_id, r.frame_no): (r.argb, r._corrupt) for r in rows} == want and len(rows) == 19


def test_plans_shuffle_no_pixels(spark, frames):
    raw = spark.createDataFrame([("a", b"")], "image_id string, content binary")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(images.frames(raw)).count("Exchange") == 0 and plan(images.frames(raw)).count("Scan") == 1
    assert plan(images.frames_by_segment(images.frames_encoded(raw).where("frame_no >= 0").drop("_corrupt"))).count("Exchange hashpartitioning") == 2


def anmf_of(*parts, w=4, h=4):
    head = b"".join(v.to_bytes(3, "little") for v in (0, 0, w - 1, h - 1, 10)) + b"\0"
    return riff(chunk(b"VP8X", bytes([container.ANIMATED, 0, 0, 0, 3, 0, 0, 3, 0, 0])), chunk(b"ANMF", head + b"".join(parts)))


def test_all_chunks_of_a_frame_count():
    """The last image wins, an alpha chunk behind it is kept, and what is broken behind it is an error."""
    one, two = (chunk(b"VP8L", payload(4, 4, [v] * 16)) for v in (1, 2))
    f = container.parse(anmf_of(one, two)).frames[0]
    assert compose.decode_frame(f).ravel().tolist() == [2] * 16
    late = container.parse(anmf_of(one, chunk(b"ALPH", b"\0" * 17)))
    assert late.frames[0].alpha == b"\0" * 17 and late.lossy
    for broken in (b"JUNK\xff\0\0\0", chunk(b"VP8L", payload(3, 4, [1] * 12)), chunk(b"VP8 ", b"short")):
        with pytest.raises(container.ImageError):
            container.parse(anmf_of(one, broken))


def test_limits_hold_for_simple_files_and_frames():
    big = bytes([0x2F]) + ((16383) | (16383 << 14)).to_bytes(4, "little")
    with pytest.raises(container.ImageError, match="many"):
        container.parse(riff(chunk(b"VP8L", big)), 1000)
    with pytest.raises(container.ImageError, match="many"):
        container.parse(riff(chunk(b"VP8 ", b"\0\0\0\x9d\x01\x2a\xff\x3f\xff\x3f")), 1000)
    x = chunk(b"VP8X", bytes([0, 0, 0, 0, 3, 0, 0, 3, 0, 0]))
    with pytest.raises(container.ImageError, match="many"):
        container.parse(riff(x, chunk(b"VP8L", big)), 1000)


def test_data_that_ends_early_is_noticed_at_once():
    """Cut inside the pixels of a large image: not one pixel more than the data can hold is made."""
    side = 16384
    whole = payload(4, 4, RNG.integers(0, 1 << 32, 16, dtype=np.uint64).tolist())
    head = bytes([0x2F]) + ((side - 1) | (side - 1) << 14 | 1 << 28).to_bytes(4, "little")
    began = time.perf_counter()
    for end in range(30, len(whole)):
        with pytest.raises(container.ImageError):
            vp8l.decode(head + whole[5:end], side, side)
    assert (time.perf_counter() - began) / (len(whole) - 30) < 0.01


def stream(spark, tmp_path, batches, schema):
    """The rows that come out when the batches arrive one by one, with a restart in between."""
    from lumaframe.streaming import composing

    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        shown = composing.compose_arriving(spark.readStream.schema(schema).parquet(source))
        query = shown.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(100)
    return spark.read.parquet(table).collect()


STREAM = SCHEMA.replace("argb array<int>", "frame_count int, argb array<int>")


def counted(rows):
    n = {}
    for r in rows:
        n[r[0]] = n.get(r[0], 0) + 1
    return [(*r[:11], n[r[0]], *r[11:]) for r in rows]


@pytest.mark.parametrize("pieces", [1, 3])
def test_frames_that_arrive_in_any_split(spark, tmp_path, pieces):
    rows = counted(some_frames("a", 14) + some_frames("bb", 9, 0) + some_frames("ccc", 1))
    order = np.random.default_rng(pieces).permutation(len(rows))
    dealt = [[rows[i] for i in order[k::pieces]] for k in range(pieces)]
    other = lambda r: (*r[:12], [1] * len(r[12]), None)
    dealt[-1] += [dealt[0][0], dealt[0][0]]  # repeated: as they were
    if pieces > 1:
        dealt[-1] += [other(r) for r in dealt[0][:5]]  # repeated with other pixels: the first arrival counts
    dealt[0] += [(None, *rows[0][1:]), (rows[0][0], None, *rows[0][2:])]
    out = stream(spark, tmp_path, dealt, STREAM)
    assert {(r.image_id, r.frame_no): r.argb for r in out} == in_order([(*r[:11], *r[12:]) for r in rows])
    assert len(out) == 24 and all(r.duration_ms == 10 + r.frame_no and (r.width, r.height) == (W, H) for r in out)


class State:
    """What Spark hands to a group's function."""

    def __init__(self):
        self.value, self.hasTimedOut, self.patience = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.patience = ms


def arrive(run, state, *rows):
    import pandas as pd

    names = [c.split()[0] for c in STREAM.split(", ")]
    return [tuple(r) for part in run((rows[0][0] if rows else "a",), iter([pd.DataFrame(rows, columns=names)] if rows else []), state) for r in part.itertuples(index=False)]


def test_missing_frames_are_given_up_and_corrupt_ones_end():
    from lumaframe.streaming import composing

    rows = counted(some_frames("a", 6, 0))
    run, state = composing.arrivals(images.Wishes(), 50), State()
    assert [r[1] for r in arrive(run, state, rows[0], rows[2], rows[4])] == [0] and state.patience == 50
    assert arrive(run, state, rows[0], rows[2]) == []  # late and repeated
    state.hasTimedOut = True
    (row,) = arrive(run, state)
    assert row[:2] == ("a", 1) and row[-1] == "frame 1 did not arrive; 2 later ones did" and not state.exists
    state.hasTimedOut = False
    broken = (*rows[1][:12], None, "broken")
    assert [(r[1], r[-1]) for r in arrive(run, state, rows[2], broken, rows[0])] == [(0, None), (1, "broken")]
    assert arrive(run, state, rows[1], rows[2]) == [] and state.get[1] is None and state.get[-1]
    state.hasTimedOut = True
    assert arrive(run, state) == [] and not state.exists


def test_encoded_frames_arrive(spark, tmp_path):
    from lumaframe.plans import encode

    pictures = [RNG.integers(0, 1 << 32, 64, dtype=np.uint64).tolist() for _ in range(4)]
    raw = spark.createDataFrame([(str(i), encode.composed_file(i, p)) for i, p in enumerate(pictures)], "image_id string, content binary")
    encoded = images.frames_encoded(raw).drop("_corrupt")
    rows = sorted((tuple(r) for r in encoded.collect()), key=lambda r: -r[1])
    out = stream(spark, tmp_path, [rows[::2], rows[1::2]], encoded.schema)
    assert got_rows(out) == got(images.frames(raw))


def got_rows(rows):
    return {(r.image_id, r.frame_no): r.argb for r in rows}
