"""Codes, copies and cache as relations against plain loops; frames on screen against a walk through the loop."""

import random

import pytest
from pyspark.sql import functions as F

from lumaframe.kernels import vp8l
from lumaframe.operators import animation, entropy


def test_canonical_codes(spark):
    """Words as the decoder's own table reads them; codes that aren't complete are told."""
    codes = {"a": [2, 1, 3, 3], "one": [0, 0, 5], "less": [1, 2], "more": [1, 1, 1], "deep": [*range(1, 15), 15, 15], "eight": [8] * 256, "none": [0, 0]}
    rows = [(c, s, n, "x") for c, lengths in codes.items() for s, n in enumerate(lengths)] + [("a", 9, None, "x")]
    got = {}
    for r in entropy.canonical(spark.createDataFrame(rows, "code string, symbol int, length int, more string")).collect():
        got.setdefault(r.code, {})[r.symbol] = r
    assert {c for c, own in got.items() if not all(r.complete for r in own.values())} == {"less", "more"} and "none" not in got
    assert got["one"][2].length == 0 and (got["one"][2].first, got["one"][2].end) == (0, 1 << 15)
    for c in ("a", "deep", "eight"):
        words = sorted((f"{r.word:0{r.length}b}", s) for s, r in got[c].items())
        assert all(not b[0].startswith(a[0]) for a, b in zip(words, words[1:], strict=False))
        by_length = sorted(got[c].items(), key=lambda x: (x[1].length, x[0]))
        assert [r.first for _, r in by_length] == sorted(r.first for r in got[c].values())
        for s, r in got[c].items():
            bits = vp8l.Bits(int(f"{r.word:0{r.length}b}"[::-1], 2).to_bytes(3, "little"))
            assert vp8l.Code(codes[c]).read(bits) == s


def test_reached_places(spark):
    """Only the chain from 0 counts, also where other chains run into it; streams that start nowhere have nothing."""
    rng = random.Random(2)
    steps = [(s, a, a + rng.randrange(1, 4)) for s in range(4) for a in range(60)] + [(9, 5, 6), (8, 0, 1)]
    want = set()
    for s in (*range(4), 8, 9):
        at, to = 0, {a: n for t, a, n in steps if t == s}
        while at in to:
            want.add((s, at))
            at = to[at]
    got = entropy.reached(spark.createDataFrame(steps, "stream int, at long, next long"))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_copies(spark):
    tokens = {
        "plain": [7, 8, 9], "overlap": [7, (5, 1), (3, 2), 4, (9, 10)], "long": [1, 2, (2000, 2)], "chain": [5, *[(1, 1)] * 300],
        "wrong": [(2, 1), 3, (1, 9), (1, 0), (2, 1), (0, 1), 6],
    }
    rows, want = [], {}
    for s, own in tokens.items():
        out = []
        for i, t in enumerate(own):
            rows.append((s, i, t, None, None) if isinstance(t, int) else (s, i, None, *t))
            for _ in range(t[0] if isinstance(t, tuple) else 1):
                out.append(t if isinstance(t, int) else out[len(out) - t[1]] if 0 < t[1] <= len(out) else None)
        want |= {(s, k): v for k, v in enumerate(out)}
    frame = entropy.placed(spark.createDataFrame(rows, "stream string, seq int, value int, length int, distance int").repartition(3))
    got = {(r.stream, r.at): r.value for r in entropy.resolve_copies(frame).collect()}
    assert got == want
    assert entropy.resolve_copies(frame.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 4, 11])
def test_cache(spark, bits):
    rng = random.Random(bits)
    colours = [rng.getrandbits(32) for _ in range(12)]
    rows, want = [], {}
    for s in range(3):
        cache = {}
        for k in range(120):
            if rng.random() < 0.4:
                slot = rng.randrange(1 << bits)
                rows.append((s, k, None, slot))
                p = cache.get(slot, 0)
            else:
                p = rng.choice(colours)
                rows.append((s, k, p, None))
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - bits)] = p if rows[-1][2] is not None else cache.get((0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - bits), p)
            want[s, k] = p
    places = spark.createDataFrame(rows, "stream int, at int, argb long, slot int").repartition(3)
    assert {(r.stream, r["at"]): r.argb for r in entropy.resolve_cache(places, bits).collect()} == want


def test_on_screen(spark):
    durations = {"a": [10, 0, 30], "hot": [1, 7, 2, 500, 3], "still": [0]}
    loops = {"a": 2, "hot": 0}
    rng = random.Random(1)
    moments = [(i, "hot", rng.randrange(-5, 3000)) for i in range(400)] + [(400 + t, "a", t) for t in range(-2, 100)] + [(900, "still", 5), (901, "none", 5), (902, "a", None), (903, "still", None)]
    frames = spark.createDataFrame([(i, n, d) for i, own in durations.items() for n, d in enumerate(own)], "image_id string, frame_no int, duration_ms int")
    asked = spark.createDataFrame([(*m, "k") for m in moments], "n int, image_id string, at_ms long, row string")
    got = animation.on_screen(frames, asked, spark.createDataFrame(list(loops.items()), "image_id string, loop_count int"))
    rows = got.collect()
    assert got.columns == ["n", "image_id", "at_ms", "row", "frame_no"] and len(rows) == len(moments)
    for r in rows:
        own, want = [max(1, d) for d in durations.get(r.image_id, [])], None
        if own and r.at_ms is not None and r.at_ms >= 0:
            if loops.get(r.image_id) and r.at_ms >= sum(own) * loops[r.image_id]:
                want = len(own) - 1
            else:
                left, want = r.at_ms % sum(own), 0
                while left >= own[want]:
                    left -= own[want]
                    want += 1
        assert r.frame_no == want
    for parts in (1, 7):
        assert animation.on_screen(frames, asked, parts=parts).where(F.col("image_id") == "hot").exceptAll(got.where(F.col("image_id") == "hot")).count() == 0
