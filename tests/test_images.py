"""Container, lossless payloads, composition and scaling, on images made here."""

import numpy as np
import pytest

from lumaframe.kernels import compose, container, vp8l
from lumaframe.sources import images
from lumaframe.streaming import arrivals


class Out:
    def __init__(self):
        self.v = self.n = 0

    def put(self, value, n):
        self.v |= value << self.n
        self.n += n

    def bytes(self):
        return self.v.to_bytes(self.n // 8 + 1, "little")


def literals(out, pixels, top):
    """An entropy-coded image with 8-bit codes for all channels and no cache."""
    out.put(0, 1)
    if top:
        out.put(0, 1)
    for symbols in (280, 256, 256, 256, 40):
        if symbols == 40:
            out.put(0b0001, 4)  # simple, one symbol of one bit: 0
            continue
        out.put(0, 1)
        out.put(8, 4)
        for k in range(12):
            out.put(int(vp8l.LENGTH_ORDER[k] == 8), 3)
        out.put(1, 1)
        out.put(3, 3)
        out.put(254, 8)
    turned = [int(f"{i:08b}"[::-1], 2) for i in range(256)]
    for p in pixels:
        for shift in (8, 16, 0, 24):
            out.put(turned[p >> shift & 255], 8)


def payload(w, h, pixels, transforms=()):
    out = Out()
    for value, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    for write in transforms:
        out.put(1, 1)
        write(out)
    out.put(0, 1)
    literals(out, pixels, True)
    return out.bytes()


def chunk(code, data):
    return code + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)


def riff(*chunks):
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def anmf(x, y, w, h, ms, flags, data):
    head = b"".join(v.to_bytes(3, "little") for v in (x // 2, y // 2, w - 1, h - 1, ms)) + bytes([flags])
    return chunk(b"ANMF", head + chunk(b"VP8L", data))


RNG = np.random.default_rng(42)
W, H = 7, 5
PICTURE = RNG.integers(0, 1 << 32, W * H, dtype=np.uint64).tolist()


def test_literals_round_trip():
    assert vp8l.decode(payload(W, H, PICTURE), W, H).ravel().tolist() == PICTURE


@pytest.mark.parametrize("mode", range(14))
def test_predictors_round_trip(mode):
    rest = []
    for at, p in enumerate(PICTURE):
        y, x = divmod(at, W)
        if at == 0:
            g = 0xFF000000
        elif y == 0:
            g = PICTURE[at - 1]
        elif x == 0:
            g = PICTURE[at - W]
        else:
            g = vp8l.PREDICTORS[mode](PICTURE[at - 1], PICTURE[at - W], PICTURE[at - W + 1], PICTURE[at - W - 1])
        rest.append(sum((((p >> s & 255) - (g >> s & 255)) & 255) << s for s in (0, 8, 16, 24)))

    def write(out):
        out.put(0, 2)
        out.put(1, 3)
        literals(out, [mode << 8] * (1 * 1), False)

    assert vp8l.decode(payload(W, H, rest, [write]), W, H).ravel().tolist() == PICTURE


def test_subtract_green_and_palette():
    less = [(p & 0xFF00FF00) | ((p >> 16) - (p >> 8) & 255) << 16 | (p - (p >> 8) & 255) for p in PICTURE]
    assert vp8l.decode(payload(W, H, less, [lambda o: o.put(2, 2)]), W, H).ravel().tolist() == PICTURE
    palette = [0xFF102030, 0x80405060, 0x01020304]
    index = [i % 3 for i in range(W * H)]
    packed = []
    for y in range(H):
        for block in range(2):
            packed.append(sum(index[y * W + 4 * block + k] << 2 * k for k in range(4) if 4 * block + k < W) << 8)

    def write(out):
        out.put(3, 2)
        out.put(2, 8)
        deltas = [palette[0], *[sum((((b >> s & 255) - (a >> s & 255)) & 255) << s for s in (0, 8, 16, 24)) for a, b in zip(palette, palette[1:])]]
        literals(out, deltas, False)

    assert vp8l.decode(payload(W, H, packed, [write]), W, H).ravel().tolist() == [palette[i] for i in index]


def test_near_places_of_copies():
    assert len(vp8l.NEAR) == 120
    assert vp8l.NEAR[:4] == ((0, 1), (1, 0), (1, 1), (-1, 1)) and vp8l.NEAR[-1] == (8, 7)


def test_bit_reader():
    bits = vp8l.Bits(bytes.fromhex("9c41e1"))
    assert [bits.read(n) for n in (3, 2, 6, 10, 3)] == [4, 3, 12, 40, 7]
    with pytest.raises(vp8l.ImageError):
        bits.read(1)


def test_animation_container_and_composition():
    red, clear = [0xFFFF0000] * 16, [0x00000000] * 4
    x = chunk(b"VP8X", bytes([container.ANIMATED | container.ALPHA | container.EXIF, 0, 0, 0, 3, 0, 0, 3, 0, 0]))
    data = riff(x, chunk(b"ANIM", b"\1\2\3\4\5\0"), anmf(0, 0, 4, 4, 40, 1, payload(4, 4, red)), anmf(2, 2, 2, 2, 240, 2, payload(2, 2, [0xFF0000FF] * 4)), anmf(0, 0, 2, 2, 10, 0, payload(2, 2, clear)), chunk(b"EXIF", b"abc"))
    image = container.parse(data + b"trailing")
    assert (image.width, image.height, image.loop_count, image.loop_duration_ms, image.lossy) == (4, 4, 5, 290, False)
    assert image.metadata == {"exif": b"abc"} and [f.blend for f in image.frames] == [True, False, True]
    shown = [p for _, p, _ in compose.shown(image)]
    assert (shown[0] == 0xFFFF0000).all()
    assert (shown[1][2:, 2:] == 0xFF0000FF).all() and (shown[1][:2] == 0).all()
    assert (shown[2] == shown[1]).all()


def test_mutations_raise_only_image_errors():
    x = chunk(b"VP8X", bytes([container.ALPHA, 0, 0, 0, W - 1, 0, 0, H - 1, 0, 0]))
    data = riff(x, chunk(b"VP8L", payload(W, H, PICTURE)))
    n = len(data)
    bad = [data[:k] for k in (1, 8, 16, 32, n // 2, n - 2)] + [data[:k] + bytes([data[k] ^ 0x5A]) + data[k + 1 :] for k in (0, 1, 8, n // 4, n // 2, n - 1)]
    for b in bad:
        try:
            i = container.parse(b)
            [compose.decode_frame(f) for f in i.frames]
        except vp8l.ImageError:
            pass


def test_alpha_filters():
    values = RNG.integers(0, 256, (H, W)).astype(np.int64)
    for kind in range(4):
        rest = np.zeros_like(values)
        for y in range(H):
            for x in range(W):
                left, top = (values[y, x - 1] if x else None), (values[y - 1, x] if y else None)
                guess = 0
                if kind == 1:
                    guess = left if x else top if y else 0
                elif kind == 2:
                    guess = top if y else left if x else 0
                elif kind == 3:
                    guess = min(max(left + top - values[y - 1, x - 1], 0), 255) if x and y else left if x else top if y else 0
                rest[y, x] = (values[y, x] - guess) & 255
        chunk_ = bytes([kind << 2]) + rest.astype(np.uint8).tobytes()
        assert (compose.alpha_plane(chunk_, W, H) == values).all()


def test_scaling_vectors():
    p = np.array([[1, 2], [3, 4]], np.uint32)
    assert compose.nearest(p, 4, 4).tolist() == [[1, 1, 2, 2]] * 2 + [[3, 3, 4, 4]] * 2
    p = np.array([[0, 100], [200, 44]], np.uint32)
    assert compose.bilinear(p, 3, 3).tolist() == [[0, 50, 100], [100, 86, 72], [200, 122, 44]]


def test_reader_and_stream(spark, tmp_path):
    x = chunk(b"VP8L", payload(W, H, PICTURE))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.webp").write_bytes(riff(x))
    (tmp_path / "in" / "b.WEBP").write_bytes(b"RIFFnot an image")
    (tmp_path / "in" / "c.txt").write_bytes(b"")
    raw = images.files(spark, str(tmp_path / "in"))
    head = {r.image_id[-6:]: r for r in images.headers(raw).collect()}
    assert head["a.webp"].source_width == W and head["b.WEBP"]._corrupt and len(head) == 2
    shown = images.frames(raw, mode="DROPMALFORMED").collect()
    assert [v & 0xFFFFFFFF for v in shown[0].argb] == PICTURE and len(shown) == 1
    small = images.frames(raw, width=3, smooth=False, mode="DROPMALFORMED").first()
    assert (small.width, small.height) == (3, H)


def test_files_that_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folders = [str(tmp_path / x) for x in ("in", "table", "checkpoint")]

    def run():
        arrivals.keep_images(arrivals.arriving(spark, folders[0]), *folders[1:]).awaitTermination(60)
        return spark.read.parquet(folders[1])

    (tmp_path / "in" / "a.webp").write_bytes(riff(chunk(b"VP8L", payload(W, H, PICTURE))))
    assert [r.source_width for r in run().collect()] == [W]
    (tmp_path / "in" / "b.WEBP").write_bytes(b"RIFFnot an image")
    (tmp_path / "in" / "c.txt").write_bytes(b"")
    assert sorted(r._corrupt is None for r in run().collect()) == [False, True]  # the first file isn't read again
    totals = arrivals.totals_by_window(arrivals.arriving(spark, folders[0]), "1 day")
    totals.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("totals").selectExpr("sum(files)", "sum(malformed)", "sum(frames)").first()[:] == (2, 1, 1)


def test_a_header_of_a_huge_canvas_is_an_error_not_an_allocation(spark):
    x = chunk(b"VP8X", bytes([container.ANIMATED, 0, 0, 0]) + b"\xff" * 6)
    data = riff(x, anmf(0, 0, 4, 4, 40, 1, payload(4, 4, [1] * 16)))
    assert len(data) < 2000
    with pytest.raises(vp8l.ImageError):
        container.parse(data)
    raw = spark.createDataFrame([("huge", data), ("none", None)], "image_id string, content binary")
    assert all(r._corrupt for r in images.frames(raw).collect()) and images.frames(raw, mode="DROPMALFORMED").count() == 0


def test_alpha_chunk_of_a_lossless_frame_counts_as_lossy():
    x = chunk(b"VP8X", bytes([0, 0, 0, 0, 3, 0, 0, 3, 0, 0]))
    head = b"".join(v.to_bytes(3, "little") for v in (0, 0, 3, 3, 10)) + b"\0"
    data = riff(x, chunk(b"ANMF", head + chunk(b"ALPH", b"\0" * 17) + chunk(b"VP8L", payload(4, 4, [1] * 16))))
    assert container.parse(data).lossy and container.parse(data).loop_duration_ms == 0


def test_two_symbol_codes_and_cache_sizes():
    out = Out()
    for v, n in ((1, 1), (1, 1), (1, 1), (200, 8), (3, 8)):
        out.put(v, n)
    out.put(0b10, 2)
    bits = vp8l.Bits(out.bytes())
    code = vp8l._read_code(bits, 256)
    assert [code.read(bits), code.read(bits)] == [200, 3]
    out = Out()
    for v, n in ((1, 1), (1, 1), (1, 1), (9, 8), (9, 8), (1, 1)):
        out.put(v, n)
    bits = vp8l.Bits(out.bytes())
    code = vp8l._read_code(bits, 256)
    assert code.read(bits) == 9 and bits.read(1) == 0  # equal symbols take a bit too
    out = Out()
    for v, n in ((0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (1, 1), (0, 4)):
        out.put(v, n)
    with pytest.raises(vp8l.ImageError, match="cache"):
        vp8l.decode(out.bytes() + b"\0" * 8, 1, 1)


def test_unpredict_by_rows_is_unpredict_by_pixels():
    for width, height, bits in ((1, 1, 2), (9, 7, 2), (33, 20, 3), (5, 40, 2)):
        rest = RNG.integers(0, 1 << 32, (height, width), dtype=np.uint64).astype(np.uint32)
        modes = (RNG.integers(0, 16, (vp8l.subsample(height, bits), vp8l.subsample(width, bits))) << 8).astype(np.uint32)
        p = rest.ravel().tolist()
        for at in range(width * height):
            y, x = divmod(at, width)
            mode = int(modes[y >> bits, x >> bits]) >> 8
            if at == 0:
                guess = vp8l.OPAQUE
            elif y == 0 or x == 0:
                guess = p[at - 1] if y == 0 else p[at - width]
            elif mode > 13:
                continue
            else:
                guess = vp8l.PREDICTORS[mode](p[at - 1], p[at - width], p[at - width + 1], p[at - width - 1])
            p[at] = vp8l._sum(p[at], guess)
        vp8l.unpredict(rest, bits, modes)
        assert rest.ravel().tolist() == p


@pytest.mark.parametrize("strip", [1, 16, 1 << 22])
def test_strips_give_what_whole_canvases_give(spark, strip):
    from lumaframe.plans import encode

    pictures = [RNG.integers(0, 1 << 32, 64, dtype=np.uint64).tolist() for _ in range(12)]
    files = [(str(i), encode.composed_file(i, p)) for i, p in enumerate(pictures)]
    raw = spark.createDataFrame(files, "image_id string, content binary")
    placed = images.decode(images.frames_encoded(raw))
    got = {(r.image_id, r.frame_no): [v & 0xFFFFFFFF for v in r.argb] for r in images.compose_frames(placed, strip).collect()}
    assert len(got) == 36
    for i, data in files:
        for k, (ms, picture) in enumerate(images.read_frames(data)):
            assert got[i, k] == picture.ravel().tolist() and ms == 10 * (k + 1)


def test_an_animation_is_shown_up_to_its_corrupt_frame(spark):
    from lumaframe.plans import encode

    x = encode.extended(8, 8, container.ANIMATED)
    good, bad = (chunk(b"VP8L", encode.lossless([1 << 24] * 64, 8, 8)[:n]) for n in (None, 12))
    data = riff(x, *(encode.frame(0, 0, 8, 8, 10, True, False, part) for part in (good, bad, good)))
    rows = images.frames(spark.createDataFrame([("a", data)], "image_id string, content binary")).orderBy("frame_no").collect()
    assert [r.frame_no for r in rows] == [0, 1] and rows[0]._corrupt is None and rows[1]._corrupt and rows[1].argb is None


def test_frames_come_one_at_a_time():
    from lumaframe.plans import encode

    frames = [encode.frame(0, 0, 8, 8, 10, True, False, chunk(b"VP8L", encode.lossless([k << 24 | k] * 64, 8, 8))) for k in range(3)]
    broken = encode.frame(0, 0, 8, 8, 10, True, False, chunk(b"VP8L", encode.lossless([0] * 64, 8, 8)[:9]))
    left = images.read_frames(riff(encode.extended(8, 8, container.ANIMATED), *frames, broken))
    assert [next(left)[0] for _ in range(3)] == [10] * 3
    with pytest.raises(vp8l.ImageError):
        next(left)
    assert list(images.read_frames(riff(chunk(b"VP8L", payload(1, 1, [7])))))[0][1].tolist() == [[7]]


def test_chunk_types_and_numbers(spark):
    rows = spark.createDataFrame([(b"\xff\xfe\x80\x00\x01\x00\x00\xff",)], "c binary")
    from pyspark.sql import functions as F

    n = lambda *a: images.little_endian(F.col("c"), *a)
    got = rows.select(n(0, 2), n(0, 2, True), n(1, 3), n(0, 8), n(7, 2), images.chunk_type(F.lit("VP8 ")), images.chunk_type(F.lit("abcd")), images.chunk_code(F.lit("XMP"))).first()
    assert list(got) == [0xFEFF, -257, 0x80FE, int.from_bytes(b"\xff\xfe\x80\x00\x01\x00\x00\xff", "little", signed=True), None, "VP8", "UNKNOWN", "XMP "]
    with pytest.raises(Exception, match="no code"):
        rows.select(images.chunk_code(F.lit("UNKNOWN"))).collect()
    with pytest.raises(Exception, match="outside the frame"):
        spark.createDataFrame([(1, 1, [5])], "width int, height int, argb array<int>").select(images.pixel_at(1, 0)).collect()


def test_waves_give_what_rows_give(monkeypatch):
    """Mixed modes and each mode alone, odd sizes; and five times faster than a loop over pixels."""
    import time

    def both(width, height, bits, modes):
        rest = RNG.integers(0, 1 << 32, (height, width), dtype=np.uint64).astype(np.uint32)
        out, took = [], []
        for least in (0, 1 << 40):
            monkeypatch.setattr(vp8l, "WAVES_FROM", least)
            p, began = rest.copy(), time.perf_counter()
            vp8l.unpredict(p, bits, modes)
            took.append(time.perf_counter() - began)
            out.append(p)
        assert (out[0] == out[1]).all()
        return took

    blocks = lambda w, h, bits: (RNG.integers(0, 16, (vp8l.subsample(h, bits), vp8l.subsample(w, bits))) << 8).astype(np.uint32)
    for width, height, bits in ((1, 9, 2), (9, 1, 2), (2, 2, 2), (3, 50, 3), (50, 3, 2), (41, 37, 2), (64, 64, 9)):
        both(width, height, bits, blocks(width, height, bits))
    for mode in range(15):
        both(23, 17, 2, np.full((5, 6), mode << 8, np.uint32))
    waves, rows = both(1000, 1000, 9, np.full((2, 2), 11 << 8, np.uint32))
    assert 5 * waves < rows


def test_gradient_filter_by_waves():
    d = RNG.integers(0, 256, (37, 53)).astype(np.int64)
    want = np.zeros_like(d)
    for y in range(37):
        for x in range(53):
            guess = 0 if not x and not y else want[0, x - 1] if not y else want[y - 1, 0] if not x else min(max(want[y, x - 1] + want[y - 1, x] - want[y - 1, x - 1], 0), 255)
            want[y, x] = (d[y, x] + guess) & 255
    for h, w in ((37, 53), (37, 1), (1, 53), (2, 2), (37, 2), (2, 53)):
        part = want[:h, :w]
        assert (compose.unfilter(d[:h, :w], 3) == part).all()


def test_chunk_walk_in_the_jvm(spark):
    """The walk of the container helper, on whole and on damaged files, without a Python worker."""
    from lumaframe.plans import encode

    whole = [encode.sample_file(i, [i * 7 + k for k in range(64)]) for i in range(6)]
    many = riff(*(chunk(b"JUNK", bytes(k % 3)) for k in range(5000)))
    data = [*whole, many, many[:20001], None, b"", b"RIFF", riff(), riff(chunk(b"VP8L", b"x"))[:-1]]
    rng = np.random.default_rng(3)
    for d in whole:
        for _ in range(12):
            k = int(rng.integers(0, min(len(d), 60)))
            data += [d[:k], d[:k] + bytes([int(rng.integers(256))]) + d[k + 1 :]]

    def plain(d):
        out, at = [], 12
        try:
            for code, part in container.chunks(d or b"", 12, container.riff_end(d or b"")):
                out.append((len(out), code, len(part), part, None))
        except ValueError as e:
            out.append((len(out), None, None, None, str(e)))
        return out

    raw = spark.createDataFrame([(str(i), d) for i, d in enumerate(data)], "image_id string, content binary")
    found = images.chunks(raw)
    got = {}
    for r in found.collect():
        got.setdefault(r.image_id, []).append((r.seq, r.fourcc, r.size, None if r.payload is None else bytes(r.payload), r._corrupt))
    for i, d in enumerate(data):
        assert sorted(got.get(str(i), [])) == plain(d), (i, d and d[:40])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
