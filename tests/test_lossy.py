"""Lossy key frames: an encoder of the tests' own writes them, plain scalar versions check each step."""

import numpy as np
import pytest

from lumaframe.kernels import vp8
from lumaframe.plans import encode_lossy
from lumaframe.kernels.vp8l import ImageError
from lumaframe.sources import images

RNG = np.random.default_rng(7)
VALUES = RNG.integers(1, 255, 3012)
TABLES = vp8.Tables.parse(" ".join(map(str, VALUES)))


def frame(*of, **how):
    return encode_lossy.frame(TABLES, *of, **how)


def random_blocks(n, most=2000, share=0.15):
    out = []
    for _ in range(n):
        values = RNG.integers(-most, most, (25, 16)) * (RNG.random((25, 16)) < share) // (1 + RNG.integers(0, 900, (25, 16)))
        mode = int(RNG.integers(0, 5))
        if mode == vp8.SPLIT:
            values[24] = 0
        else:
            values[:16, 0] = 0
        out.append((mode, RNG.integers(0, 10, 16).tolist(), int(RNG.integers(0, 4)), values))
    return out


def test_flat_frame():
    p = vp8.decode(frame(20, 18, [(vp8.DC, None, vp8.DC, np.zeros((25, 16), int))] * 4), TABLES)
    assert p.shape == (18, 20) and set(p.ravel().tolist()) == {0xFF828282}


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_modes_and_tokens_round_trip(parts):
    blocks = random_blocks(12)
    blocks[5] = (*blocks[5][:3], None)
    h, b = vp8.read_header(frame(64, 48, blocks, parts, skip_prob=90), TABLES)
    got, coefficients = vp8._read_macroblocks(h, b, TABLES)
    for k, (mode, submodes, chroma, values) in enumerate(blocks):
        assert (got[k].mode, got[k].chroma, got[k].coded) == (mode, chroma, values is not None)
        assert mode != vp8.SPLIT or got[k].submodes == submodes
        steps, own = vp8.steps(h, 0), coefficients[k // 4, k % 4]
        for i in range(25):
            dc, ac = steps[0 if i < 16 else 1 if i == 24 else 2]
            want = np.zeros(16, int)
            if values is not None:
                want[list(vp8.ZIGZAG)] = values[i] * np.array([dc] + [ac] * 15)
            assert own[i].tolist() == want.tolist()


def test_transforms():
    c = RNG.integers(-400, 400, (50, 4, 4))
    k = np.arange(4)
    basis = np.cos((2 * k[:, None] + 1) * k * np.pi / 8) * np.where(k, np.sqrt(0.5), 0.5)
    assert np.abs(vp8.inverse_dct(c) - basis @ c @ basis.T / 2).max() <= 2
    w = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]])
    assert (vp8.inverse_wht(c) == (w.T @ c @ w + 3 >> 3)).all()


def test_block_modes_on_named_pixels():
    a, left, p = [10, 20, 40, 80, 90, 100, 130, 200], [11, 31, 71, 151], 5
    avg = lambda *v: (sum(v) + len(v) // 2) // len(v)
    three = lambda x, y, z: (x + 2 * y + z + 2) // 4
    at = {m: vp8.predict_block(m, a, left, p) for m in range(10)}
    assert at[vp8.B_DC][2, 1] == avg(*a[:4], *left)
    assert at[vp8.B_TM][3, 3] == 151 + 80 - 5
    assert at[vp8.B_VE][2].tolist() == [three(5, 10, 20), three(10, 20, 40), three(20, 40, 80), three(40, 80, 90)]
    assert at[vp8.B_HE][:, 3].tolist() == [three(5, 11, 31), three(11, 31, 71), three(31, 71, 151), three(71, 151, 151)]
    assert (at[vp8.B_LD][0, 0], at[vp8.B_LD][3, 3]) == (three(10, 20, 40), three(130, 200, 200))
    assert (at[vp8.B_RD][3, 0], at[vp8.B_RD][1, 1], at[vp8.B_RD][0, 3]) == (three(151, 71, 31), three(11, 5, 10), three(20, 40, 80))
    assert (at[vp8.B_VR][3, 0], at[vp8.B_VR][2, 0], at[vp8.B_VR][0, 3], at[vp8.B_VR][3, 1]) == (three(71, 31, 11), three(31, 11, 5), avg(40, 80), three(11, 5, 10))
    assert (at[vp8.B_VL][0, 0], at[vp8.B_VL][1, 3], at[vp8.B_VL][2, 3], at[vp8.B_VL][3, 3]) == (avg(10, 20), three(80, 90, 100), three(90, 100, 130), three(100, 130, 200))
    assert (at[vp8.B_HD][3, 0], at[vp8.B_HD][0, 0], at[vp8.B_HD][0, 3], at[vp8.B_HD][2, 3]) == (avg(151, 71), avg(11, 5), three(10, 20, 40), three(31, 11, 5))
    assert (at[vp8.B_HU][0, 0], at[vp8.B_HU][2, 1], at[vp8.B_HU][3, 3]) == (avg(11, 31), three(71, 151, 151), 151)


def plain_filter(row, kind, edge, inner, high):
    """One line of eight pixels, step by step."""
    c = lambda x: max(-128, min(127, x))
    p3, p2, p1, p0, q0, q1, q2, q3 = row
    if abs(p0 - q0) * 2 + abs(p1 - q1) // 2 > edge:
        return row
    if kind != "simple" and max(abs(x - y) for x, y in ((p3, p2), (p2, p1), (p1, p0), (q3, q2), (q2, q1), (q1, q0))) > inner:
        return row
    p3, p2, p1, p0, q0, q1, q2, q3 = (x - 128 for x in row)
    varied = abs(p1 - p0) > high or abs(q1 - q0) > high
    if kind == "macro" and not varied:
        w = c(c(p1 - q1) + 3 * (q0 - p0))
        a, b, d = (c((k * w + 63) >> 7) for k in (27, 18, 9))
        out = [p3, c(p2 + d), c(p1 + b), c(p0 + a), c(q0 - a), c(q1 - b), c(q2 - d), q3]
    else:
        a = c((c(p1 - q1) if kind != "block" or varied else 0) + 3 * (q0 - p0))
        f, g = c(a + 4) >> 3, c(a + 3) >> 3
        out = [p3, p2, p1, c(p0 + g), c(q0 - f), q1, q2, q3]
        if kind == "block" and not varied:
            out[5], out[2] = c(q1 - ((f + 1) >> 1)), c(p1 + ((f + 1) >> 1))
    return [x + 128 for x in out]


@pytest.mark.parametrize("kind", ["simple", "block", "macro"])
def test_edge_filter(kind):
    for spread in (3, 12, 60):
        rows = np.clip(RNG.integers(0, 256, (400, 1)) + RNG.integers(-spread, spread + 1, (400, 8)), 0, 255)
        want = [plain_filter(r, kind, 40, 12, 2) for r in rows.tolist()]
        vp8.filter_edge(rows, kind, 40, 12, 2)
        assert rows.tolist() == want


@pytest.mark.parametrize("simple", [False, True])
def test_loop_filter_of_a_frame(simple):
    blocks = random_blocks(6, most=60)
    raw = frame(48, 32, blocks, level=30, sharpness=3, simple=simple)
    h, planes = vp8.decode_planes(raw, TABLES)
    h, b = vp8.read_header(raw, TABLES)
    got, coefficients = vp8._read_macroblocks(h, b, TABLES)
    own = vp8._reconstruct(got, vp8._residuals(got, coefficients))
    high = 1
    inner = min(30 >> 1, 9 - 3)
    for k, m in enumerate(got):
        y, x = divmod(k, 3)
        for plane, n in zip(own, (16, 8, 8), strict=True):
            for turned in (False, True):
                p, row, column = (plane.T, x, y) if turned else (plane, y, x)
                for step in range(0, n, 4):
                    at = n * column + step
                    if not at or (step and not m.coded and m.mode != vp8.SPLIT) or (simple and n == 8):
                        continue
                    kind = "simple" if simple else "block" if step else "macro"
                    for line in range(n * row, n * row + n):
                        p[line, at - 4 : at + 4] = plain_filter(p[line, at - 4 : at + 4].tolist(), kind, (60 if step else 64) + inner, inner, high)
    for a, b in zip(planes, own, strict=True):
        assert (a == b).all()


def test_chroma_upsampling():
    plane = RNG.integers(0, 256, (4, 5))
    assert (vp8.upsample(plane, 9, 7, False) == plane.repeat(2, 0).repeat(2, 1)[:7, :9]).all()
    fancy = vp8.upsample(plane, 9, 7, True)
    for y in range(7):
        for x in range(9):
            ny, nx = min(max(y // 2 + (1 if y % 2 else -1), 0), 3), min(max(x // 2 + (1 if x % 2 else -1), 0), 4)
            assert fancy[y, x] == (9 * plane[y // 2, x // 2] + 3 * plane[ny, x // 2] + 3 * plane[y // 2, nx] + plane[ny, nx] + 8) >> 4


def test_damage_raises_only_image_errors():
    good = frame(48, 32, random_blocks(6), 2, level=20)
    for k in range(120):
        bad = bytearray(good[: int(RNG.integers(0, len(good)))] if k % 3 == 0 else good)
        for at in RNG.integers(0, max(1, len(bad)), 4):
            if at < len(bad) and not 6 <= at < 10:
                bad[at] = int(RNG.integers(0, 256))
        try:
            vp8.decode(bytes(bad), TABLES)
        except ImageError:
            pass
    with pytest.raises(ImageError):
        vp8.decode(good[: len(good) // 2], TABLES)
    with pytest.raises(ValueError):
        vp8.Tables.parse("1 2 3")


def test_reader_of_lossy_files_with_alpha(spark, tmp_path):
    payload = frame(20, 18, random_blocks(4))
    alpha = bytes(RNG.integers(0, 256, 20 * 18).tolist())
    chunk = lambda code, data: code + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    body = b"WEBP" + chunk(b"VP8X", bytes([16, 0, 0, 0, 19, 0, 0, 17, 0, 0])) + chunk(b"ALPH", b"\0" + alpha) + chunk(b"VP8 ", payload)
    (tmp_path / "a.webp").write_bytes(b"RIFF" + len(body).to_bytes(4, "little") + body)
    (tmp_path / "tables.txt").write_text(", ".join(map(str, VALUES)))
    tables, raw = images.lossy_tables(spark, str(tmp_path / "tables.txt")), images.files(spark, str(tmp_path))
    (row,) = images.frames(raw, lossy=tables).collect()
    want = vp8.decode(payload, TABLES) & np.uint32(0xFFFFFF) | np.frombuffer(alpha, np.uint8).reshape(18, 20).astype(np.uint32) << np.uint32(24)
    assert row._corrupt is None and row.argb == want.ravel().view("int32").tolist()
    (row,) = images.frames(raw).collect()
    assert "tables" in row._corrupt
    spark.conf.set(images.LOSSY_TABLES, str(tmp_path / "tables.txt"))
    try:
        (row,) = images.frames(raw).collect()
    finally:
        spark.conf.unset(images.LOSSY_TABLES)
    assert row.argb == want.ravel().view("int32").tolist()
