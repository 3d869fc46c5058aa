"""The RIFF container of still and animated images: bytes to header and frame descriptors."""

from __future__ import annotations

from dataclasses import dataclass, field

from .vp8l import ImageError

ANIMATED, XMP, EXIF, ALPHA, ICC = 2, 4, 8, 16, 32
LARGEST = 16384
#: Pixels of a canvas; a header may claim 2 ** 48 in a hundred bytes.
MOST_PIXELS = 1 << 28


@dataclass
class Frame:
    x: int
    y: int
    width: int
    height: int
    duration_ms: int
    blend: bool
    dispose: bool
    lossless: bool
    alpha: bytes | Part | None
    payload: bytes | Part


@dataclass
class Image:
    width: int
    height: int
    has_alpha: bool = False
    animated: bool = False
    lossy: bool = False
    loop_count: int = 1
    loop_duration_ms: int = 0
    background: bytes | None = None
    metadata: dict = field(default_factory=dict)
    frames: list[Frame] = field(default_factory=list)


class Part:
    """A stretch of something larger, of which bytes are read when they are asked for. read(at, n): n bytes."""

    def __init__(self, read, at: int, end: int):
        self.read, self.at, self.end = read, at, end

    def __len__(self) -> int:
        return self.end - self.at

    def __getitem__(self, k):
        if isinstance(k, int):
            return self[k : k + 1][0]
        first, end, _ = k.indices(len(self))
        return self.read(self.at + first, max(0, end - first))

    def __bytes__(self) -> bytes:
        return self[:]

    def part(self, first: int, end: int) -> Part:
        return Part(self.read, self.at + first, self.at + end)


def _le(data: bytes | Part, at: int, n: int) -> int:
    if at + n > len(data):
        raise ImageError("the file ends early")
    return int.from_bytes(data[at : at + n], "little")


def chunks(data: bytes | Part, at: int, end: int):
    """(code, payload) of each chunk; a chunk of odd size has a byte of padding. The declared size rules. Of a Part
    only the heads of chunks are read."""
    while at < end:
        size = _le(data, at + 4, 4)
        if at + 8 + size > len(data) or size > 0x7FFFFFFF:
            raise ImageError("a chunk ends early")
        yield data[at : at + 4].decode("latin-1"), data.part(at + 8, at + 8 + size) if isinstance(data, Part) else data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def riff_end(data: bytes) -> int:
    """Where the container ends by its own header."""
    size = _le(data, 4, 4)
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or size < 12:
        raise ImageError("not an image container")
    return 8 + size


def lossy_size(payload: bytes) -> tuple[int, int]:
    if len(payload) < 10 or payload[0] & 1 or payload[3:6] != b"\x9d\x01\x2a":
        raise ImageError("not a lossy key frame")
    return _le(payload, 6, 2) & 0x3FFF, _le(payload, 8, 2) & 0x3FFF


def lossless_head(payload: bytes) -> tuple[int, int, bool]:
    """Width, height and whether the header says that there is alpha."""
    head = _le(payload, 1, 4)
    if payload[:1] != b"\x2f" or head >> 29:
        raise ImageError("not a lossless payload")
    return (head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1, bool(head >> 28 & 1)


def _image_chunk(code: str, payload: bytes) -> tuple[int, int]:
    return lossy_size(payload) if code == "VP8 " else lossless_head(payload)[:2]


def _bounded(width: int, height: int, most_pixels: int) -> None:
    if width * height > most_pixels:
        raise ImageError("too many pixels")


def _animation_frame(data: bytes, canvas: Image) -> Frame:
    x, y = 2 * _le(data, 0, 3), 2 * _le(data, 3, 3)
    width, height, duration, flags = _le(data, 6, 3) + 1, _le(data, 9, 3) + 1, _le(data, 12, 3), _le(data, 15, 1)
    if max(width, height) > LARGEST or x + width > canvas.width or y + height > canvas.height:
        raise ImageError("a frame outside its canvas")
    alpha = image = None
    for code, payload in chunks(data, 16, len(data)):  # to the end: the last image and the last alpha count
        if code == "ALPH":
            alpha = payload
        elif code in ("VP8 ", "VP8L"):
            if _image_chunk(code, payload) != (width, height):
                raise ImageError("a frame's payload is of another size")
            image = code, payload
    if image is None:
        raise ImageError("a frame without an image")
    return Frame(x, y, width, height, duration, not flags & 2, bool(flags & 1), image[0] == "VP8L", alpha, image[1])


def parse(data: bytes | Part, most_pixels: int = MOST_PIXELS) -> Image:
    """Raises ImageError for anything malformed and for a canvas or a frame of more than most_pixels; bytes after
    the declared size are left alone."""
    parts = chunks(data, 12, riff_end(data))
    code, payload = next(parts)
    if code == "VP8 ":
        w, h = lossy_size(payload)
        _bounded(w, h, most_pixels)
        return Image(w, h, lossy=True, frames=[Frame(0, 0, w, h, 0, False, False, False, None, payload)])
    if code == "VP8L":
        w, h, alpha = lossless_head(payload)
        _bounded(w, h, most_pixels)
        return Image(w, h, has_alpha=alpha, frames=[Frame(0, 0, w, h, 0, False, False, True, None, payload)])
    if code != "VP8X":
        raise ImageError("an unknown first chunk")
    flags = _le(payload, 0, 1)
    out = Image(_le(payload, 4, 3) + 1, _le(payload, 7, 3) + 1, bool(flags & ALPHA), bool(flags & ANIMATED))
    _bounded(out.width, out.height, most_pixels)
    alpha = None
    for code, payload in parts:
        if code == "ANIM":
            out.background, out.loop_count = payload[:4], _le(payload, 4, 2)
        elif code == "ANMF":
            out.frames.append(_animation_frame(payload, out))
        elif code == "ALPH":
            alpha = payload
        elif code in ("VP8 ", "VP8L"):
            w, h = _image_chunk(code, payload)
            _bounded(w, h, most_pixels)
            out.frames.append(Frame(0, 0, w, h, 0, False, False, code == "VP8L", alpha if code == "VP8 " else None, payload))
            alpha = None
        else:
            for name, known, flag in (("icc", "ICCP", ICC), ("exif", "EXIF", EXIF), ("xmp", "XMP ", XMP)):
                if code == known and flags & flag:
                    out.metadata[name] = payload
    if not out.frames:
        raise ImageError("an image without frames")
    out.lossy = any(not f.lossless or f.alpha is not None for f in out.frames)
    out.loop_duration_ms = sum(f.duration_ms for f in out.frames) if out.animated else 0
    return out
