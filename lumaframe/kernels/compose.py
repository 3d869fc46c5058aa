"""Alpha planes, animation canvases and scaling on numpy arrays of unsigned 32-bit pixels."""

from __future__ import annotations

import math

import numpy as np

from . import vp8, vp8l
from .container import Frame, Image
from .vp8l import ImageError


def alpha_plane(chunk: bytes, width: int, height: int) -> np.ndarray:
    """The alpha of a frame, unfiltered. Preprocessing is accepted and has no effect."""
    if not chunk:
        raise ImageError("an empty alpha chunk")
    method, kind, prepared = chunk[0] & 3, chunk[0] >> 2 & 3, chunk[0] >> 4 & 3
    if method > 1 or prepared > 1:
        raise ImageError("an unknown alpha method")
    if method == 0:
        if len(chunk) - 1 != width * height:
            raise ImageError("an alpha plane of another size")
        d = np.frombuffer(chunk, np.uint8, offset=1).reshape(height, width).astype(np.int64)
    else:
        d = (vp8l.decode(chunk[1:], width, height, headless=True) >> 8 & 255).astype(np.int64)
    return unfilter(d, kind)


def unfilter(d: np.ndarray, kind: int) -> np.ndarray:
    """A plane as it was before filtering. kind: 0 none, 1 horizontal, 2 vertical, 3 gradient."""
    d = d.copy()
    height, width = d.shape
    if kind == 1:
        d[:, 0] = np.cumsum(d[:, 0])
        d = np.cumsum(d, axis=1)
    elif kind == 2:
        d[0] = np.cumsum(d[0])
        d = np.cumsum(d, axis=0)
    elif kind == 3:
        d[0] = np.cumsum(d[0]) & 255
        d[:, 0] = np.cumsum(d[:, 0]) & 255
        flat = d.ravel()
        for t in range(2, width + height - 1):  # places of one x + y need only those of smaller ones
            y = np.arange(max(1, t - width + 1), min(height, t))
            at = y * (width - 1) + t
            flat[at] = flat[at] + np.clip(flat[at - 1] + flat[at - width] - flat[at - width - 1], 0, 255) & 255
    return (d & 255).astype(np.uint32)


def decode_frame(f: Frame, tables: vp8.Tables | None = None, fancy: bool = False) -> np.ndarray:
    """tables: the probabilities that lossy payloads need; fancy: their chroma is made larger smoothly."""
    if f.lossless:
        return vp8l.decode(bytes(f.payload), f.width, f.height)
    if tables is None:
        raise ImageError("a lossy payload, and no probability tables given")
    out = vp8.decode(bytes(f.payload), tables, fancy)
    if f.alpha is None:
        return out
    return out & np.uint32(0xFFFFFF) | alpha_plane(bytes(f.alpha), f.width, f.height) << np.uint32(24)


def blend(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    s, d = src.astype(np.int64), dst.astype(np.int64)
    sa, da = s >> 24, d >> 24
    w = da * (255 - sa) + 128
    kept = w + (w >> 8) >> 8
    both = sa + kept
    scale = (1 << 24) // np.maximum(both, 1)
    out = both << 24
    for shift in (16, 8, 0):
        out |= (((s >> shift & 255) * sa + (d >> shift & 255) * kept) * scale >> 24 & 255) << shift
    return np.where(sa == 0, d, np.where((sa == 255) | (da == 0), s, out)).astype(np.uint32)


def paint(canvas: np.ndarray, size: tuple[int, int], first: int, f, before, picture: np.ndarray) -> np.ndarray:
    """The canvas's rows from `first` on after frame f. size: (width, height) of the whole canvas; before: the
    frame shown until now, whose rectangle is cleared to transparent if it says so; picture: those rows of the
    frame that lie among the canvas's rows."""
    whole = (f.width, f.height) == size
    if whole and not f.blend:
        return picture.copy()
    rows = lambda r: slice(max(r.y - first, 0), max(r.y + r.height - first, 0))
    if before is None or before.dispose:
        if whole or before is None:
            canvas[:] = 0
        else:
            canvas[rows(before), before.x : before.x + before.width] = 0
    if len(picture):
        at = rows(f), slice(f.x, f.x + f.width)
        canvas[at] = blend(picture, canvas[at]) if f.blend else picture
    return canvas


class Canvas:
    """What an animation shows; holds one canvas and the frame that was added last."""

    def __init__(self, width: int, height: int):
        self.size, self.before, self.pixels = (width, height), None, np.zeros((height, width), np.uint32)

    def add(self, f, picture: np.ndarray) -> np.ndarray:
        """The canvas with frame f, of these pixels, on it; the next frame may write into the array."""
        self.pixels = paint(self.pixels, self.size, 0, f, self.before, picture)
        self.before = f
        return self.pixels


def shown(image: Image, tables: vp8.Tables | None = None, fancy: bool = False):
    """(frame, pixels as shown or None, error or None), decoded when they are asked for. An animation ends with its
    first corrupt frame; a still image's frames are each on their own."""
    canvas = Canvas(image.width, image.height) if image.animated else None
    for f in image.frames:
        try:
            picture = decode_frame(f, tables, fancy)
            yield f, canvas.add(f, picture).copy() if canvas else picture, None
        except (ValueError, IndexError, MemoryError) as e:
            yield f, None, str(e) or type(e).__name__
            if canvas:
                return


def target_size(width: int, height: int, want_width: float, want_height: float, preserve_ratio: bool) -> tuple[int, int]:
    """Z1 for one image; a wanted size of 0 or less is unset."""
    whole = lambda v: max(1, math.floor(v + 0.5))
    by_w, by_h = want_width / width, want_height / height
    if not preserve_ratio:
        return whole(want_width) if want_width > 0 else width, whole(want_height) if want_height > 0 else height
    if want_width > 0 and want_height > 0:
        return whole(width * min(by_w, by_h)), whole(height * min(by_w, by_h))
    if want_width > 0:
        return whole(want_width), whole(height * by_w)
    return (whole(width * by_h), whole(want_height)) if want_height > 0 else (width, height)


def nearest(p: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = p.shape
    return p[np.minimum(h - 1, np.arange(height) * h // height)[:, None], np.minimum(w - 1, np.arange(width) * w // width)]


def places(n: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of `target` places the two of n between which it lies, and how far, corner to corner in single precision."""
    one = np.float32
    step = one(n - 1) / one(target - 1) if target > 1 else one(0)
    at = np.arange(target, dtype=one) * step
    low = np.minimum(n - 1, at.astype(np.int64))
    return low, np.minimum(n - 1, low + 1), at - low.astype(one)


def between(p: np.ndarray, rows: tuple, columns: tuple) -> np.ndarray:
    """Pixels between those of p (or of each of several pictures of one size) at these places, each channel by itself."""
    (y0, y1, fy), (x0, x1, fx) = rows, columns
    out = np.zeros((*p.shape[:-2], len(y0), len(x0)), np.uint32)
    for shift in (24, 16, 8, 0):
        c = (p >> np.uint32(shift) & np.uint32(255)).astype(np.float32)
        top = c[..., y0, :][..., x0] + (c[..., y0, :][..., x1] - c[..., y0, :][..., x0]) * fx
        low = c[..., y1, :][..., x0] + (c[..., y1, :][..., x1] - c[..., y1, :][..., x0]) * fx
        value = top + (low - top) * fy[:, None]
        out |= np.floor(value.astype(np.float64) + 0.5).astype(np.uint32) << np.uint32(shift)
    return out


def bilinear(p: np.ndarray, width: int, height: int) -> np.ndarray:
    """Corner to corner, in single precision, each channel by itself."""
    return between(p, places(p.shape[0], height), places(p.shape[1], width))
