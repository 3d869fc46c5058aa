"""Z2-Z4 and F8 on frames cut into tiles, so that no row holds more than one tile of a frame of any size.

A tile row is (image_id, frame_no, width, height, side, tx, ty, argb): tile (tx, ty) of a frame of width x height
pixels, row by row; all tiles have side x side pixels but for those at the right and lower edge. What a target tile needs
is picked from the source tiles where they are: a source tile gives for each target tile the pixels that lie in it, so
a shuffle carries the pixels of the result, never those of a source that is made smaller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import pixels as px
from lumaframe.kernels import compose
from lumaframe.operators import groups

TILE = "image_id string, frame_no int, width int, height int, side int, tx int, ty int, argb array<int>"
KEYS = ["image_id", "frame_no", "tx", "ty"]
SIDE = 256


def tiles(frames: DataFrame, side: int = SIDE) -> DataFrame:
    """Frames (image_id, frame_no, width, height, argb) as tiles; nothing is shuffled. Frames without pixels have none."""
    last = lambda c: F.floor((F.col(c) - 1) / side).cast("int")
    rows = frames.where("argb is not null").select("image_id", "frame_no", "width", "height", F.lit(side).alias("side"), "argb", F.explode(F.sequence(F.lit(0), last("width"))).alias("tx"))
    rows = rows.withColumn("ty", F.explode(F.sequence(F.lit(0), last("height"))))
    x, y = F.col("tx") * side, F.col("ty") * side
    part = F.flatten(F.transform(F.sequence(y, F.least(y + side, F.col("height")) - 1), lambda r: F.slice("argb", r * F.col("width") + x + 1, F.least(F.lit(side), F.col("width") - x))))
    return rows.select("image_id", "frame_no", "width", "height", "side", "tx", "ty", part.alias("argb"))


def blend(over: DataFrame, under: DataFrame) -> DataFrame:
    """F8: tiles of `over` on the tiles of `under` at the same places, cut alike. Tiles that only one side has are left
    out. One join by tile, so a hot image is dealt over as many keys as it has tiles."""
    below = under.select(*KEYS, "side", F.col("argb").alias("below"))
    mixed = F.zip_with("argb", "below", lambda p, q: px.signed(px.blend(px.wide(p), px.wide(q))).cast("int"))
    return over.join(below, [*KEYS, "side"]).select("image_id", "frame_no", "width", "height", "side", "tx", "ty", mixed.alias("argb"))


def with_halo(rows: DataFrame) -> DataFrame:
    """Tiles with `right`, `below` and `corner`: the first column, row and pixel of the tiles to the right, below, and
    both; null at the frame's edges. Each tile sends its own edge to its neighbours: one shuffle of the tiles."""
    wide = F.least("side", F.col("width") - F.col("tx") * F.col("side"))
    column = F.transform(F.sequence(F.lit(0), F.floor(F.size("argb") / wide).cast("int") - 1), lambda y: F.get("argb", y * wide))

    def send(dx: int, dy: int, **part) -> Column:
        kinds = {"own": "array<int>", "right": "array<int>", "below": "array<int>", "corner": "int"}
        return F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), *(part.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()))

    sent = F.array(send(0, 0, own=F.col("argb")), send(1, 0, right=column), send(0, 1, below=F.slice("argb", F.lit(1), wide)), send(1, 1, corner=F.get("argb", F.lit(0))))
    parts = rows.select("image_id", "frame_no", "width", "height", "side", "tx", "ty", F.explode(sent).alias("s")).where("tx >= s.dx and ty >= s.dy")
    parts = parts.select("image_id", "frame_no", "width", "height", "side", (F.col("tx") - F.col("s.dx")).alias("tx"), (F.col("ty") - F.col("s.dy")).alias("ty"), "s.own", "s.right", "s.below", "s.corner")
    whole = parts.groupBy("image_id", "frame_no", "width", "height", "side", "tx", "ty").agg(*(F.first(c, True).alias(c) for c in ("own", "right", "below", "corner")))
    return whole.withColumnRenamed("own", "argb")


def _spread(places: np.ndarray, first: int, end: int, last: bool, side: int) -> Iterator[tuple[int, np.ndarray]]:
    """(target tile, target places) of those whose source place lies from first to end (to the last: no end)."""
    own = np.arange(np.searchsorted(places, first), len(places) if last else np.searchsorted(places, end))
    for t in np.unique(own // side).tolist():
        yield t, own[own // side == t]


#: Pixels that are worked on or handed on at once.
AT_ONCE = 1 << 20


def _lists(column: pa.Array, which: np.ndarray, size: int) -> np.ndarray:
    """The lists of these rows, all of one size, as a matrix of unsigned numbers."""
    ends = column.offsets.to_numpy()
    if (ends[which + 1] - ends[which] != size).any():
        raise ValueError("a tile with another number of pixels")
    values = column.values.to_numpy(zero_copy_only=False).astype(np.int32, copy=False).view(np.uint32)
    return values[ends[which].astype(np.int64)[:, None] + np.arange(size)]


def _with_edges(batch: pa.RecordBatch, which: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Tiles of one form with one more column and row: those of the neighbours, or at the frame's edges their own last."""
    _, h, w = own.shape
    out = np.pad(own, ((0, 0), (0, 1), (0, 1)), mode="edge")
    right, below, corner = (batch.column(c).is_valid().to_numpy(zero_copy_only=False)[which] for c in ("right", "below", "corner"))
    if right.any():
        out[right, :h, w] = _lists(batch.column("right"), which[right], h)
    if below.any():
        out[below, h, :w] = _lists(batch.column("below"), which[below], w)
    out[:, h, w] = np.where(below, out[:, h, w - 1], out[:, h - 1, w])
    if corner.any():
        out[corner, h, w] = batch.column("corner").take(pa.array(which[corner])).to_numpy().view(np.uint32)
    return out


def _fragments(width: float, height: float, preserve_ratio: bool, smooth: bool, side: int):
    """Tiles, with halos if smooth, to what they give to the target's tiles. Tiles of one form (size and place) are worked on
    together."""
    names = ["image_id", "frame_no", "width", "height", "tx", "ty", "x", "y", "w", "h", "argb"]

    def parts(batch: pa.RecordBatch, which: np.ndarray, form: list[int]) -> Iterator[pa.RecordBatch]:
        whole_w, whole_h, cut, tile_x, tile_y = form
        tw, th = compose.target_size(whole_w, whole_h, width, height, preserve_ratio)
        x0, y0 = tile_x * cut, tile_y * cut
        w, h = min(cut, whole_w - x0), min(cut, whole_h - y0)
        near_only = (tw, th) == (whole_w, whole_h) or not smooth
        if near_only:
            near = lambda n, target: np.minimum(n - 1, np.arange(target) * n // target)
            columns, lines = near(whole_w, tw), near(whole_h, th)
        else:
            (columns, _, fx), (lines, _, fy) = compose.places(whole_w, tw), compose.places(whole_h, th)
        needed = [(ty, ys, tx, xs) for ty, ys in _spread(lines, y0, y0 + h, y0 + h == whole_h, side) for tx, xs in _spread(columns, x0, x0 + w, x0 + w == whole_w, side)]
        step = max(1, AT_ONCE // max([w * h, *(len(ys) * len(xs) for _, ys, _, xs in needed)]))
        for own_rows in (which[k : k + step] for k in range(0, len(which), step)):
            own, n = _lists(batch.column("argb"), own_rows, w * h).reshape(-1, h, w), len(own_rows)
            if not near_only:
                own = _with_edges(batch, own_rows, own)
            keys = batch.select(["image_id", "frame_no"]).take(pa.array(own_rows))
            for ty, ys, tx, xs in needed:
                at_y, at_x = lines[ys] - y0, columns[xs] - x0
                part = own[:, at_y[:, None], at_x] if near_only else compose.between(own, (at_y, at_y + 1, fy[ys]), (at_x, at_x + 1, fx[xs]))
                fixed = [pa.array(np.full(n, v, np.int32)) for v in (tw, th, tx, ty, xs[0], ys[0], len(xs), len(ys))]
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * (len(xs) * len(ys)))
                yield pa.RecordBatch.from_arrays([*keys.columns, *fixed, pa.ListArray.from_arrays(ends, pa.array(part.ravel().view(np.int32)))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            every, form = np.unique(np.stack([batch.column(c).to_numpy() for c in ("width", "height", "side", "tx", "ty")], axis=1), axis=0, return_inverse=True)
            order = np.argsort(form.ravel(), kind="stable")
            for f, which in zip(every.tolist(), np.split(order, np.cumsum(np.bincount(form.ravel()))[:-1]), strict=True):
                for part in parts(batch, which, f):
                    waiting.append(part)
                    held += len(part.column("argb").values)
                    if held >= AT_ONCE:
                        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                        waiting, held = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    return run


def _assembled(side: int):
    """Fragments sorted by target tile to the tiles, many at once: each pixel goes to its place of its tile."""
    names = [x.split()[0] for x in TILE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in groups.whole_groups(batches, KEYS, lambda t: groups.numbers(t, "w") * groups.numbers(t, "h"), AT_ONCE):
            c = {n: groups.numbers(table, n) for n in ("width", "height", "tx", "ty", "x", "y", "w", "h")}
            x0, y0 = c["tx"] * side, c["ty"] * side
            wide, size = np.minimum(side, c["width"] - x0), np.minimum(side, c["height"] - y0)
            ends = np.r_[0, np.cumsum((wide * size)[first])]
            start = np.repeat(ends[:-1], np.diff([*first, table.num_rows])) + (c["y"] - y0) * wide + c["x"] - x0
            n = c["w"] * c["h"]
            row = np.repeat(np.arange(len(n)), n)
            line, column = np.divmod(np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), c["w"][row])
            out = np.zeros(ends[-1], np.int32)
            out[start[row] + line * wide[row] + column] = table.column("argb").combine_chunks().flatten().to_numpy()
            head = table.select(["image_id", "frame_no", "width", "height", "tx", "ty"]).take(pa.array(first))
            own = {n: head.column(n).combine_chunks() for n in head.column_names}
            own |= {"side": pa.array(np.full(len(first), side, np.int32)), "argb": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))}
            yield pa.RecordBatch.from_arrays([own[n] for n in names], names)

    return run


def scale(rows: DataFrame, width: float = 0, height: float = 0, preserve_ratio: bool = False, smooth: bool = True, side: int = SIDE) -> DataFrame:
    """Tiles of the frames at the wanted size (0: unset), `side` pixels wide and high: what one-row scaling gives.

    Smooth scaling takes halos from the neighbours first. A target tile is put together from at most side * side
    pixels, in fragments of one pixel at least, so a group is bounded whatever the frame's size; many small tiles go together."""
    source = with_halo(rows) if smooth else rows
    schema = "image_id string, frame_no int, width int, height int, tx int, ty int, x int, y int, w int, h int, argb array<int>"
    parts = source.mapInArrow(_fragments(width, height, preserve_ratio, smooth, side), schema)
    return parts.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_assembled(side), TILE)


def pixels(rows: DataFrame) -> DataFrame:
    """(image_id, frame_no, x, y, argb), one row a pixel."""
    one = rows.select("image_id", "frame_no", "side", "tx", "ty", F.least("side", F.col("width") - F.col("tx") * F.col("side")).alias("w"), F.posexplode("argb").alias("at", "argb"))
    x, y = F.col("tx") * F.col("side") + F.col("at") % F.col("w"), F.col("ty") * F.col("side") + F.floor(F.col("at") / F.col("w")).cast("int")
    return one.select("image_id", "frame_no", x.alias("x"), y.alias("y"), "argb")
