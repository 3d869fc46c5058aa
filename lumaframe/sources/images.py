"""Read image files as relations: chunks, images (headers and metadata), encoded frames, frames as shown, pixels.

A small helper a row parses a container or decodes one frame; the rest is DataFrame work. A file is read once, by a
task that shows its frames one by one. Long animations are composed by segments, each from a frame that needs no
earlier one, or by strips of the canvas. Batches that go to Python hold at most
spark.sql.execution.arrow.maxBytesPerBatch.

mode: PERMISSIVE keeps a malformed file as a row with _corrupt, DROPMALFORMED leaves it out, FAILFAST raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lumaframe.functions import pixels as px
from lumaframe.kernels import compose, container, vp8
from lumaframe.operators import animation, scaling

#: Chunk types that are known; any other is UNKNOWN.
CHUNK_TYPES = ("ALPH", "ANIM", "ANMF", "EXIF", "FRGM", "ICCP", "RIFF", "VP8 ", "VP8L", "VP8X", "XMP ")
HEADER = (
    "source_width int, source_height int, has_alpha boolean, animated boolean, lossy boolean, loop_count int, loop_duration_ms bigint, "
    "frame_count int, background_hint binary, metadata struct<icc:binary, exif:binary, xmp:binary>"
)
ENCODED = "x int, y int, width int, height int, duration_ms int, blend boolean, dispose boolean, lossless boolean, alpha binary, payload binary"
#: Pixels of all frames of a strip that is composed in one task.
STRIP_PIXELS = 1 << 22
#: Pixels that a task decodes before it hands them on, or a single frame of more.
DECODED_PIXELS = 1 << 21


def files(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, content) of the files with the image suffix, in any case, below path."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][eE][bB][pP]").option("recursiveFileLookup", "true")
    return read.load(path).select(F.col("path").alias("image_id"), "content")


#: Session setting that names the text file of the lossy format's probabilities.
LOSSY_TABLES = "spark.lumaframe.lossyTables"


def lossy_tables(spark: SparkSession, path: str) -> vp8.Tables:
    """The 3,012 probabilities of the lossy format, read from a text file."""
    return vp8.Tables.parse(spark.read.text(path, wholetext=True).first()[0])


def _checked(mode: str, out: DataFrame) -> DataFrame:
    if mode == "DROPMALFORMED":
        return out.where("_corrupt is null")
    if mode == "FAILFAST":
        return out.where(F.when(F.col("_corrupt").isNotNull(), F.raise_error(F.col("_corrupt")).cast("boolean")).otherwise(F.lit(True)))
    return out


def little_endian(content: Column, at, size: int, signed: bool = False) -> Column:
    """`size` bytes of a binary from place `at` (0: the first), as a number; null beyond its end. Eight
    bytes are signed."""
    part = F.substring(content, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(size))
    bytes_ = [F.conv(F.hex(F.substring(part, F.lit(k + 1), F.lit(1))), 16, 10).cast("long") for k in range(size)]
    value = bytes_[-1]
    if signed or size == 8:
        value = F.when(value > 127, value - 256).otherwise(value)
    for b in reversed(bytes_[:-1]):
        value = value * 256 + b
    return F.when(F.octet_length(part) == size, value)


def fourcc(content: Column, at: int) -> Column:
    """Four bytes as text; its order is that of the code."""
    return F.decode(F.substring(content, at + 1, 4), "ISO-8859-1")


def chunk_type(code: Column) -> Column:
    """The known type, or UNKNOWN."""
    return F.when(code.isin(*CHUNK_TYPES), F.rtrim(code)).otherwise(F.lit("UNKNOWN"))


def chunk_code(kind: Column) -> Column:
    """The code of a known type; an error for any other."""
    code = F.rpad(kind, 4, " ")
    return F.when(code.isin(*CHUNK_TYPES), code).otherwise(F.raise_error(F.concat(F.lit("no code: "), kind)).cast("string"))


def _walked(content: Column) -> Column:
    """C2 in the JVM: struct<at, error, found: array<struct<fourcc, at, size>>> of one file's chunks.

    A fold over as many steps as the file may have chunks of 8 bytes, 64 * 64 of them in each outer step; once the walk
    has ended, inner folds are over nothing."""
    empty = F.expr("cast(array() as array<struct<fourcc:string, at:bigint, size:bigint>>)")

    def state(at: Column, error: Column, found: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), error.cast("string").alias("error"), found.alias("found"))

    def of(c: Column) -> Column:
        length, riff = F.octet_length(c).cast("long"), little_endian(c, 4, 4)
        end = 8 + riff
        early, wrong = F.lit("the file ends early"), F.lit("not an image container")
        fault = F.when(riff.isNull(), early).when((fourcc(c, 0) != "RIFF") | (F.coalesce(fourcc(c, 8), F.lit("")) != "WEBP") | (riff < 12), wrong)
        ended = lambda s: s["error"].isNotNull() | (s["at"] >= end)

        def step(s: Column, _: Column) -> Column:
            at = s["at"]
            size = little_endian(c, at.cast("int") + 4, 4)
            error = F.when(size.isNull(), early).when((at + 8 + size > length) | (size > 0x7FFFFFFF), F.lit("a chunk ends early"))
            code = F.decode(F.substring(c, at.cast("int") + 1, F.lit(4)), "ISO-8859-1")
            more = F.concat(s["found"], F.array(F.struct(code.alias("fourcc"), (at + 8).alias("at"), size.alias("size"))))
            return F.when(ended(s), s).when(error.isNotNull(), state(at, error, s["found"])).otherwise(state(at + 8 + size + size % 2, F.lit(None), more))

        def folded(inner):
            return lambda s, _: F.aggregate(F.when(ended(s), F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(0), F.lit(63))), s, inner)

        outer = F.sequence(F.lit(0), F.floor(length / (8 * 64 * 64)).cast("int"))
        return F.aggregate(outer, state(F.lit(12), fault, empty), folded(folded(step)))

    known = F.coalesce(content, F.lit(b""))
    return F.get(F.transform(F.array(known), of), F.lit(0))


def chunks(raw: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """(image_id, seq, fourcc, type, size, payload, _corrupt) of each top-level chunk, as far as the walk comes; a fault
    is the last row. No row leaves the JVM."""
    rows = raw.select("image_id", "content", _walked(F.col("content")).alias("w"))
    fault = F.when(F.col("w.error").isNull(), F.expr("array()")).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("fourcc"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("size"))))
    kind = "array<struct<fourcc:string, at:bigint, size:bigint>>"
    rows = rows.select("image_id", "content", "w.error", F.posexplode(F.concat("w.found", fault.cast(kind))).alias("seq", "c"))
    bad = F.col("c.at").isNull()
    payload = F.substring("content", F.col("c.at").cast("int") + 1, F.col("c.size").cast("int"))
    kind = F.when(~bad, chunk_type(F.col("c.fourcc")))
    return _checked(mode, rows.select("image_id", "seq", "c.fourcc", kind.alias("type"), "c.size", payload.alias("payload"), F.when(bad, F.col("error")).alias("_corrupt")))


HEADER_KINDS = {
    "source_width": pa.int32(), "source_height": pa.int32(), "has_alpha": pa.bool_(), "animated": pa.bool_(), "lossy": pa.bool_(), "loop_count": pa.int32(),
    "loop_duration_ms": pa.int64(), "frame_count": pa.int32(), "background_hint": pa.binary(), "metadata": pa.struct({k: pa.binary() for k in ("icc", "exif", "xmp")}),
}
OF_IMAGE_KINDS = {"frame_no": pa.int32(), "source_width": pa.int32(), "source_height": pa.int32(), "animated": pa.bool_(), "frame_count": pa.int32()}
FRAME_KINDS = {
    "x": pa.int32(), "y": pa.int32(), "width": pa.int32(), "height": pa.int32(), "duration_ms": pa.int32(), "blend": pa.bool_(), "dispose": pa.bool_(),
    "lossless": pa.bool_(), "alpha": pa.binary(), "payload": pa.binary(),
}


def _own_bytes(part: bytes | container.Part | None) -> bytes | None:
    return None if part is None else bytes(part)


def header(i: container.Image, with_metadata: bool = True) -> dict:
    """The values of HEADER."""
    meta = {k: _own_bytes(i.metadata.get(k)) if with_metadata else None for k in ("icc", "exif", "xmp")}
    return {
        "source_width": i.width, "source_height": i.height, "has_alpha": i.has_alpha, "animated": i.animated, "lossy": i.lossy, "loop_count": i.loop_count,
        "loop_duration_ms": i.loop_duration_ms, "frame_count": len(i.frames), "background_hint": i.background, "metadata": meta,
    }


def stored(f: container.Frame) -> dict:
    """The values of ENCODED."""
    return {k: getattr(f, k) for k in FRAME_KINDS} | {"alpha": _own_bytes(f.alpha), "payload": bytes(f.payload)}


def _parsed(with_frames: bool, most_pixels: int):
    """A struct of the header and, if wanted, the encoded frames; or the error."""
    kind = pa.struct({"head": pa.struct(HEADER_KINDS), "frames": pa.list_(pa.struct(FRAME_KINDS)), "_corrupt": pa.string()})

    @F.arrow_udf(f"struct<head:struct<{HEADER}>, frames:array<struct<{ENCODED}>>, _corrupt:string>")
    def parse(contents: pa.Array) -> pa.Array:
        out = []
        for data in contents.to_pylist():
            try:
                i = container.parse(data or b"", most_pixels)
                out.append({"head": header(i), "frames": [stored(f) for f in i.frames] if with_frames else [], "_corrupt": None})
            except ValueError as e:
                out.append({"head": None, "frames": None, "_corrupt": str(e)})
        return pa.array(out, kind)

    return parse


def images(raw: DataFrame, mode: str = "PERMISSIVE", most_pixels: int = container.MOST_PIXELS) -> DataFrame:
    """One row a file: image_id, the header's fields and _corrupt."""
    rows = raw.select("image_id", _parsed(False, most_pixels)("content").alias("p"))
    return _checked(mode, rows.select("image_id", "p.head.*", "p._corrupt"))


headers = images


def frames_encoded(raw: DataFrame, mode: str = "PERMISSIVE", most_pixels: int = container.MOST_PIXELS) -> DataFrame:
    """One row a frame as it is stored, with its image's canvas and whether that is animated; a malformed file
    is one row with _corrupt."""
    rows = raw.select("image_id", _parsed(True, most_pixels)("content").alias("p"))
    rows = rows.select("image_id", "p.head", "p._corrupt", F.posexplode_outer("p.frames").alias("frame_no", "f"))
    return _checked(mode, rows.select("image_id", "frame_no", "head.source_width", "head.source_height", "head.animated", "head.frame_count", "f.*", "_corrupt"))


PLACED = "image_id string, frame_no int, source_width int, source_height int, animated boolean, frame_count int, x int, y int, width int, height int, duration_ms int, blend boolean, dispose boolean, argb array<int>, _corrupt string"


def _int_lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """Lists of 32-bit numbers without a Python object a pixel; None is null. All together below 2**31."""
    ends = np.cumsum([0, *(0 if a is None else a.size for a in arrays)])
    if ends[-1] >= 1 << 31:
        raise OverflowError("too many pixels for one batch")
    ends = ends.astype(np.int32)
    values = np.concatenate([a.ravel().view(np.int32) for a in arrays if a is not None] or [np.zeros(0, np.int32)])
    null = pa.array([a is None for a in arrays] + [False])
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.array(null.to_numpy(zero_copy_only=False), bool)), pa.array(values))


def decode(encoded: DataFrame, lossy: vp8.Tables | None = None, deal: bool = False) -> DataFrame:
    """Encoded frames with their pixels (argb, at the frame's own size) instead of payload and alpha; a frame
    that can't be decoded has _corrupt. deal: shuffle the encoded frames first, so that many frames of one file
    aren't decoded by one task."""
    names = [x.split()[0] for x in PLACED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, pictures, errors, held = 0, [], [], 0
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in ("width", "height", "lossless", "alpha", "payload", "_corrupt")}
                picture, error = None, r["_corrupt"]
                if error is None:
                    try:
                        f = container.Frame(0, 0, r["width"], r["height"], 0, False, False, r["lossless"], r["alpha"], r["payload"])
                        picture = compose.decode_frame(f, lossy)
                    except (ValueError, IndexError, MemoryError) as e:
                        error = str(e) or type(e).__name__
                pictures.append(picture)
                errors.append(error)
                held += 0 if picture is None else picture.size
                if held >= DECODED_PIXELS or i == batch.num_rows - 1:
                    rows = batch.slice(first, i + 1 - first)
                    own = {"argb": _int_lists(pictures), "_corrupt": pa.array(errors, pa.string())}
                    yield pa.RecordBatch.from_arrays([own[n] if n in own else rows.column(n) for n in names], names)
                    first, pictures, errors, held = i + 1, [], [], 0

    return (encoded.repartition("image_id", "frame_no") if deal else encoded).mapInArrow(run, PLACED)


def _fold(group: pa.Table) -> pa.Table:
    """The frames' rows of one strip of a canvas to the strip as shown after each frame, up to a corrupt one."""
    first = group.column("strip")[0].as_py() * group.column("rows")[0].as_py()
    width, height, rows = (group.column(c)[0].as_py() for c in ("source_width", "source_height", "rows"))
    canvas = np.zeros((min(rows, height - first), width), np.uint32)
    before, numbers, times, strips, errors = None, [], [], [], []
    for i in np.argsort(group.column("frame_no").to_numpy(), kind="stable").tolist():
        f = SimpleNamespace(**{c: group.column(c)[i].as_py() for c in ("x", "y", "width", "height", "blend", "dispose", "frame_no", "duration_ms", "_corrupt")})
        numbers.append(f.frame_no)
        times.append(f.duration_ms)
        errors.append(f._corrupt)
        if f._corrupt is not None:
            strips.append(None)
            break
        part = group.column("part").combine_chunks().slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32)
        canvas = compose.paint(canvas, (width, height), first, f, before, part.reshape(-1, f.width))
        before = f
        strips.append(canvas.copy())
    n = len(numbers)
    keep = [group.column(c).slice(0, 1).combine_chunks().take(pa.array([0] * n)) for c in ("image_id", "strip", "source_width", "source_height")]
    keep += [pa.array(numbers, pa.int32()), pa.array(times, pa.int32()), _int_lists(strips), pa.array(errors, pa.string())]
    return pa.Table.from_arrays(keep, ["image_id", "strip", "source_width", "source_height", "frame_no", "duration_ms", "argb", "_corrupt"])


def compose_frames(placed: DataFrame, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    """(image_id, frame_no, duration_ms, source_width, source_height, argb, _corrupt): decoded frames of animations as
    shown.

    A canvas is cut into strips of rows, so that a strip has at most about strip_pixels in all its frames, and
    a strip is composed in one task. A frame that is corrupt is the last of its image."""
    rows = F.least(F.col("source_height"), F.greatest(F.lit(1), F.floor(F.lit(strip_pixels) / (F.col("source_width") * F.col("frame_count"))).cast("int")))
    cut = placed.withColumn("rows", rows).withColumn("strip", F.explode(F.expr("sequence(0, cast(ceil(source_height / rows) as int) - 1)")))
    top, bottom = F.greatest("y", F.col("strip") * F.col("rows")), F.least(F.col("y") + F.col("height"), (F.col("strip") + 1) * F.col("rows"))
    part = F.when(bottom > top, F.slice("argb", (top - F.col("y")) * F.col("width") + 1, F.greatest(bottom - top, F.lit(0)) * F.col("width")))
    part = F.coalesce(part, F.expr("cast(array() as array<int>)"))
    cut = cut.select("image_id", "frame_no", "source_width", "source_height", "x", "y", "width", "height", "blend", "dispose", "duration_ms", "_corrupt", "rows", "strip", part.alias("part"))
    schema = "image_id string, strip int, source_width int, source_height int, frame_no int, duration_ms int, argb array<int>, _corrupt string"
    strips = cut.groupBy("image_id", "strip").applyInArrow(_fold, schema)
    whole = strips.groupBy("image_id", "frame_no").agg(
        *[F.first(c).alias(c) for c in ("source_width", "source_height", "duration_ms")],
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("strip", "argb"))), lambda s: s["argb"])).alias("argb"), F.max("_corrupt").alias("_corrupt"),
    )
    return whole.withColumn("argb", F.when(F.col("_corrupt").isNull(), F.col("argb")))


@dataclass(frozen=True)
class Wishes:
    """How frames are to come out. width, height: 0 is unset; lossy: the probabilities that lossy payloads need; fancy:
    chroma of lossy frames is made larger smoothly."""

    width: float = 0
    height: float = 0
    preserve_ratio: bool = False
    smooth: bool = True
    fancy: bool = False
    lossy: vp8.Tables | None = None
    most_pixels: int = container.MOST_PIXELS

    def scaled(self, picture: np.ndarray, canvas: tuple[int, int]) -> np.ndarray:
        size = compose.target_size(*canvas, self.width, self.height, self.preserve_ratio)
        if (picture.shape[1], picture.shape[0]) == size:
            return picture
        return (compose.bilinear if self.smooth else compose.nearest)(picture, *size)


SHOWN = "image_id string, frame_no int, width int, height int, duration_ms int, argb array<int>, _corrupt string"


def shown_rows(image_id: str, content: bytes | container.Part | None, wishes: Wishes) -> Iterator[tuple]:
    """Rows of SHOWN, pixels as an array, of one file, each made when it is asked for: one canvas is held."""
    try:
        image = container.parse(content or b"", wishes.most_pixels)
    except ValueError as e:
        yield image_id, None, None, None, None, None, str(e)
        return
    for n, (f, picture, error) in enumerate(compose.shown(image, wishes.lossy, wishes.fancy)):
        if picture is None:
            yield image_id, n, None, None, None, None, error
            continue
        picture = wishes.scaled(picture, (image.width, image.height))
        yield image_id, n, picture.shape[1], picture.shape[0], f.duration_ms, picture, None


def shown_batches(rows: Iterator[tuple], held_pixels: int = DECODED_PIXELS) -> Iterator[pa.RecordBatch]:
    """Rows of SHOWN as batches of about held_pixels pixels at most, or of one larger frame."""
    waiting, held = [], 0
    for row in rows:
        waiting.append(row)
        held += 0 if row[5] is None else row[5].size
        if held >= held_pixels or len(waiting) == 10_000:
            yield _shown_batch(waiting)
            waiting, held = [], 0
    if waiting:
        yield _shown_batch(waiting)


def _shown_batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, numbers, widths, heights, times, pictures, errors = zip(*rows, strict=True)
    columns = [pa.array(ids, pa.string()), *(pa.array(c, pa.int32()) for c in (numbers, widths, heights, times)), _int_lists(pictures), pa.array(errors, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SHOWN.split(", ")])


def _tables(spark: SparkSession, lossy: vp8.Tables | None) -> vp8.Tables | None:
    if lossy is None and (path := spark.conf.get(LOSSY_TABLES, None)):
        return lossy_tables(spark, path)
    return lossy


def frames(
    raw: DataFrame, width: float = 0, height: float = 0, preserve_ratio: bool = False, smooth: bool = True, mode: str = "PERMISSIVE",
    lossy: vp8.Tables | None = None, most_pixels: int = container.MOST_PIXELS, fancy: bool = False,
) -> DataFrame:
    """image_id, frame_no, width, height, duration_ms, argb, _corrupt: frames as shown, scaled to the wanted size
    (0: unset). A still image's frames are each scaled to the size of the canvas.

    lossy: the probabilities that lossy payloads need, see lossy_tables; if not given, those of the file that the
    session setting LOSSY_TABLES names, and without that such frames are _corrupt.
    Of an animation with a corrupt frame those before it are shown. Every file is read once, by one task that decodes,
    composes and scales frame by frame: nothing is shuffled. See frames_by_segment for long animations."""
    wishes = Wishes(width, height, preserve_ratio, smooth, fancy, _tables(raw.sparkSession, lossy), most_pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files_ = ((batch.column("image_id")[i].as_py(), batch.column("content")[i].as_py()) for i in range(batch.num_rows))
            yield from shown_batches(row for f in files_ for row in shown_rows(*f, wishes))

    return _checked(mode, raw.select("image_id", "content").mapInArrow(run, SHOWN))


#: What composition needs to know of a frame, besides its pixels.
PLACE = "image_id, frame_no, source_width, source_height, x, y, width, height, duration_ms, blend, dispose".split(", ")


def _in_order(group: str, wishes: Wishes, last_only: bool):
    """Rows of frames, sorted by image, group and number, to the frames as shown; a group begins with an empty canvas
    and ends with its first corrupt frame. last_only: of each group the last frame alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, canvas, last, broken = None, None, None, False
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                f = SimpleNamespace(**{c: columns[c][i].as_py() for c in PLACE})
                if (own := (f.image_id, columns[group][i].as_py())) != key:
                    if last is not None:
                        yield last
                    key, canvas, last, broken = own, compose.Canvas(f.source_width, f.source_height), None, False
                if broken:
                    continue
                try:
                    if error := columns["_corrupt"][i].as_py() if "_corrupt" in columns else None:
                        raise ValueError(error)
                    if "argb" in columns:
                        picture = columns["argb"].slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32).reshape(f.height, f.width)
                    else:
                        f.lossless, f.alpha, f.payload = (columns[c][i].as_py() for c in ("lossless", "alpha", "payload"))
                        picture = compose.decode_frame(f, wishes.lossy, wishes.fancy)
                    whole = canvas.add(f, picture)
                    row = None if last_only else wishes.scaled(whole, canvas.size).copy()
                    row = (f.image_id, f.frame_no, 0, 0, f.duration_ms, row, None)
                except (ValueError, IndexError, MemoryError) as e:
                    broken, row = True, (f.image_id, f.frame_no, None, None, None, None, str(e) or type(e).__name__)
                if not last_only:
                    yield _sized(row)
                elif not broken:
                    last = _sized((*row[:5], wishes.scaled(canvas.pixels, canvas.size).copy(), None)) if i + 1 == batch.num_rows or _next(columns, group, i) != key else None
                else:
                    last = row
        if last is not None:
            yield last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from shown_batches(rows(batches))

    return run


def _next(columns: dict, group: str, i: int) -> tuple:
    return columns["image_id"][i + 1].as_py(), columns[group][i + 1].as_py()


def _sized(row: tuple) -> tuple:
    return row if row[5] is None else (*row[:2], row[5].shape[1], row[5].shape[0], *row[4:])


def frames_by_segment(encoded: DataFrame, wishes: Wishes = Wishes()) -> DataFrame:
    """Rows of SHOWN of frames as frames_encoded gives them (or with argb in place of payload), composed by segments.

    A segment begins with a frame that needs no earlier one (animation.segments), so the segments of one long animation
    are composed side by side. Only encoded frames are shuffled, once by image for the index and once by segment.
    A corrupt frame ends its segment; later ones are shown. Rows of malformed files come back as they are."""
    bad = encoded.where("frame_no is null") if "_corrupt" in encoded.columns else None
    rows = animation.segments(encoded.where("frame_no is not null"))
    rows = rows.repartition("image_id", "segment").sortWithinPartitions("image_id", "segment", "frame_no")
    out = rows.mapInArrow(_in_order("segment", wishes, False), SHOWN)
    return out if bad is None else out.union(bad.select("image_id", "frame_no", "width", "height", "duration_ms", F.lit(None).cast("array<int>").alias("argb"), "_corrupt"))


def frames_at(encoded: DataFrame, wanted: DataFrame, wishes: Wishes = Wishes()) -> DataFrame:
    """Rows of SHOWN of the wanted frames (image_id, frame_no) alone: of their images only the frames from the nearest
    one that needs no earlier one are decoded and composed.

    Wanted frames that don't exist give no row, repeated ones one. The index is made of the frames' places without their
    payloads; a wanted frame behind a corrupt one of its segment has that one's error."""
    wanted = wanted.select("image_id", "frame_no").distinct()
    own = encoded.where("frame_no is not null").join(wanted.select("image_id").distinct(), "image_id", "left_semi")
    index = animation.segments(own.select(*PLACE)).select("image_id", "frame_no", "segment")
    spans = index.join(wanted, ["image_id", "frame_no"]).select("image_id", F.col("segment").alias("first"), F.col("frame_no").alias("wanted"))
    near = F.col("frame_no").between(F.col("first"), F.col("wanted"))
    rows = own.join(spans, "image_id").where(near).repartition("image_id", "wanted").sortWithinPartitions("image_id", "wanted", "frame_no")
    return rows.mapInArrow(_in_order("wanted", wishes, True), SHOWN)


def read_frames(content: bytes, lossy: vp8.Tables | None = None, most_pixels: int = container.MOST_PIXELS, fancy: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """A3: (duration, pixels) of one file's frames, each decoded when it is asked for."""
    for f, picture, error in compose.shown(container.parse(content, most_pixels), lossy, fancy):
        if picture is None:
            raise container.ImageError(error)
        yield f.duration_ms, picture


def collected(shown: DataFrame) -> DataFrame:
    """A2, A5: one row an image with its frames in order, the first of them, and their number."""
    frame = F.struct("frame_no", "width", "height", F.col("width").alias("stride"), "duration_ms", "argb")
    out = shown.where("_corrupt is null").groupBy("image_id").agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    return out.select("image_id", F.size("frames").alias("frame_count"), F.col("frames")[0].alias("first_frame"), "frames")


def pixels(shown: DataFrame) -> DataFrame:
    """(image_id, frame_no, x, y, a, r, g, b), one row a pixel."""
    one = shown.where("_corrupt is null").select("image_id", "frame_no", "width", F.posexplode("argb").alias("at", "p"))
    channels = {n: f(F.col("p")).cast("int") for n, f in (("a", px.alpha), ("r", px.red), ("g", px.green), ("b", px.blue))}
    return one.select("image_id", "frame_no", (F.col("at") % F.col("width")).alias("x"), F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), *[c.alias(n) for n, c in channels.items()])


def pixel_at(x, y, strict: bool = True) -> Column:
    """The pixel of a frame's row at (x, y); outside it an error or, if not strict, null."""
    x, y = (v if isinstance(v, Column) else F.lit(v) for v in (x, y))
    inside = (x >= 0) & (y >= 0) & (x < F.col("width")) & (y < F.col("height"))
    out = F.when(inside, F.get("argb", y * F.col("width") + x))
    return F.when(inside, out).otherwise(F.raise_error(F.lit("a place outside the frame")).cast("int")) if strict else out


def target_sizes(image_rows: DataFrame, width: float = 0, height: float = 0, preserve_ratio: bool = False) -> DataFrame:
    """A4: image rows with target_width and target_height, the size that `frames` gives for these wishes."""
    tw, th = scaling.target_size("source_width", "source_height", F.lit(float(width)), F.lit(float(height)), preserve_ratio)
    return image_rows.withColumns({"target_width": tw.cast("int"), "target_height": th.cast("int")})


def metadata_lengths(image_rows: DataFrame) -> DataFrame:
    """image_id and the bytes of each kind of metadata, 0 if there is none."""
    size = [F.coalesce(F.octet_length(f"metadata.{k}"), F.lit(0)).alias(f"{k}_bytes") for k in ("icc", "exif", "xmp")]
    return image_rows.select("image_id", *size)


@F.arrow_udf(BinaryType())
def _raster(argb: pa.Array, opaque: pa.Array) -> pa.Array:
    out = []
    for v, solid in zip(argb, opaque.to_pylist(), strict=True):
        p = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(np.int64)
        out.append(None if p is None else np.stack([p >> k & 255 for k in ((16, 8, 0) if solid else (24, 16, 8, 0))], axis=-1).astype(np.uint8).tobytes())
    return pa.array(out, pa.binary())


def rasters(shown: DataFrame) -> DataFrame:
    """G1, its data: image_id, frame_no, width, height, kind and the raster's bytes, row by row from the top. A frame
    without a transparent pixel is RGB, any other ARGB, not premultiplied."""
    opaque = F.forall("argb", lambda p: px.alpha(p) == 255)
    rows = shown.where("_corrupt is null").select("image_id", "frame_no", "width", "height", F.when(opaque, "RGB").otherwise("ARGB").alias("kind"), _raster("argb", opaque).alias("raster"))
    return rows
