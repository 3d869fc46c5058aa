"""Image files as a Spark data source.

    spark.dataSource.register(ImageSource)
    spark.read.format("lumaframe").option("relation", "frames").option("width", 64).load(path)

Options, case aside:
  relation           images (headers and metadata; default), frames_encoded, or frames (as shown)
  mode               PERMISSIVE (default: a malformed file is a row with _corrupt), DROPMALFORMED or FAILFAST
  metadata           whether images reads the metadata's bytes (default true)
  width, height, preserveRatio, smooth, fancyUpsampling, lossyTables
                     how frames come out; lossyTables is a text file with the lossy format's probabilities
  mostPixels         larger canvases and frames are malformed
  bytesPerPartition, filesPerPartition
                     bounds of what one task reads; a file is never split
  pushFilters        needs spark.sql.python.filterPushdown.enabled (default false)

Files are found below the path by their suffix, in any case, through Arrow's file systems, so that a path may lie in any
store that those know. A task seeks from chunk to chunk: `images` reads the heads of chunks and what metadata there is,
never a payload. With pushFilters, filters on image_id choose files before any is opened, and those on _corrupt
choose before rows are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith

from lumaframe.kernels import container, vp8
from lumaframe.sources import images
from lumaframe.sources.files import store_of

SUFFIX = ".webp"
#: Bytes that are read at a time where only heads are wanted.
PAGE = 1024
#: What a file counts at least when files are dealt out, and at most if only its head is read.
LEAST_COST, HEAD_COST = 1 << 14, 1 << 16
RELATIONS = {
    "images": f"image_id string, {images.HEADER}, _corrupt string",
    "frames_encoded": f"image_id string, frame_no int, source_width int, source_height int, animated boolean, frame_count int, {images.ENCODED}, _corrupt string",
    "frames": images.SHOWN,
}


@dataclass
class Files(InputPartition):
    """(image_id, path, size) of the files that one task reads."""

    files: list[tuple[str, str, int]]


class Reading:
    """A file of which pages are read when they are asked for; counts the bytes."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.at, self.page, self.bytes_read = file, size, 0, b"", 0

    def __call__(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.page):
            self.file.seek(at)
            self.at, self.page = at, self.file.read(min(max(n, PAGE), self.size - at))
            self.bytes_read += len(self.page)
        return self.page[at - self.at : at - self.at + n]

    def whole(self) -> container.Part:
        return container.Part(self, 0, self.size)


def _found(path: str) -> Iterator[tuple[str, str, int]]:
    """(image_id as Spark's own file sources name it, path in its store, size), in the order of paths."""
    store, inside = store_of(path)
    front = path[: path.index(inside)] if "://" in path and inside in path else "file:"
    if front == "file://":
        front = "file:"
    info = store.get_file_info(inside)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
    for f in sorted(found, key=lambda f: f.path):
        if f.type == fs.FileType.File and f.path.lower().endswith(SUFFIX):
            yield front + f.path, f.path, f.size


def _flag(value: str | None, default: bool) -> bool:
    return default if value is None else str(value).lower() in ("true", "1", "yes")


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lumaframe"

    def schema(self) -> str:
        return RELATIONS[self._relation()]

    def _relation(self) -> str:
        relation = (self.options.get("relation") or "images").lower()
        if relation not in RELATIONS:
            raise ValueError(f"relation is one of {', '.join(RELATIONS)}")
        return relation

    def reader(self, schema) -> ImageReader:
        kind = FilteringReader if _flag(self.options.get("pushFilters"), False) else ImageReader
        return kind(self._relation(), dict(self.options.items()))


class ImageReader(DataSourceReader):
    def __init__(self, relation: str, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        if not o.get("path"):
            raise ValueError("a path is needed")
        self.relation, self.path = relation, o["path"]
        self.mode = (o.get("mode") or "PERMISSIVE").upper()
        if self.mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
            raise ValueError("mode is PERMISSIVE, DROPMALFORMED or FAILFAST")
        self.metadata = _flag(o.get("metadata"), True)
        lossy = None
        if o.get("lossytables"):
            store, inside = store_of(o["lossytables"])
            with store.open_input_stream(inside) as f:
                lossy = vp8.Tables.parse(f.read().decode())
        self.wishes = images.Wishes(
            float(o.get("width") or 0), float(o.get("height") or 0), _flag(o.get("preserveratio"), False), _flag(o.get("smooth"), True),
            _flag(o.get("fancyupsampling"), False), lossy, int(o.get("mostpixels") or container.MOST_PIXELS),
        )
        self.most_bytes, self.most_files = int(o.get("bytesperpartition") or 128 << 20), int(o.get("filesperpartition") or 10_000)
        self.only: set[str] | None = None
        self.prefixes: list[str] = []
        self.corrupt: bool | None = None

    def partitions(self) -> list[Files]:
        out, held = [Files([])], 0
        for image_id, path, size in _found(self.path):
            if (self.only is not None and image_id not in self.only) or not all(image_id.startswith(p) for p in self.prefixes):
                continue
            cost = max(LEAST_COST, min(size, HEAD_COST) if self.relation == "images" else size)
            if out[-1].files and (held + cost > self.most_bytes or len(out[-1].files) >= self.most_files):
                out.append(Files([]))
                held = 0
            out[-1].files.append((image_id, path, size))
            held += cost
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)

        def rows() -> Iterator[tuple]:
            for image_id, path, size in partition.files:
                with store.open_input_file(path) as file:
                    for row in self._rows(image_id, Reading(file, size).whole()):
                        bad = row[-1] is not None
                        if bad and self.mode == "FAILFAST":
                            raise ValueError(f"{image_id}: {row[-1]}")
                        if (bad and self.mode == "DROPMALFORMED") or (self.corrupt is not None and bad != self.corrupt):
                            continue
                        yield row

        if self.relation == "frames":
            yield from images.shown_batches(rows())
        else:
            yield from _batches(rows(), self.relation)

    def _rows(self, image_id: str, data: container.Part) -> Iterator[tuple]:
        if self.relation == "frames":
            yield from images.shown_rows(image_id, bytes(data), self.wishes)
            return
        try:
            image = container.parse(data, self.wishes.most_pixels)
            if self.relation == "images":
                yield (image_id, *images.header(image, self.metadata).values(), None)
                return
            for n, f in enumerate(image.frames):
                yield (image_id, n, image.width, image.height, image.animated, len(image.frames), *images.stored(f).values(), None)
        except ValueError as e:
            yield (image_id, *[None] * (len(images.HEADER_KINDS) if self.relation == "images" else len(images.OF_IMAGE_KINDS) + len(images.FRAME_KINDS)), str(e))


class FilteringReader(ImageReader):
    """Spark allows it only where its setting for filters in Python sources is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("image_id",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = own if self.only is None else self.only & own
            elif isinstance(f, StringStartsWith) and f.attribute == ("image_id",):
                self.prefixes.append(f.value)
            elif isinstance(f, IsNull | IsNotNull) and f.attribute == ("_corrupt",) and self.mode != "FAILFAST" and self.corrupt is None:
                self.corrupt = isinstance(f, IsNotNull)
            else:
                yield f


def _batches(rows: Iterator[tuple], relation: str, most: int = 1000, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    kinds = images.HEADER_KINDS if relation == "images" else images.FRAME_KINDS
    kinds = {"image_id": pa.string(), **({} if relation == "images" else images.OF_IMAGE_KINDS), **kinds, "_corrupt": pa.string()}
    waiting, held = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*waiting, strict=True), kinds.values(), strict=True)], list(kinds))

    for row in rows:
        waiting.append(row)
        held += sum(len(x) for x in row if isinstance(x, bytes))
        if len(waiting) == most or held >= most_bytes:
            yield out()
            waiting, held = [], 0
    if waiting:
        yield out()
