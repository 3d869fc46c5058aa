"""The data source against the relations of `images`, and what it reads of files."""

import os

import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from test_images import H, PICTURE, W, chunk, payload, riff

from lumaframe.kernels import container
from lumaframe.plans import encode, encode_lossy
from lumaframe.sources import datasource, images

BIG = os.urandom(3_000_000)


def some_files():
    pictures = [[(i * 977 + k * 31) % (1 << 32) for k in range(64)] for i in range(12)]
    out = {f"s{i}.webp": encode.sample_file(i, p) for i, p in enumerate(pictures)}  # one in six is malformed
    out |= {f"deep/c{i}.WebP": encode.composed_file(i, p) for i, p in enumerate(pictures[:4])}
    out["still.webp"] = riff(chunk(b"VP8L", payload(W, H, PICTURE)))
    out["empty.webp"] = b""
    out["other.txt"] = b"RIFF"
    flags = container.XMP | container.ICC
    out["big.webp"] = riff(encode.extended(8, 8, flags), chunk(b"ICCP", b"icc"), chunk(b"JUNK", BIG), chunk(b"VP8L", encode.lossless([7] * 64, 8, 8) + BIG), chunk(b"XMP ", b"xm"))
    out["long.webp"] = riff(encode.extended(8, 8, container.ANIMATED), *(encode.frame(0, 0, 8, 8, 9, False, False, chunk(b"VP8L", encode.lossless([k] * 64, 8, 8) + BIG)) for k in range(3)))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.dataSource.register(datasource.ImageSource)
    top = tmp_path_factory.mktemp("files")
    (top / "deep").mkdir()
    for name, data in some_files().items():
        (top / name).write_bytes(data)
    return str(top)


def rows(frame):
    """Without the empty file, which Spark's own file source passes over; here it is malformed."""
    return sorted((tuple(r) for r in frame.where("image_id not like '%empty%'").collect()), key=str)


def source(spark, folder, **options):
    return spark.read.format("lumaframe").options(**options).load(folder)


def test_same_rows_as_images(spark, folder):
    raw = images.files(spark, folder)
    assert rows(source(spark, folder)) == rows(images.images(raw))
    assert rows(source(spark, folder, relation="frames_encoded")) == rows(images.frames_encoded(raw).select(*source(spark, folder, relation="frames_encoded").columns))
    for wishes in ({}, {"width": 3, "smooth": False}, {"width": 20, "height": 9, "preserve_ratio": True}):
        options = {{"preserve_ratio": "preserveRatio"}.get(k, k): v for k, v in wishes.items()}
        assert rows(source(spark, folder, relation="frames", **options)) == rows(images.frames(raw, **wishes))


def test_modes(spark, folder):
    every = source(spark, folder)
    n = every.count()
    bad = every.where("_corrupt is not null").count()
    assert bad == 3 and n == 20
    assert source(spark, folder, mode="dropMalformed").count() == n - bad
    with pytest.raises(Exception, match="malformed|container|ends early"):
        source(spark, folder, mode="FAILFAST").collect()
    for wrong in ({"mode": "x"}, {"relation": "x"}):
        with pytest.raises(Exception, match="relation is|mode is"):
            source(spark, folder, **wrong).collect()
    assert source(spark, folder, mostPixels=10).where("_corrupt = 'too many pixels'").count() > 5
    assert source(spark, folder, metadata=False).where("metadata.icc is not null").count() == 0
    assert source(spark, folder, metadata=True).where("metadata.icc is not null").count() > 1


def test_filters_choose_files(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = f"file:{folder}/still.webp"
        every = source(spark, folder, pushFilters=True)
        assert [r.source_width for r in every.where(F.col("image_id") == one).collect()] == [W]
        assert every.where(F.col("image_id").startswith(f"file:{folder}/deep/")).count() == 4
        assert every.where(F.col("image_id").isin(one, "file:/none")).count() == 1
        assert every.where("_corrupt is null").count() == 17 and every.where("_corrupt is not null").count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = datasource.FilteringReader("images", {"path": folder})
    assert list(reader.pushFilters([datasource.EqualTo(("image_id",), one), datasource.IsNull(("_corrupt",)), datasource.EqualTo(("source_width",), 3)])) == [datasource.EqualTo(("source_width",), 3)]
    assert [f[0] for p in reader.partitions() for f in p.files] == [one]


@pytest.mark.parametrize("name", ["big.webp", "long.webp"])
def test_headers_read_under_one_percent_of_a_large_file(folder, name):
    path = f"{folder}/{name}"
    size = os.path.getsize(path)
    with fs.LocalFileSystem().open_input_file(path) as file:
        reading = datasource.Reading(file, size)
        image = container.parse(reading.whole())
        head = images.header(image)
    assert reading.bytes_read < size / 100
    with open(path, "rb") as file:
        assert head == images.header(container.parse(file.read()))


def test_partitions_are_bounded(spark, folder):
    reader = datasource.ImageReader("frames", {"path": folder, "bytesPerPartition": "4000000"})
    sizes = [sum(f[2] for f in p.files) for p in reader.partitions()]
    assert len(sizes) > 2 and all(s <= 4_000_000 or len(p.files) == 1 for s, p in zip(sizes, reader.partitions(), strict=True))
    assert source(spark, folder, filesPerPartition=2).rdd.getNumPartitions() == 10
    heads = datasource.ImageReader("images", {"path": f"file://{folder}", "bytesPerPartition": "4000000"}).partitions()
    assert len(heads) == 1 and [f[0] for f in heads[0].files] == sorted(f[0] for f in heads[0].files)


def test_fancy_chroma_and_tables(spark, tmp_path):
    spark.dataSource.register(datasource.ImageSource)
    (tmp_path / "a.webp").write_bytes(encode.riff(encode.chunk(b"VP8 ", encode_lossy.flat_frame(5))))
    tables = encode_lossy.made_up_tables()
    raw = images.files(spark, str(tmp_path))
    (plain,), (fancy,) = images.frames(raw, lossy=tables).collect(), images.frames(raw, lossy=tables, fancy=True).collect()
    assert plain._corrupt is None and plain.argb != fancy.argb
    assert source(spark, str(tmp_path), relation="frames").first()._corrupt
