"""Queries that decode image files made from the tables, and the SQL of what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import pixels as px
from lumaframe.kernels import vp8
from lumaframe.operators import animation, lossy, prediction, scaling
from lumaframe.plans import carriers, encode, encode_lossy
from lumaframe.sources import images

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ARGB = {"a": 24, "r": 16, "g": 8, "b": 0}


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _pixels(shown: DataFrame) -> DataFrame:
    return images.pixels(shown).select(F.col("image_id").cast("long").alias("vec_id"), "frame_no", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *ARGB)


def _channels(p: str) -> str:
    return ", ".join(f"CAST(({p} >> {s}) & 255 AS INTEGER) AS {c}" for c, s in ARGB.items())


def _decoded(name: str, write, expected: str, prepare=None) -> None:
    """All pictures written by write(vec_id, pixels) and read back; expected: SQL rows vec_id, x, y, p."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = carriers.pictures(spark, sf)
        return _pixels(images.frames(carriers.encoded(prepare(rows) if prepare else rows, write)))

    _add(name, query, f"WITH {carriers.PICTURES} SELECT vec_id, CAST(0 AS INTEGER) AS frame_no, x, y, {_channels('p')} FROM ({expected})")


def _lossless_queries() -> None:
    one = lambda kind, value: lambda i, p: encode.riff(encode.chunk(b"VP8L", encode.lossless(p, 8, 8, kind, value(i))))
    same = "SELECT vec_id, x, y, p FROM pictures"
    _decoded("l15_l29_predictors", one("predict", lambda i: i % 14), same)
    _decoded("l30_l31_colour_transforms", one("colour", lambda i: i * 0x3D4D51 & 0xFFFFFF), same)
    doubled = "transform(sequence(0, 63), i -> argb[16 * (i div 16) + i % 8])"
    _decoded("l11_l14_copies_and_cache", one("copies", lambda i: i % 12), "SELECT a.vec_id, a.x, a.y, b.p FROM pictures a JOIN pictures b ON a.vec_id = b.vec_id AND a.x = b.x AND b.y = a.y - a.y % 2", lambda r: r.withColumn("argb", F.expr(doubled)))
    few = "transform(argb, p -> 4278190080 + (((p div 65536) % 256) * (2 + vec_id % 60) div 256) * 1118481)"
    _decoded("l04_l32_palettes", one("palette", lambda i: 0), "SELECT vec_id, x, y, 4278190080 + ((l * (2 + vec_id % 60)) // 256) * 1118481 AS p FROM pictures", lambda r: r.withColumn("argb", F.expr(few)))


def _container_queries() -> None:
    files = lambda s, d: carriers.encoded(carriers.pictures(s, d), encode.sample_file)
    key = lambda: F.col("image_id").cast("long").alias("vec_id")
    kind = "vec_id % 6"
    pick = lambda *v: "CASE " + " ".join(f"WHEN {kind} = {k} THEN {x}" for k, x in enumerate(v) if x is not None) + " END"
    image = {
        "source_width": pick(8, "vec_id % 1000 + 1", 8, 8, 8), "source_height": pick(8, "vec_id % 77 + 1", 8, 8, 8), "has_alpha": pick("true", "false", "true", "true", "false"),
        "animated": pick(*["false"] * 3, "true", "false"), "lossy": pick("false", "true", "false", "false", "true"), "loop_count": pick(1, 1, 1, "vec_id % 9", 1),
        "loop_duration_ms": pick(0, 0, 0, "40 + vec_id % 300", 0), "frame_count": pick(1, 1, 1, 2, 1),
    }
    kinds = {"source_width": "INTEGER", "source_height": "INTEGER", "loop_count": "INTEGER", "frame_count": "INTEGER", "loop_duration_ms": "BIGINT", "has_alpha": "BOOLEAN", "animated": "BOOLEAN", "lossy": "BOOLEAN"}
    fields = ", ".join(f"CAST({v} AS {kinds[c]}) AS {c}" for c, v in image.items())

    def heads(spark: SparkSession, sf: str) -> DataFrame:
        rows = images.images(files(spark, sf))
        return rows.select(key(), *image, F.upper(F.hex("background_hint")).alias("background"), F.col("_corrupt").isNotNull().alias("malformed"))

    _add("c01_c15_images", heads, f"SELECT vec_id, {fields}, {pick(None, None, None, chr(39) + '01020304' + chr(39))} AS background, {kind} = 5 AS malformed FROM embeddings")
    strict = lambda s, d: images.images(files(s, d), "DROPMALFORMED").select(key(), "frame_count")
    _add("a13_drop_malformed", strict, f"SELECT vec_id, CAST({image['frame_count']} AS INTEGER) AS frame_count FROM embeddings WHERE {kind} <> 5")

    def lengths(spark: SparkSession, sf: str) -> DataFrame:
        rows = images.metadata_lengths(images.images(files(spark, sf)))
        return rows.select(key(), "icc_bytes", "exif_bytes", "xmp_bytes")

    _add("a08_c14_metadata_lengths", lengths, f"SELECT vec_id, CASE WHEN {kind} = 2 THEN CAST(vec_id % 5 AS INTEGER) ELSE 0 END AS icc_bytes, CASE WHEN {kind} = 2 AND vec_id % 4 = 0 THEN 3 ELSE 0 END AS exif_bytes, 0 AS xmp_bytes FROM embeddings")
    whole = lambda s, d: files(s, d).where(F.col("image_id").cast("long") % 6 != 5)  # noqa: E731 what a walk of a file that is cut finds depends on where
    parts = [(0, 0, "VP8L"), (1, 0, "VP8 "), *((2, i, c) for i, c in enumerate(("VP8X", "ICCP", "JUNK", "VP8L", "EXIF", "XMP "))), *((3, i, c) for i, c in enumerate(("VP8X", "ANIM", "ANMF", "ANMF"))), *((4, i, c) for i, c in enumerate(("VP8X", "ANMF")))]
    values = ", ".join(f"({k}, {i}, '{c}', '{'UNKNOWN' if c == 'JUNK' else c.strip()}')" for k, i, c in parts)
    sizes = {"VP8 ": "10", "VP8X": "10", "ANIM": "6", "JUNK": "1", "EXIF": "3", "XMP ": "1", "ICCP": "vec_id % 5"}
    size = "CASE fourcc " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in sizes.items()) + " END"

    def walk(spark: SparkSession, sf: str) -> DataFrame:
        known = F.col("fourcc").isin(*sizes)
        ok = F.octet_length("payload") == F.col("size")
        return images.chunks(whole(spark, sf)).select(key(), "seq", "fourcc", "type", F.when(known, F.col("size")).alias("size"), ok.alias("whole"))

    _add("c02_s09_s10_chunks", walk, f"SELECT vec_id, CAST(seq AS INTEGER) AS seq, fourcc, type, CAST({size} AS BIGINT) AS size, true AS whole FROM embeddings JOIN (VALUES {values}) t(kind, seq, fourcc, type) ON {kind} = kind")

    def stored(spark: SparkSession, sf: str) -> DataFrame:
        rows = images.frames_encoded(files(spark, sf), "DROPMALFORMED")
        return rows.select(key(), "frame_no", "x", "y", "width", "height", "duration_ms", "blend", "dispose", "lossless", F.col("alpha").isNotNull().alias("with_alpha"))

    _add("c03_c09_frames_encoded", stored, f"""
        SELECT vec_id, CAST(0 AS INTEGER) AS frame_no, 0 AS x, 0 AS y, CAST({pick(8, 'vec_id % 1000 + 1', 8, 8, 4)} AS INTEGER) AS width, CAST({pick(8, 'vec_id % 77 + 1', 8, 8, 4)} AS INTEGER) AS height,
          {pick(0, 0, 0, 40, 70)} AS duration_ms, {kind} > 2 AS blend, false AS dispose, {kind} <> 1 AS lossless, {kind} = 4 AS with_alpha FROM embeddings WHERE {kind} <> 5
        UNION ALL SELECT vec_id, 1, 2, 4, 4, 4, CAST(vec_id % 300 AS INTEGER), vec_id % 2 = 0, true, true, false FROM embeddings WHERE {kind} = 3""")  # fmt: skip

    def numbers(spark: SparkSession, sf: str) -> DataFrame:
        c = F.col("content")
        return files(spark, sf).select(
            key(), images.fourcc(c, 0).alias("code"), images.little_endian(c, 0, 1).alias("u8"), images.little_endian(c, 0, 2).alias("u16"), images.little_endian(c, 0, 3).alias("u24"),
            images.little_endian(c, 0, 4).alias("u32"), images.little_endian(c, 0, 2, True).alias("i16"), images.little_endian(c, 8, 8).alias("i64"), images.little_endian(c, 1_000_000, 4).alias("beyond"),
        )

    _add("s07_s08_numbers", numbers, f"SELECT vec_id, 'RIFF' AS code, CAST(82 AS BIGINT) AS u8, CAST(18770 AS BIGINT) AS u16, CAST(4606290 AS BIGINT) AS u24, CAST(1179011410 AS BIGINT) AS u32, CAST(18770 AS BIGINT) AS i16, {pick(*(int.from_bytes(b'WEBP' + c, 'little') for c in (b'VP8L', b'VP8 ', b'VP8X', b'VP8X', b'VP8X', b'VP8X')))} AS i64, CAST(NULL AS BIGINT) AS beyond FROM embeddings")

    def wished(spark: SparkSession, sf: str) -> DataFrame:
        return images.target_sizes(images.images(files(spark, sf), "DROPMALFORMED"), 40.5, 24, True).select(key(), "target_width", "target_height")

    ratio = "least(40.5::DOUBLE / w, 24::DOUBLE / h)"
    _add("a04_z01_target_sizes", wished,
         f"""SELECT vec_id, CAST(greatest(1, floor(w * {ratio} + 0.5)) AS INTEGER) AS target_width, CAST(greatest(1, floor(h * {ratio} + 0.5)) AS INTEGER) AS target_height
         FROM (SELECT vec_id, {image['source_width']} AS w, {image['source_height']} AS h FROM embeddings WHERE {kind} <> 5)""")  # fmt: skip

    def line(spark: SparkSession, sf: str) -> DataFrame:
        return images.images(files(spark, sf), "DROPMALFORMED").select(key(), animation.status(F.concat(F.lit("i"), F.col("image_id")), F.lit(7)).alias("status"))

    _add("g04_status", line, f"""SELECT vec_id, concat_ws(' | ', 'i' || vec_id, ({image['source_width']}) || 'x' || ({image['source_height']}),
        CASE WHEN {kind} = 3 THEN 'frames=2 | loop=' || CASE WHEN vec_id % 9 = 0 THEN 'forever' ELSE CAST(vec_id % 9 AS VARCHAR) END || ' | duration=' || (40 + vec_id % 300) || 'ms' ELSE 'still' END,
        CASE WHEN {image['has_alpha']} THEN 'alpha' END, CASE WHEN {image['lossy']} THEN 'lossy' ELSE 'lossless' END, 'load=7ms') AS status FROM embeddings WHERE {kind} <> 5""")  # fmt: skip


def _raster_bytes(spark: SparkSession, sf: str) -> DataFrame:
    rows = carriers.pictures(spark, sf).withColumn("argb", F.transform("argb", lambda p: F.when(F.col("vec_id") % 2 == 0, p % (1 << 24) + (255 << 24)).otherwise(p)))
    shown = images.frames(carriers.encoded(rows, lambda i, p: encode.riff(encode.chunk(b"VP8L", encode.lossless(p, 8, 8)))))
    return images.rasters(shown).select(F.col("image_id").cast("long").alias("vec_id"), "kind", F.hex("raster").alias("raster"))


_add("g01_rasters", _raster_bytes,
     f"""WITH {carriers.PICTURES} SELECT vec_id, CASE WHEN vec_id % 2 = 0 OR bool_and(p >> 24 = 255) THEN 'RGB' ELSE 'ARGB' END AS kind,
     CASE WHEN vec_id % 2 = 0 OR bool_and(p >> 24 = 255) THEN string_agg(printf('%06X', p % 16777216), '' ORDER BY y, x) ELSE string_agg(printf('%08X', p), '' ORDER BY y, x) END AS raster
     FROM pictures GROUP BY vec_id""")  # fmt: skip


def over(s: str, d: str) -> str:
    """SQL of F8."""
    ch = lambda p, k: f"(({p} >> {k}) & 255)"
    sa, da = ch(s, 24), ch(d, 24)
    kept = f"((({da} * (255 - {sa}) + 128) + (({da} * (255 - {sa}) + 128) >> 8)) >> 8)"
    mixed = " + ".join(f"(((({ch(s, k)} * {sa} + {ch(d, k)} * {kept}) * (16777216 // greatest({sa} + {kept}, 1))) >> 24) & 255) * {1 << k}" for k in (16, 8, 0))
    return f"CASE WHEN {sa} = 0 THEN {d} WHEN {sa} = 255 OR {da} = 0 THEN {s} ELSE ({sa} + {kept}) * 16777216 + {mixed} END"


def _frame_queries() -> None:
    files = lambda s, d: carriers.encoded(carriers.pictures(s, d), encode.composed_file)
    inner, low = "x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5", "y >= 4"
    shown = f"""WITH {carriers.PICTURES},
      placed AS (SELECT p.vec_id, p.x, p.y, CASE WHEN p.p >> 24 = 0 THEN 0 ELSE p.p END AS c0, q.p AS square, h.p AS half FROM pictures p
        LEFT JOIN pictures q ON q.vec_id = p.vec_id AND p.x BETWEEN 2 AND 5 AND p.y BETWEEN 2 AND 5 AND q.y * 8 + q.x = (p.y - 2) * 4 + p.x - 2
        LEFT JOIN pictures h ON h.vec_id = p.vec_id AND p.y >= 4 AND h.y * 8 + h.x = 16 + (p.y - 4) * 8 + p.x),
      one AS (SELECT *, CASE WHEN NOT ({inner}) THEN c0 WHEN vec_id % 2 = 0 THEN {over('square', 'c0')} ELSE square END AS c1 FROM placed),
      cleared AS (SELECT *, CASE WHEN vec_id % 3 = 0 AND {inner} THEN 0 ELSE c1 END AS k FROM one),
      shown AS (SELECT *, CASE WHEN {low} THEN {over('half', 'k')} ELSE k END AS c2 FROM cleared),
      frames AS (SELECT vec_id, n AS frame_no, x, y, CASE n WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS p FROM shown, (VALUES (0), (1), (2)) v(n))"""
    _add("f09_f10_a01_frames", lambda s, d: _pixels(images.frames(files(s, d))), f"{shown} SELECT vec_id, CAST(frame_no AS INTEGER) AS frame_no, x, y, {_channels('p')} FROM frames")

    def scaled(spark: SparkSession, sf: str) -> DataFrame:
        return _pixels(images.frames(files(spark, sf), width=5, height=11, smooth=False))

    _add("z02_z03_frames_scaled", scaled, f"""{shown}, grid AS (SELECT t.c % 5 AS x, t.c // 5 AS y FROM (SELECT unnest(range(55)) AS c) t)
        SELECT vec_id, CAST(frame_no AS INTEGER) AS frame_no, g.x, g.y, {_channels('p')} FROM frames f JOIN grid g ON f.x = least(7, g.x * 8 // 5) AND f.y = least(7, g.y * 8 // 11)""")  # fmt: skip

    def rows(spark: SparkSession, sf: str) -> DataFrame:
        out = images.collected(images.frames(files(spark, sf)))
        return out.select(F.col("image_id").cast("long").alias("vec_id"), "frame_count", F.expr("aggregate(frames, 0, (n, f) -> n + f.duration_ms)").alias("total_ms"), F.col("first_frame.stride").alias("stride"), F.expr("transform(frames, f -> f.frame_no) = array(0, 1, 2)").alias("in_order"))

    _add("a02_a05_a11_collected", rows, "SELECT vec_id, 3 AS frame_count, 60 AS total_ms, 8 AS stride, true AS in_order FROM embeddings")

    def lookup(spark: SparkSession, sf: str) -> DataFrame:
        x, y = F.col("vec_id") % 8, F.floor(F.col("vec_id") / 8) % 8
        shown_ = images.frames(files(spark, sf)).withColumn("vec_id", F.col("image_id").cast("long"))
        return shown_.where("frame_no = 0").select("vec_id", px.wide(images.pixel_at(x, y)).alias("pixel"), images.pixel_at(F.lit(8), F.lit(0), False).alias("outside"))

    _add("a06_a07_pixel_at", lookup, f"WITH {carriers.PICTURES} SELECT vec_id, CASE WHEN p >> 24 = 0 THEN 0 ELSE p END AS pixel, CAST(NULL AS INTEGER) AS outside FROM pictures WHERE x = vec_id % 8 AND y = vec_id // 8 % 8")


def _raster_queries() -> None:
    tiles = lambda s, d: carriers.pictures(s, d).select("vec_id", F.transform("argb", px.red).alias("l"), "argb")
    levels = lambda s, d, c: scaling.by_place(tiles(s, d).select("vec_id", c.alias("v")), "vec_id", "v", 8)
    kind = lambda: (F.col("vec_id") % 4).cast("int")
    gradient = """SELECT vec_id, k + 1, list_append(v, (l[k + 1] + CASE
        WHEN k = 0 OR vec_id % 4 = 0 THEN 0
        WHEN vec_id % 4 = 1 THEN CASE WHEN k % 8 > 0 THEN v[k] ELSE v[k - 7] END
        WHEN vec_id % 4 = 2 THEN CASE WHEN k >= 8 THEN v[k - 7] ELSE v[k] END
        WHEN k < 8 THEN v[k] WHEN k % 8 = 0 THEN v[k - 7] ELSE least(greatest(v[k] + v[k - 7] - v[k - 8], 0), 255) END) % 256), l FROM g WHERE k < 64"""
    _add("f02_f07_alpha_filters", lambda s, d: levels(s, d, prediction.alpha("l", 8, kind())),
         f"""WITH RECURSIVE {carriers.TILES}, lists AS (SELECT vec_id, list(l ORDER BY y, x) AS l FROM tiles GROUP BY vec_id),
         g(vec_id, k, v, l) AS (SELECT vec_id, 0, CAST([] AS BIGINT[]), l FROM lists UNION ALL {gradient})
         SELECT vec_id, CAST(i % 8 AS BIGINT) AS x, CAST(i // 8 AS BIGINT) AS y, v[i + 1] AS value FROM (SELECT vec_id, v, unnest(range(64)) AS i FROM g WHERE k = 64)""")  # fmt: skip

    def big(spark: SparkSession, sf: str) -> DataFrame:
        rows = tiles(spark, sf).select("vec_id", scaling.bilinear("argb", 8, 8, 13, 6).alias("v"))
        return scaling.by_place(rows, "vec_id", "v", 13)

    lerp = lambda a, b, t: f"({a} + ({b} - {a}) * {t})"
    ch = lambda p, k: f"CAST((({p} >> {k}) & 255) AS FLOAT)"
    value = " + ".join(f"CAST(floor(CAST({lerp(lerp(ch('a.p', k), ch('b.p', k), 'fx'), lerp(ch('c.p', k), ch('e.p', k), 'fx'), 'fy')} AS DOUBLE) + 0.5) AS BIGINT) * {1 << k}" for k in (24, 16, 8, 0))
    _add("z04_bilinear_argb", big,
         f"""WITH {carriers.PICTURES}, g AS (SELECT tx, ty, CAST(least(7, floor(sx)) AS BIGINT) AS x0, CAST(least(7, floor(sy)) AS BIGINT) AS y0, CAST(sx - least(7, floor(sx)) AS FLOAT) AS fx, CAST(sy - least(7, floor(sy)) AS FLOAT) AS fy
               FROM (SELECT c % 13 AS tx, c // 13 AS ty, (c % 13)::FLOAT * (7::FLOAT / 12::FLOAT) AS sx, (c // 13)::FLOAT * (7::FLOAT / 5::FLOAT) AS sy FROM (SELECT unnest(range(78)) AS c)))
         SELECT a.vec_id, CAST(tx AS BIGINT) AS x, CAST(ty AS BIGINT) AS y, {value} AS value FROM g JOIN pictures a ON a.x = x0 AND a.y = y0 JOIN pictures b ON b.vec_id = a.vec_id AND b.x = least(7, x0 + 1) AND b.y = y0
         JOIN pictures c ON c.vec_id = a.vec_id AND c.x = x0 AND c.y = least(7, y0 + 1) JOIN pictures e ON e.vec_id = a.vec_id AND e.x = least(7, x0 + 1) AND e.y = least(7, y0 + 1)""")  # fmt: skip

    def chroma(spark: SparkSession, sf: str) -> DataFrame:
        at = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("c")
        rows = carriers.pictures(spark, sf).select("vec_id", "argb", at)
        first = F.floor(F.col("c") / 4).cast("int") * 16 + F.col("c") % 4 * 2
        total = lambda f: sum((f(F.get("argb", first + k)) for k in (1, 8, 9)), f(F.get("argb", first)))
        r, g, b = total(px.red), total(px.green), total(px.blue)
        return rows.select("vec_id", F.col("c").cast("long").alias("square"), px.rgb_to_u(r, g, b).alias("u"), px.rgb_to_v(r, g, b).alias("v"))

    sums = "sum((p >> 16) & 255) AS r, sum((p >> 8) & 255) AS g, sum(p & 255) AS b"
    _add("p20_rgb_to_chroma", chroma,
         f"""WITH {carriers.PICTURES} SELECT vec_id, square, CAST((CAST(-9719 * r - 19081 * g + 28800 * b + 33554432 AS BIGINT) >> 18) & 255 AS BIGINT) AS u, CAST((CAST(28800 * r - 24116 * g - 4684 * b + 33554432 AS BIGINT) >> 18) & 255 AS BIGINT) AS v
         FROM (SELECT vec_id, y // 2 * 4 + x // 2 AS square, {sums} FROM pictures GROUP BY ALL)""")  # fmt: skip
    one = lambda f: lambda s, d: carriers.pixel_pairs(s, d).select("l_orderkey", "l_linenumber", *f(F.col("p"), F.col("q")))
    _add("p21_filter_helpers", one(lambda p, q: [px.signed_of_byte(px.red(p)).alias("s"), px.byte_of_signed(px.red(p) - px.green(p)).alias("u"), px.difference(px.red(p), px.red(q)).alias("d")]),
         f"WITH {carriers.PAIRS} SELECT l_orderkey, l_linenumber, ((p >> 16) & 255) - 128 AS s, least(greatest(((p >> 16) & 255) - ((p >> 8) & 255), -128), 127) + 128 AS u, abs(((p >> 16) & 255) - ((q >> 16) & 255)) AS d FROM pairs")
    _add("l14_cache_hash", one(lambda p, q: [F.shiftright((F.lit(0x1E35A7BD) * px.wide(p)).bitwiseAND(F.lit(px.WORD)), 24).alias("slot")]),
         f"WITH {carriers.PAIRS} SELECT l_orderkey, l_linenumber, CAST(((506832829::HUGEINT * p) % 4294967296) // 16777216 AS BIGINT) AS slot FROM pairs")

    def keys(spark: SparkSession, sf: str) -> DataFrame:
        rows = carriers.timeline(spark, sf)
        return animation.keyframes(rows, F.col("image_id") % 3)

    _add("g03_keyframes", keys,
         f"""WITH {carriers.TIMELINE}, starts AS (SELECT image_id, frame_no, CAST(coalesce(sum(greatest(1, duration_ms)) OVER (PARTITION BY image_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM timeline
         UNION ALL SELECT image_id, NULL, CAST(sum(greatest(1, duration_ms)) AS BIGINT) FROM timeline GROUP BY image_id)
         SELECT image_id, frame_no, start_ms, CASE WHEN image_id % 3 > 0 THEN CAST(image_id % 3 AS BIGINT) END AS cycles FROM starts""")  # fmt: skip


def clamp(x: str, low: int = 0, high: int = 255) -> str:
    return f"least(greatest({x}, {low}), {high})"


def _lossy_queries() -> None:
    levels = lambda s, d: carriers.pictures(s, d).select("vec_id", F.transform("argb", px.red).alias("l"))
    lists = f"{carriers.TILES}, lists AS (SELECT vec_id, list(l ORDER BY y, x) AS l FROM tiles GROUP BY vec_id)"

    def flat(spark: SparkSession, sf: str) -> DataFrame:
        files = carriers.encoded(carriers.pictures(spark, sf), lambda i, p: encode.riff(encode.chunk(b"VP8 ", encode_lossy.flat_frame(i))))
        one = _pixels(images.frames(files, lossy=encode_lossy.made_up_tables()))
        return one.groupBy("vec_id", F.floor(F.col("x") / 16).alias("block"), *ARGB).agg(F.count("*").alias("n"))

    luma = lambda t: f"((((({t}) * 42 + 3) >> 3) + 4) >> 3)"
    chroma = lambda t: f"((({t}) * 21 + 4) >> 3)"
    part = lambda x, k: f"((({x}) * {k}) >> 8)"
    r, g, b = (clamp(f"({x}) >> 6") for x in (f"{part('yy', 19077)} + {part('vv', 26149)} - 14234", f"{part('yy', 19077)} - {part('uu', 6419)} - {part('vv', 13320)} + 8708", f"{part('yy', 19077)} + {part('uu', 33050)} - 17685"))
    _add("v01_v18_v33_v49_flat_frames", flat,
         f"""WITH n AS (SELECT vec_id, vec_id % 4 AS ml, vec_id // 4 % 4 AS mc, {clamp('128 + ' + luma('vec_id * 7 % 121 - 60'))} AS y0, {clamp('128 + ' + chroma('vec_id * 3 % 31 - 15'))} AS u0, {clamp('128 + ' + chroma('vec_id * 5 % 71 - 35'))} AS v0 FROM embeddings),
         two AS (SELECT vec_id, 0 AS block, y0 AS yy, u0 AS uu, v0 AS vv FROM n UNION ALL SELECT vec_id, 1,
           {clamp('CASE ml WHEN 1 THEN 127 ELSE y0 END + ' + luma('vec_id % 41 - 20'))}, {clamp('CASE mc WHEN 1 THEN 127 ELSE u0 END + ' + chroma('vec_id % 7 - 3'))}, {clamp('CASE mc WHEN 1 THEN 127 ELSE v0 END + ' + chroma('4 - vec_id % 9'))} FROM n)
         SELECT vec_id, CAST(block AS BIGINT) AS block, CAST(255 AS INTEGER) AS a, CAST({r} AS INTEGER) AS r, CAST({g} AS INTEGER) AS g, CAST({b} AS INTEGER) AS b, CAST(256 AS BIGINT) AS n FROM two""")  # fmt: skip

    quarters = lambda s, d: levels(s, d).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "l")
    coefficients = lambda: F.transform(F.slice("l", F.col("k") * 16 + 1, F.lit(16)), lambda v: (v - 128) * 9)

    def blocks(op) -> Query:
        def query(spark: SparkSession, sf: str) -> DataFrame:
            one = quarters(spark, sf).select("vec_id", F.col("k").cast("long").alias("k"), F.posexplode(op(coefficients())).alias("at", "value"))
            return one.withColumn("at", F.col("at").cast("long"))

        return query

    def passes(low_high, last: str) -> str:
        """Two passes over 4 x 4 values in columns c0 to c15: down, then across."""
        down, across = [""] * 16, [""] * 16
        for k in range(4):
            for i, x in enumerate(low_high(*(f"c{4 * j + k}" for j in range(4)))):
                down[4 * i + k] = f"{x} AS d{4 * i + k}"
            for i, x in enumerate(low_high(*(f"d{4 * k + j}" for j in range(4)))):
                across[4 * k + i] = last.format(x)
        return f"""WITH {lists}, c AS (SELECT vec_id, k, {', '.join(f'(l[k * 16 + {i + 1}] - 128) * 9 AS c{i}' for i in range(16))} FROM (SELECT vec_id, l, unnest(range(4)) AS k FROM lists)),
          d AS (SELECT vec_id, k, {', '.join(down)} FROM c), o AS (SELECT vec_id, k, [{', '.join(across)}] AS v FROM d)
          SELECT vec_id, CAST(k AS BIGINT) AS k, CAST(i AS BIGINT) AS at, CAST(v[i + 1] AS BIGINT) AS value FROM (SELECT *, unnest(range(16)) AS i FROM o)"""

    def dct(a: str, b: str, c: str, d: str) -> list[str]:
        low, high = f"((({b} * 35468) >> 16) - {d} - (({d} * 20091) >> 16))", f"({b} + (({b} * 20091) >> 16) + (({d} * 35468) >> 16))"
        return [f"({a} + {c} + {high})", f"({a} - {c} + {low})", f"({a} - {c} - {low})", f"({a} + {c} - {high})"]

    _add("v14_inverse_dct", blocks(lossy.inverse_dct), passes(dct, "(({} + 4) >> 3)"))
    _add("v15_inverse_wht", blocks(lossy.inverse_wht), passes(lambda a, b, c, d: [f"({a} + {b} + {c} + {d})", f"({a} + {b} - {c} - {d})", f"({a} - {b} - {c} + {d})", f"({a} - {b} + {c} - {d})"], "(({} + 3) >> 3)"))

    def around(spark: SparkSession, sf: str) -> DataFrame:
        rows = quarters(spark, sf).withColumn("mode", ((F.col("vec_id") + F.col("k")) % 10).cast("int"))
        one = rows.select("vec_id", F.col("k").cast("long").alias("k"), F.posexplode(lossy.predicted_block(F.col("mode"), F.slice("l", F.col("k") * 16 + 1, F.lit(13)))).alias("at", "value"))
        return one.withColumn("at", F.col("at").cast("long"))

    e = [f"e[{i + 1}]" for i in range(13)]
    left, corner, above = e[3::-1], e[4], e[5:]
    two = lambda x, y: f"(({x} + {y} + 1) >> 1)"
    three = lambda x, y, z: f"(({x} + 2 * {y} + {z} + 2) >> 2)"
    t, w = (lambda i: three(*e[i : i + 3])), (lambda i: two(*e[i : i + 2]))  # of the edge from left, low, to above, right
    u, x2 = (lambda i: three(*(above + above[-1:])[i : i + 3])), (lambda i: two(*above[i : i + 2]))
    m, h2 = (lambda i: three(*(left + left[-1:])[i : i + 3])), (lambda i: two(*left[i : i + 2]))
    by_mode = [
        [f"(({' + '.join(above[:4] + left)} + 4) >> 3)"] * 16,
        [clamp(f"{left[r]} + {above[c]} - {corner}") for r in range(4) for c in range(4)],
        [three(*([corner] + above)[c : c + 3]) for r in range(4) for c in range(4)],
        [three(*([corner] + left + left[-1:])[r : r + 3]) for r in range(4) for c in range(4)],
        [u(r + c) for r in range(4) for c in range(4)],
        [t(3 - r + c) for r in range(4) for c in range(4)],
        [w(4), w(5), w(6), w(7), t(3), t(4), t(5), t(6), t(2), w(4), w(5), w(6), t(1), t(3), t(4), t(5)],
        [x2(0), x2(1), x2(2), x2(3), u(0), u(1), u(2), u(3), x2(1), x2(2), x2(3), u(4), u(1), u(2), u(3), u(5)],
        [w(3), t(3), t(4), t(5), w(2), t(2), w(3), t(3), w(1), t(1), w(2), t(2), w(0), t(0), w(1), t(1)],
        [h2(0), m(0), h2(1), m(1), h2(1), m(1), h2(2), m(2), h2(2), m(2), left[3], left[3], *left[3:4] * 4],
    ]
    chosen = "CASE (vec_id + k) % 10 " + " ".join(f"WHEN {i} THEN [{', '.join(v)}]" for i, v in enumerate(by_mode)) + " END"
    _add("v19_v32_predicted_blocks", around,
         f"""WITH {lists}, o AS (SELECT vec_id, k, {chosen} AS v FROM (SELECT vec_id, k, list_slice(l, k * 16 + 1, k * 16 + 13) AS e FROM (SELECT vec_id, l, unnest(range(4)) AS k FROM lists)))
         SELECT vec_id, CAST(k AS BIGINT) AS k, CAST(i AS BIGINT) AS at, CAST(v[i + 1] AS BIGINT) AS value FROM (SELECT *, unnest(range(16)) AS i FROM o)""")  # fmt: skip

    def edges(spark: SparkSession, sf: str) -> DataFrame:
        rows = levels(spark, sf).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), "l")
        line = F.transform(F.slice("l", F.col("k") * 8 + 1, F.lit(8)), lambda v: F.least(F.lit(255), F.floor(v / (1 + F.col("k") * 4)) + 100))
        kind = F.element_at(F.array(*map(F.lit, ("simple", "block", "macro"))), (F.col("vec_id") % 3 + 1).cast("int"))
        one = rows.select("vec_id", "k", F.posexplode(lossy.filtered(kind, line, 40, 12, 2)).alias("at", "value"))
        return one.withColumns({"k": F.col("k").cast("long"), "at": F.col("at").cast("long")})

    p3, p2, p1, p0, q0, q1, q2, q3 = (f"(v[{i}] - 128)" for i in range(1, 9))
    c8 = lambda x: clamp(x, -128, 127)
    passed = f"(abs({p0} - {q0}) * 2 + (abs({p1} - {q1}) >> 1) <= 40 AND (kind = 0 OR greatest(" + ", ".join(f"abs({x} - {y})" for x, y in ((p3, p2), (p2, p1), (p1, p0), (q3, q2), (q2, q1), (q1, q0))) + ") <= 12))"
    varied = f"(abs({p1} - {p0}) > 2 OR abs({q1} - {q0}) > 2)"
    moved = [
        "v[1]", f"CASE WHEN ok AND kind = 2 AND NOT varied THEN {c8(f'{p2} + {c8("(9 * w + 63) >> 7")}')} + 128 ELSE v[2] END",
        f"CASE WHEN ok AND kind = 2 AND NOT varied THEN {c8(f'{p1} + {c8("(18 * w + 63) >> 7")}')} + 128 WHEN ok AND kind = 1 AND NOT varied THEN {c8(f'{p1} + ((f + 1) >> 1)')} + 128 ELSE v[3] END",
        f"CASE WHEN ok AND kind = 2 AND NOT varied THEN {c8(f'{p0} + {c8("(27 * w + 63) >> 7")}')} + 128 WHEN ok THEN {c8(f'{p0} + g')} + 128 ELSE v[4] END",
        f"CASE WHEN ok AND kind = 2 AND NOT varied THEN {c8(f'{q0} - {c8("(27 * w + 63) >> 7")}')} + 128 WHEN ok THEN {c8(f'{q0} - f')} + 128 ELSE v[5] END",
        f"CASE WHEN ok AND kind = 2 AND NOT varied THEN {c8(f'{q1} - {c8("(18 * w + 63) >> 7")}')} + 128 WHEN ok AND kind = 1 AND NOT varied THEN {c8(f'{q1} - ((f + 1) >> 1)')} + 128 ELSE v[6] END",
        f"CASE WHEN ok AND kind = 2 AND NOT varied THEN {c8(f'{q2} - {c8("(9 * w + 63) >> 7")}')} + 128 ELSE v[7] END", "v[8]",
    ]
    _add("v37_v40_filtered_edges", edges,
         f"""WITH {lists}, a AS (SELECT vec_id, k, vec_id % 3 AS kind, list_transform(list_slice(l, k * 8 + 1, k * 8 + 8), lambda x: least(255, x // (1 + k * 4) + 100)) AS v FROM (SELECT vec_id, l, unnest(range(8)) AS k FROM lists)),
         b AS (SELECT *, {passed} AS ok, {varied} AS varied FROM a),
         c AS (SELECT *, {c8(f'CASE WHEN kind = 1 AND NOT varied THEN 0 ELSE {c8(f"{p1} - {q1}")} END + 3 * ({q0} - {p0})')} AS w FROM b),
         d AS (SELECT *, {c8('w + 4')} >> 3 AS f, {c8('w + 3')} >> 3 AS g FROM c), o AS (SELECT vec_id, k, [{', '.join(moved)}] AS v FROM d)
         SELECT vec_id, CAST(k AS BIGINT) AS k, CAST(i AS BIGINT) AS at, CAST(v[i + 1] AS BIGINT) AS value FROM (SELECT *, unnest(range(8)) AS i FROM o)""")  # fmt: skip

    def coloured(fancy: bool, as_bytes: bool) -> Query:
        def query(spark: SparkSession, sf: str) -> DataFrame:
            rows = levels(spark, sf).select("vec_id", "l", F.slice("l", 1, 16).alias("u"), F.slice("l", 17, 16).alias("v"))
            if as_bytes:
                rows = rows.select("vec_id", lossy.rgb_bytes("l", "u", "v", 8, fancy).alias("b"))
                one = rows.select("vec_id", "b", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))
                value = [F.conv(F.hex(F.substring(F.col("b"), F.col("at") * 3 + k, F.lit(1))), 16, 10).cast("int").alias(c) for k, c in ((1, "r"), (2, "g"), (3, "b"))]
                return one.select("vec_id", (F.col("at") % 8).cast("long").alias("x"), F.floor(F.col("at") / 8).alias("y"), *value)
            one = scaling.by_place(rows.select("vec_id", lossy.pixels("l", "u", "v", 8, fancy).alias("p")), "vec_id", "p", 8)
            return one.select("vec_id", "x", "y", *[f(F.col("value")).cast("int").alias(c) for c, f in (("r", px.red), ("g", px.green), ("b", px.blue))])

        return query

    def planes(fancy: bool) -> str:
        near = "l[{o} + (y // 2) * 4 + x // 2 + 1]"
        if fancy:
            ny, nx = "least(greatest(y // 2 + 2 * (y % 2) - 1, 0), 3)", "least(greatest(x // 2 + 2 * (x % 2) - 1, 0), 3)"
            near = "((9 * " + near + " + 3 * l[{o} + " + ny + " * 4 + x // 2 + 1] + 3 * l[{o} + (y // 2) * 4 + " + nx + " + 1] + l[{o} + " + ny + " * 4 + " + nx + " + 1] + 8) >> 4)"
        return f"""WITH {lists}, q AS (SELECT vec_id, l, unnest(range(64)) AS i FROM lists), p AS (SELECT vec_id, l, i % 8 AS x, i // 8 AS y FROM q),
          o AS (SELECT vec_id, x, y, l[y * 8 + x + 1] AS yy, {near.format(o=0)} AS uu, {near.format(o=16)} AS vv FROM p)
          SELECT vec_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST({r} AS INTEGER) AS r, CAST({g} AS INTEGER) AS g, CAST({b} AS INTEGER) AS b FROM o"""

    _add("v42_v45_simple_pixels", coloured(False, False), planes(False))
    _add("v43_fancy_pixels", coloured(True, False), planes(True))
    _add("v44_rgb_bytes", coloured(True, True), planes(True))

    def limits(spark: SparkSession, sf: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_partkey") % 64).cast("int").alias("level"), (F.col("p_size") % 8).cast("int").alias("sharp"))
        v = lossy.filter_limits("level", "sharp")
        q = lossy.quantizer_steps((F.col("p_partkey") % 128).cast("int"))
        rows = rows.select("p_partkey", v.alias("v"), q.alias("q"))
        return rows.select("p_partkey", F.col("v")[0].alias("level"), F.col("v")[1].alias("inner_limit"), F.col("v")[2].alias("high"), *[F.col("q")[k].alias(f"step{k}") for k in range(6)])

    inner = "greatest(1, CASE WHEN s = 0 THEN v ELSE least(9 - s, CASE WHEN s > 4 THEN v >> 2 ELSE v >> 1 END) END)"
    dc, ac = (f"[{', '.join(map(str, x))}][q + 1]" for x in (vp8.DC_STEP, vp8.AC_STEP))
    _add("v07_v35_steps_and_limits", limits,
         f"""SELECT p_partkey, CAST(v AS BIGINT) AS level, CAST({inner} AS BIGINT) AS inner_limit, CAST(CASE WHEN v >= 40 THEN 2 WHEN v >= 15 THEN 1 ELSE 0 END AS BIGINT) AS high,
         CAST({dc} AS BIGINT) AS step0, CAST({ac} AS BIGINT) AS step1, CAST(2 * {dc} AS BIGINT) AS step2, CAST(greatest(8, {ac} * 155 // 100) AS BIGINT) AS step3, CAST(least(132, {dc}) AS BIGINT) AS step4, CAST({ac} AS BIGINT) AS step5
         FROM (SELECT p_partkey, p_partkey % 64 AS v, p_size % 8 AS s, p_partkey % 128 AS q FROM part)""")  # fmt: skip


_lossless_queries()
_container_queries()
_frame_queries()
_raster_queries()
_lossy_queries()
