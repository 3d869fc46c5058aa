"""Queries that go through files and the data source, and over frames made of the tables; with the SQL of what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaframe.functions import pixels as px
from lumaframe.operators import animation, entropy, sketches, tiled
from lumaframe.plans import carriers, image_queries
from lumaframe.plans.image_queries import ARGB, over
from lumaframe.sources import datasource, files, images
from lumaframe.sources.files import kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _le(value: Column, n: int) -> Column:
    """n bytes of a number, the lowest first."""
    return F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(255)), 2, "0")) for k in range(n)))


def _chunk(code: str, data: Column) -> Column:
    pad = F.when(F.octet_length(data) % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.lit(b""))
    return F.concat(F.lit(code.encode()), _le(F.octet_length(data), 4), data, pad)


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    """(image_id, content): every page's html as the XMP metadata, and again behind the head of the image, of a file."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    w, h = F.col("page_id") % 1000, F.col("page_id") % 77
    head = F.concat(F.lit(b"\x04\0\0\0"), _le(w, 3), _le(h, 3))
    body = F.concat(F.lit(b"WEBP"), _chunk("VP8X", head), _chunk("XMP ", F.col("html")), _chunk("VP8L", F.concat(F.lit(b"\x2f"), _le(w + h * 16384, 4), F.col("html"))))
    rows = rows.select(F.col("page_id").cast("string").alias("image_id"), body.alias("body"))
    return rows.select("image_id", F.concat(F.lit(b"RIFF"), _le(F.octet_length("body"), 4), F.col("body")).alias("content"))


def _read_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = files.shared_folder(spark, "pages")
    files.write_files(page_files(spark, sf).repartition(spark.sparkContext.defaultParallelism), folder)
    spark.dataSource.register(datasource.ImageSource)
    rows = spark.read.format("lumaframe").option("mode", "FAILFAST").load(folder)
    page = F.regexp_extract("image_id", r"(-?\d+)\.webp$", 1).cast("long").alias("page_id")
    return rows.select(page, "source_width", "source_height", "lossy", F.octet_length("metadata.xmp").alias("xmp_bytes"), F.md5("metadata.xmp").alias("xmp_md5"))


_add("s01_s03_a09_files", _read_files, """
    SELECT page_id, CAST(page_id % 1000 + 1 AS INTEGER) AS source_width, CAST(page_id % 77 + 1 AS INTEGER) AS source_height, false AS lossy,
      CAST(octet_length(encode(coalesce(html, ''))) AS INTEGER) AS xmp_bytes, md5(coalesce(html, '')) AS xmp_md5 FROM pages""")  # fmt: skip


def long_animations(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded frames of three animations of 8 x 8 pixels, one vector's picture a frame: about two in five cover the
    canvas, half of those without blending; the others are 4 x 4; one in four is cleared away."""
    v = F.col("vec_id")
    kind = (v * 7 + F.floor(v / 5)) % 5
    whole = kind < 2
    rows = carriers.pictures(spark, sf).withColumn("argb", F.transform("argb", lambda p: px.signed(p).cast("int")))
    place = lambda c: F.when(whole, 0).otherwise(c).cast("int")
    side = F.when(whole, 8).otherwise(4)
    return rows.select(
        (v % 3).cast("string").alias("image_id"), F.floor(v / 3).cast("int").alias("frame_no"), F.lit(8).alias("source_width"), F.lit(8).alias("source_height"),
        place(2 * (v % 3)).alias("x"), place(2 * (F.floor(v / 2) % 3)).alias("y"), side.alias("width"), side.alias("height"), F.lit(40).alias("duration_ms"),
        F.when(whole, kind == 1).otherwise(v % 2 == 0).alias("blend"), (v % 4 == 0).alias("dispose"), F.slice("argb", F.lit(1), side * side).alias("argb"),
    )


COMPOSED = f"""{carriers.PICTURES},
  f AS (SELECT vec_id, vec_id % 3 AS image_id, vec_id // 3 AS k, kind < 2 AS whole, CASE WHEN kind < 2 THEN 0 ELSE 2 * (vec_id % 3) END AS x0, CASE WHEN kind < 2 THEN 0 ELSE 2 * (vec_id // 2 % 3) END AS y0,
    CASE WHEN kind < 2 THEN 8 ELSE 4 END AS side, CASE WHEN kind < 2 THEN kind = 1 ELSE vec_id % 2 = 0 END AS blend, vec_id % 4 = 0 AS dispose
    FROM (SELECT vec_id, (vec_id * 7 + vec_id // 5) % 5 AS kind FROM embeddings)),
  pic AS (SELECT vec_id, y * 8 + x AS at, p FROM pictures),
  st(image_id, k, x, y, c) AS (
    SELECT i, CAST(-1 AS BIGINT), x, y, CAST(0 AS BIGINT) FROM (SELECT DISTINCT image_id AS i FROM f), (SELECT CAST(unnest(range(8)) AS BIGINT) AS x), (SELECT CAST(unnest(range(8)) AS BIGINT) AS y)
    UNION ALL
    SELECT image_id, k, x, y, CAST(CASE WHEN p IS NULL THEN base WHEN blend THEN {over('p', 'base')} ELSE p END AS BIGINT) FROM (
      SELECT s.image_id, f.k, s.x, s.y, pic.p, f.blend, CASE WHEN b.dispose AND (f.whole OR (s.x BETWEEN b.x0 AND b.x0 + b.side - 1 AND s.y BETWEEN b.y0 AND b.y0 + b.side - 1)) THEN 0 ELSE s.c END AS base
      FROM st s JOIN f ON f.image_id = s.image_id AND f.k = s.k + 1 LEFT JOIN f b ON b.image_id = s.image_id AND b.k = s.k
      LEFT JOIN pic ON pic.vec_id = f.vec_id AND s.x BETWEEN f.x0 AND f.x0 + f.side - 1 AND s.y BETWEEN f.y0 AND f.y0 + f.side - 1 AND pic.at = (s.y - f.y0) * f.side + s.x - f.x0))"""


def _pixels(shown: DataFrame) -> DataFrame:
    one = images.pixels(shown)
    return one.select(F.col("image_id").cast("long").alias("image_id"), "frame_no", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *ARGB)


_CHANNELS = ", ".join(f"CAST((c >> {s}) & 255 AS INTEGER) AS {n}" for n, s in ARGB.items())
_add("f09_f10_segments", lambda s, d: _pixels(images.frames_by_segment(long_animations(s, d))),
     f"WITH RECURSIVE {COMPOSED} SELECT image_id, CAST(k AS INTEGER) AS frame_no, x, y, {_CHANNELS} FROM st WHERE k >= 0")


def _some_frames(spark: SparkSession, sf: str) -> DataFrame:
    frames = long_animations(spark, sf)
    wanted = frames.where((F.col("frame_no") + F.col("image_id").cast("int")) % 7 == 3).select("image_id", "frame_no")
    return _pixels(images.frames_at(frames, wanted))


_add("f10_frames_at", _some_frames,
     f"WITH RECURSIVE {COMPOSED} SELECT image_id, CAST(k AS INTEGER) AS frame_no, x, y, {_CHANNELS} FROM st WHERE k >= 0 AND (k + image_id) % 7 = 3")


def _tiles(spark: SparkSession, sf: str, argb: Column | None = None) -> DataFrame:
    """Every vector's picture as 3 x 3 tiles."""
    rows = carriers.pictures(spark, sf)
    values = F.transform("argb", lambda p: px.signed(p).cast("int")) if argb is None else argb
    frames = rows.select(F.col("vec_id").cast("string").alias("image_id"), F.lit(0).alias("frame_no"), F.lit(8).alias("width"), F.lit(8).alias("height"), values.alias("argb"))
    return tiled.tiles(frames, 3)


def _values(rows: DataFrame) -> DataFrame:
    return tiled.pixels(rows).select(F.col("image_id").cast("long").alias("vec_id"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), px.wide(F.col("argb")).alias("value"))


_add("z04_tiled_bilinear", lambda s, d: _values(tiled.scale(_tiles(s, d), 13, 6, side=4)), image_queries.SQL["z04_bilinear_argb"])
_add("z03_tiled_nearest", lambda s, d: _values(tiled.scale(_tiles(s, d), 5, 11, smooth=False, side=4)), f"""
    WITH {carriers.PICTURES}, g AS (SELECT CAST(c % 5 AS BIGINT) AS x, CAST(c // 5 AS BIGINT) AS y FROM (SELECT unnest(range(55)) AS c))
    SELECT p.vec_id, g.x, g.y, p.p AS value FROM g JOIN pictures p ON p.x = least(7, g.x * 8 // 5) AND p.y = least(7, g.y * 8 // 11)""")  # fmt: skip
_add("f08_tiled_blend", lambda s, d: _values(tiled.blend(_tiles(s, d), _tiles(s, d, F.reverse(F.transform("argb", lambda p: px.signed(p).cast("int")))))), f"""
    WITH {carriers.PICTURES} SELECT p.vec_id, p.x, p.y, CAST({over('p.p', 'q.p')} AS BIGINT) AS value FROM pictures p JOIN pictures q ON q.vec_id = p.vec_id AND q.x = 7 - p.x AND q.y = 7 - p.y""")  # fmt: skip


RANKED = f"{carriers.TILES}, ranked AS (SELECT vec_id, y * 8 + x AS symbol, row_number() OVER (PARTITION BY vec_id ORDER BY l, y, x) - 1 AS i, 2 + vec_id % 14 AS n FROM tiles)"


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    """(code, symbol, i, n, length): of each vector a code over its n lowest components, words of 1, 2, 3 ... bits; one code
    in five lacks its last symbol."""
    rows = carriers.tiles(spark, sf).select("vec_id", (F.col("y") * 8 + F.col("x")).alias("symbol"), "l", (2 + F.col("vec_id") % 14).alias("n"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("vec_id").orderBy("l", "symbol")) - 1)
    wanted = F.when(F.col("vec_id") % 5 == 0, F.col("n") - 1).otherwise(F.col("n"))
    return rows.where(F.col("i") < wanted).select(F.col("vec_id").alias("code"), "symbol", "i", "n", F.least(F.col("i") + 1, F.col("n") - 1).cast("int").alias("length"))


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = entropy.canonical(_lengths(spark, sf))
    return rows.select("code", F.col("symbol").cast("long").alias("symbol"), "length", "word", "complete")


_add("l08_l09_canonical_codes", _codes, f"""
    WITH {RANKED}, len AS (SELECT vec_id AS code, symbol, i, least(i + 1, n - 1) AS length FROM ranked WHERE i < n - CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END),
    n AS (SELECT code, count(*) AS c, sum(pow(2, -length)) AS filled FROM len GROUP BY code),
    w AS (SELECT a.code, a.symbol, a.length, CAST(floor(coalesce(sum(pow(2, -b.length)), 0) * pow(2, a.length)) AS BIGINT) AS word
      FROM len a LEFT JOIN len b ON b.code = a.code AND (b.length < a.length OR (b.length = a.length AND b.symbol < a.symbol)) GROUP BY a.code, a.symbol, a.length)
    SELECT code, symbol, CAST(CASE WHEN c = 1 THEN 0 ELSE length END AS INTEGER) AS length, CASE WHEN c = 1 THEN 0 ELSE word END AS word, c = 1 OR filled = 1 AS complete FROM w JOIN n USING (code)""")  # fmt: skip


def _decoded_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty symbols of each code written as bits and read again from those bits and the lengths alone."""
    lengths = _lengths(spark, sf)
    codes = kept(entropy.canonical(lengths), "codes")
    asked = lengths.select("code", "n").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(19))))
    asked = asked.withColumn("i", (F.col("code") * 3 + F.col("j") * F.col("j")) % F.col("n")).join(lengths.select("code", "i", "symbol").hint("merge"), ["code", "i"]).join(codes.select("code", "symbol", "length", "word").hint("merge"), ["code", "symbol"])
    word = F.when(F.col("length") > 0, F.lpad(F.bin("word"), F.col("length"), "0")).otherwise(F.lit(""))
    written = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", word.alias("w")))), lambda x: x["w"]), "")
    bits = asked.groupBy("code").agg(written.alias("bits"))
    places = bits.where("bits <> ''").select("code", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.length("bits").cast("long") - 1)).alias("at"))
    window = F.conv(F.rpad(F.substring("bits", F.col("at") + 1, F.lit(15)), 15, "0"), 2, 10).cast("long")
    found = entropy.symbols_at(places.select("code", F.col("code").cast("string").alias("stream"), "at", window.alias("window")), codes)
    out = entropy.reached(found.select("stream", "at", (F.col("at") + F.col("length")).alias("next"), "code", "symbol"))
    number = F.row_number().over(Window.partitionBy("code").orderBy("at")) - 1
    return out.select("code", number.cast("long").alias("j"), F.col("symbol").cast("long").alias("symbol"))


_add("l10_decoded_symbols", _decoded_symbols, f"""
    WITH {RANKED} SELECT vec_id AS code, CAST(j AS BIGINT) AS j, symbol FROM ranked JOIN (SELECT unnest(range(20)) AS j) ON i = (vec_id * 3 + j * j) % n WHERE vec_id % 5 <> 0""")  # fmt: skip


def _copy_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as tokens: a component is a literal or, if its level is divisible by 3, a copy."""
    rows = carriers.tiles(spark, sf).select(F.col("vec_id").alias("stream"), (F.col("y") * 8 + F.col("x")).alias("seq"), "l")
    copy = (F.col("l") % 3 == 0) & (F.col("seq") > 0)
    rows = rows.select("stream", "seq", "l", F.when(~copy, F.col("l") * 1000 + F.col("seq")).alias("value"), F.when(copy, 1 + F.col("l") % 7).alias("length"))
    rows = entropy.placed(rows.withColumn("distance", F.lit(0)))
    return rows.withColumn("distance", F.when(copy, 1 + (F.col("l") * 5) % F.least(F.col("start"), F.lit(40))))


_add("l11_l13_resolved_copies", lambda s, d: entropy.resolve_copies(_copy_tokens(s, d)).withColumnRenamed("at", "place"), f"""
    WITH RECURSIVE {carriers.TILES}, t AS (SELECT vec_id AS stream, y * 8 + x AS seq, l, l % 3 = 0 AND y * 8 + x > 0 AS copy FROM tiles),
    p AS (SELECT *, CAST(coalesce(sum(CASE WHEN copy THEN 1 + l % 7 ELSE 1 END) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM t),
    x AS (SELECT stream, start + k AS place, CASE WHEN copy THEN start + k - 1 - (l * 5) % least(start, 40) END AS source, CASE WHEN NOT copy THEN l * 1000 + seq END AS value
      FROM (SELECT *, unnest(range(CASE WHEN copy THEN 1 + l % 7 ELSE 1 END)) AS k FROM p)),
    r(stream, place, source, value) AS (SELECT * FROM x UNION ALL SELECT r.stream, r.place, x.source, x.value FROM r JOIN x ON x.stream = r.stream AND x.place = r.source WHERE r.value IS NULL)
    SELECT stream, place, value FROM r WHERE value IS NOT NULL""")  # fmt: skip


def _cached(spark: SparkSession, sf: str) -> DataFrame:
    one = carriers.pictures(spark, sf).select(F.col("vec_id").alias("stream"), F.posexplode("argb").alias("at", "p"))
    p = F.col("p").bitwiseAND(F.lit(0xFFF0F0F0))  # few colours, so that they come again
    rows = one.select("stream", F.col("at").cast("long").alias("at"), F.when(F.col("at") % 3 != 2, p).alias("argb"), (F.col("p") % 16).cast("int").alias("slot"))
    return entropy.resolve_cache(rows, 4)


_add("l14_cache_lookups", _cached, f"""
    WITH {carriers.PICTURES}, t AS (SELECT vec_id AS stream, y * 8 + x AS at, p & 4293980400 AS argb, (y * 8 + x) % 3 = 2 AS ref, p % 16 AS asked FROM pictures),
    s AS (SELECT *, CASE WHEN ref THEN asked ELSE ((506832829::HUGEINT * argb) % 4294967296) // 268435456 END AS slot FROM t),
    last AS (SELECT a.stream, a.at, max(b.at) AS seen FROM s a JOIN s b ON b.stream = a.stream AND NOT b.ref AND b.slot = a.slot AND b.at < a.at WHERE a.ref GROUP BY ALL)
    SELECT s.stream, s.at, CAST(CASE WHEN NOT s.ref THEN s.argb ELSE coalesce(b.argb, 0) END AS BIGINT) AS argb FROM s LEFT JOIN last l ON l.stream = s.stream AND l.at = s.at LEFT JOIN s b ON b.stream = s.stream AND b.at = l.seen""")  # fmt: skip


def _on_screen(spark: SparkSession, sf: str) -> DataFrame:
    frames = carriers.timeline(spark, sf)
    moments = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("user_id").alias("image_id"), (F.col("event_id") * 7919 % 50_000 - 500).alias("at_ms"))
    loops = frames.select("image_id", (F.col("image_id") % 3).alias("loop_count")).distinct()
    return animation.on_screen(frames, moments, loops).select("event_id", "image_id", "frame_no")


_add("g03_on_screen", _on_screen, f"""
    WITH {carriers.TIMELINE}, f AS (SELECT image_id, frame_no, CAST(sum(greatest(1, duration_ms)) OVER (PARTITION BY image_id ORDER BY frame_no) AS BIGINT) AS stop, greatest(1, duration_ms) AS ms FROM timeline),
    t AS (SELECT image_id, max(stop) AS total, arg_max(frame_no, stop) AS final FROM f GROUP BY image_id),
    m AS (SELECT event_id, user_id AS image_id, event_id * 7919 % 50000 - 500 AS moment, total, final, user_id % 3 AS loops FROM events JOIN t ON t.image_id = user_id)
    SELECT event_id, m.image_id, CASE WHEN loops > 0 AND moment >= total * loops THEN final ELSE f.frame_no END AS frame_no
    FROM m LEFT JOIN f ON moment >= 0 AND f.image_id = m.image_id AND moment % total >= f.stop - f.ms AND moment % total < f.stop AND NOT (loops > 0 AND moment >= total * loops)""")  # fmt: skip


def _sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct colours and the median of green of fifty images, merged from summaries by image and window, each held
    against the exact values by the bounds that sketches states."""
    p = F.col("p")
    rows = carriers.pixel_pairs(spark, sf).select((F.col("l_orderkey") % 50).alias("image_id"), "l_linenumber", px.signed(p).cast("int").alias("argb"), *[f(p).cast("int").alias(n) for n, f in zip("argb", (px.alpha, px.red, px.green, px.blue), strict=True)])
    whole = sketches.merged(sketches.sketched(rows, "image_id", "l_linenumber"), "image_id")
    found = whole.select("image_id", sketches.distinct_colours().alias("found"), sketches.quantile("g", 0.5).alias("median"))
    exact = rows.join(found, "image_id").groupBy("image_id").agg(
        F.count("*").alias("n"), F.countDistinct("argb").alias("colours"), F.first("found").alias("found"), F.count_if(F.col("g") < F.col("median")).alias("below"), F.count_if(F.col("g") <= F.col("median")).alias("upto")
    )
    near = F.abs(F.col("found") - F.col("colours")) <= F.col("colours") * sketches.COLOUR_ERROR + 1
    middle = (F.col("below") <= F.col("n") * (0.5 + sketches.RANK_ERROR)) & (F.col("upto") >= F.col("n") * (0.5 - sketches.RANK_ERROR))
    return exact.select("image_id", "n", "colours", near.alias("colours_within"), middle.alias("median_within"))


_add("sketches_merged", _sketched, f"WITH {carriers.PAIRS} SELECT l_orderkey % 50 AS image_id, count(*) AS n, count(DISTINCT p) AS colours, true AS colours_within, true AS median_within FROM pairs GROUP BY ALL")


def _text_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers and codes read from the bytes of every text, at places that some texts don't reach."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"), (F.col("doc_id") % 200 * 11).cast("int").alias("at"))
    le = lambda n, signed=False: images.little_endian(F.col("b"), F.col("at"), n, signed)
    return rows.select("doc_id", le(1).alias("u8"), le(2).alias("u16"), le(3).alias("u24"), le(4).alias("u32"), le(2, True).alias("i16"), F.hex(F.encode(images.fourcc(F.col("b"), 7), "ISO-8859-1")).alias("code"))


_BYTE = "CAST('0x' || substr(h, 2 * (start + {k}) + 1, 2) AS BIGINT)"
_NUMBER = lambda n: f"CASE WHEN len(h) >= 2 * (start + {n}) THEN {' + '.join(f'{_BYTE.format(k=k)} * {256 ** k}' for k in range(n))} END"
_add("s07_s09_text_numbers", _text_numbers, f"""
    WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, doc_id % 200 * 11 AS start FROM documents)
    SELECT doc_id, {_NUMBER(1)} AS u8, {_NUMBER(2)} AS u16, {_NUMBER(3)} AS u24, {_NUMBER(4)} AS u32,
      CASE WHEN {_NUMBER(2)} > 32767 THEN {_NUMBER(2)} - 65536 ELSE {_NUMBER(2)} END AS i16, substr(h, 15, 8) AS code FROM b""")  # fmt: skip
