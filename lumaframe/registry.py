"""Queries over the driver tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.functions import pixels as px
from lumaframe.operators import animation, prediction, scaling
from lumaframe.plans import carriers, file_queries, image_queries

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
SHIFT = {"alpha": 24, "red": 16, "green": 8, "blue": 0}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql:
        _sql[name] = sql


def _pairs(name: str, columns: Callable, sql: dict[str, str]) -> None:
    """A query over pixel pairs; columns makes them from p, q and the red, green and blue of p."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        p, q = F.col("p"), F.col("q")
        own = columns(p, q, px.red(p), px.green(p), px.blue(p))
        return carriers.pixel_pairs(spark, sf).select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in own.items()])

    _add(
        name,
        query,
        f"WITH {carriers.PAIRS} SELECT l_orderkey, l_linenumber, {', '.join(f'CAST({x} AS BIGINT) AS {n}' for n, x in sql.items())} FROM pairs",
    )


def _ch(p: str, channel: str) -> str:
    return f"(({p} >> {SHIFT[channel]}) & 255)"


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0), 255)"


def _int8(x: str) -> str:
    return f"(xor(({x}) & 255, 128) - 128)"


def _packed(f) -> str:
    return " + ".join(f"(({f(c)}) & 255) * {1 << s}" for c, s in SHIFT.items())


def _pixel_queries() -> None:
    _pairs("p01_p07_channels", lambda p, q, r, g, b: {"alpha": px.alpha(p), "red": px.red(p), "green": px.green(p), "blue": px.blue(p), "solid": px.opaque(px.red(p), px.green(p), px.blue(p)), "with_alpha": px.with_alpha(p, px.alpha(q)), "signed": px.signed(p).cast("long")},
           {**{c: _ch("p", c) for c in SHIFT}, "solid": "p % 16777216 + 4278190080", "with_alpha": f"p % 16777216 + {_ch('q', 'alpha')} * 16777216", "signed": "CASE WHEN p > 2147483647 THEN p - 4294967296 ELSE p END"})
    _pairs("p08_p09_add_average", lambda p, q, r, g, b: {"added": px.add(p, q), "average": px.average(p, q)},
           {"added": _packed(lambda c: f"{_ch('p', c)} + {_ch('q', c)}"), "average": _packed(lambda c: f"({_ch('p', c)} + {_ch('q', c)}) // 2")})
    sr, sg, sb = (_ch("p", c) for c in ("red", "green", "blue"))
    _pairs("p10_p14_small_filters", lambda p, q, r, g, b: {"avg2": px.avg2(r, g), "avg3": px.avg3(r, g, b), "full": px.add_subtract_full(r, g, b), "half": px.add_subtract_half(r, g), "delta": px.colour_delta(r, g), "u2s": px.int8(r), "limited": px.clamp_signed(r - g - b)},
           {"avg2": f"({sr} + {sg} + 1) >> 1", "avg3": f"({sr} + 2 * {sg} + {sb} + 2) >> 2", "full": _clamp(f"{sr} + {sg} - {sb}"), "half": _clamp(f"{sr} + ({sr} - {sg}) // 2"), "delta": f"({_int8(sr)} * {_int8(sg)}) >> 5", "u2s": _int8(sr), "limited": f"least(greatest({sr} - {sg} - {sb}, -128), 127)"})
    mul = lambda x, k: f"((({x}) * {k}) >> 8)"
    _pairs("p16_p18_yuv_to_rgb", lambda p, q, r, g, b: {"r": px.yuv_to_r(r, b), "g": px.yuv_to_g(r, g, b), "b": px.yuv_to_b(r, g)},
           {"r": _clamp(f"({mul(sr, 19077)} + {mul(sb, 26149)} - 14234) >> 6"), "g": _clamp(f"({mul(sr, 19077)} - {mul(sg, 6419)} - {mul(sb, 13320)} + 8708) >> 6"), "b": _clamp(f"({mul(sr, 19077)} + {mul(sg, 33050)} - 17685) >> 6")})
    _pairs("p19_fancy_chroma", lambda p, q, r, g, b: {"value": px.fancy_chroma(r, g, b, px.alpha(p))}, {"value": f"(9 * {sr} + 3 * {sg} + 3 * {sb} + {_ch('p', 'alpha')} + 8) >> 4"})
    _pairs("p20_rgb_to_luma", lambda p, q, r, g, b: {"y": px.rgb_to_y(r, g, b)}, {"y": f"((16839 * {sr} + 33059 * {sg} + 6420 * {sb} + 1081344) >> 16) & 255"})
    _add("p15_subsample", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", px.subsample(F.col("p_size").cast("long") * 37, 3).alias("blocks")),
         "SELECT p_partkey, (CAST(p_size AS BIGINT) * 37 + 7) >> 3 AS blocks FROM part")
    _add("p22_opaque", lambda s, d: carriers.pixel_pairs(s, d).groupBy("l_orderkey").agg(F.bool_and(px.alpha(F.col("q")) == 255).alias("is_opaque")),
         f"WITH {carriers.PAIRS} SELECT l_orderkey, bool_and({_ch('q', 'alpha')} = 255) AS is_opaque FROM pairs GROUP BY l_orderkey")
    sa, da = _ch("p", "alpha"), _ch("q", "alpha")
    kept = f"((({da} * (255 - {sa}) + 128) + (({da} * (255 - {sa}) + 128) >> 8)) >> 8)"
    both = f"({sa} + {kept})"
    mixed = lambda c: both if c == "alpha" else f"(({_ch('p', c)} * {sa} + {_ch('q', c)} * {kept}) * (16777216 // greatest({both}, 1))) >> 24"
    _pairs("f08_blend", lambda p, q, r, g, b: {"over": px.blend(p, q)}, {"over": f"CASE WHEN {sa} = 0 THEN q WHEN {sa} = 255 OR {da} = 0 THEN p ELSE {_packed(mixed)} END"})
    _pairs("l31_subtract_green", lambda p, q, r, g, b: {"value": px.pack(px.alpha(p), r + g, g, b + g)},
           {"value": f"{_ch('p', 'alpha')} * 16777216 + (({sr} + {sg}) & 255) * 65536 + {sg} * 256 + (({sb} + {sg}) & 255)"})

    def transformed(p, q, r, g, b) -> dict:
        red = r + px.colour_delta(px.blue(q), g)
        blue = b + px.colour_delta(px.green(q), g) + px.colour_delta(px.red(q), red)
        return {"value": px.pack(px.alpha(p), red, g, blue)}

    sred = f"({sr} + (({_int8(_ch('q', 'blue'))} * {_int8(sg)}) >> 5))"
    sblue = f"({sb} + (({_int8(_ch('q', 'green'))} * {_int8(sg)}) >> 5) + (({_int8(_ch('q', 'red'))} * {_int8(sred)}) >> 5))"
    _pairs("l30_colour_transform", transformed,
           {"value": f"{_ch('p', 'alpha')} * 16777216 + ({sred} & 255) * 65536 + {sg} * 256 + ({sblue} & 255)"})


def _raster_queries() -> None:

    def planes(spark: SparkSession, sf: str) -> DataFrame:
        rows = carriers.pictures(spark, sf, "label")
        return rows.select("vec_id", "label", F.transform("argb", px.red).alias("l"))

    def by_place(rows: DataFrame, values: Column, width: int, name: str, *keys: str) -> DataFrame:
        one = rows.select(*(keys or ["vec_id"]), F.posexplode(values).alias("at", name))
        return one.select(*(keys or ["vec_id"]), (F.col("at") % width).cast("long").alias("tx"), F.floor(F.col("at") / width).alias("ty"), F.col(name).cast("long").alias(name))

    near = "SELECT g.vec_id, tx, ty, l FROM (SELECT vec_id, c % 5 AS tx, c // 5 AS ty FROM (SELECT vec_id, unnest(range(25)) AS c FROM (SELECT DISTINCT vec_id FROM tiles))) g JOIN tiles t ON t.vec_id = g.vec_id AND t.x = least(7, (tx * 8) // 5) AND t.y = least(7, (ty * 8) // 5)"
    shrunk = lambda s, d: by_place(planes(s, d), scaling.nearest("l", 8, 8, 5, 5), 5, "l")
    _add("z03_scale_nearest", shrunk, f"WITH {carriers.TILES} {near}")
    _add("z03_scale_nearest_by_label",
         lambda s, d: by_place(planes(s, d), scaling.nearest("l", 8, 8, 5, 5), 5, "l", "label").groupBy("label").agg(F.sum("l").alias("sum_l"), F.count("*").alias("n")),
         f"WITH {carriers.TILES} SELECT label, CAST(sum(l) AS BIGINT) AS sum_l, count(*) AS n FROM ({near}) JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY label")
    at = lambda a: f"least(7, floor(s{a}))"
    lerp = lambda a, b, t: f"({a} + ({b} - {a}) * {t})"
    value = lerp(lerp("a.l::FLOAT", "b.l::FLOAT", "fx"), lerp("c.l::FLOAT", "e.l::FLOAT", "fx"), "fy")
    _add("z04_scale_bilinear", lambda s, d: by_place(planes(s, d), scaling.bilinear("l", 8, 8, 13, 13), 13, "l"),
         f"""WITH {carriers.TILES},
         g AS (SELECT vec_id, tx, ty, CAST({at('x')} AS BIGINT) AS x0, CAST({at('y')} AS BIGINT) AS y0, CAST(sx - {at('x')} AS FLOAT) AS fx, CAST(sy - {at('y')} AS FLOAT) AS fy
               FROM (SELECT vec_id, c % 13 AS tx, c // 13 AS ty, (c % 13)::FLOAT * (7::FLOAT / 12::FLOAT) AS sx, (c // 13)::FLOAT * (7::FLOAT / 12::FLOAT) AS sy
                     FROM (SELECT vec_id, unnest(range(169)) AS c FROM (SELECT DISTINCT vec_id FROM tiles))))
         SELECT g.vec_id, tx, ty, CAST(floor(CAST({value} AS DOUBLE) + 0.5) AS BIGINT) AS l FROM g
         JOIN tiles a ON a.vec_id = g.vec_id AND a.x = x0 AND a.y = y0 JOIN tiles b ON b.vec_id = g.vec_id AND b.x = least(7, x0 + 1) AND b.y = y0
         JOIN tiles c ON c.vec_id = g.vec_id AND c.x = x0 AND c.y = least(7, y0 + 1) JOIN tiles e ON e.vec_id = g.vec_id AND e.x = least(7, x0 + 1) AND e.y = least(7, y0 + 1)""")  # fmt: skip

    def sizes(spark, sf):
        rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_size") * 13 + 1).alias("w"), (F.col("p_partkey") % 97 + 1).cast("int").alias("h"), (F.col("p_partkey") % 50 - 10).cast("int").alias("tw"), (F.col("p_size") - 8).alias("th"))
        w, h = scaling.target_size("w", "h", "tw", "th", True)
        fw, fh = scaling.target_size("w", "h", "tw", "th", False)
        return rows.select("p_partkey", w.alias("width"), h.alias("height"), fw.alias("free_width"), fh.alias("free_height"))

    dim = lambda x: f"CAST(greatest(1, floor({x} + 0.5)) AS INTEGER)"
    both = "least(tw::DOUBLE / w, th::DOUBLE / h)"
    _add("z01_target_size", sizes,
         f"""WITH d AS (SELECT p_partkey, p_size * 13 + 1 AS w, CAST(p_partkey % 97 + 1 AS INTEGER) AS h, CAST(p_partkey % 50 - 10 AS INTEGER) AS tw, p_size - 8 AS th FROM part)
         SELECT p_partkey,
           CASE WHEN tw > 0 AND th > 0 THEN {dim(f'w * {both}')} WHEN tw > 0 THEN {dim('tw')} WHEN th > 0 THEN {dim('w * (th::DOUBLE / h)')} ELSE w END AS width,
           CASE WHEN tw > 0 AND th > 0 THEN {dim(f'h * {both}')} WHEN tw > 0 THEN {dim('h * (tw::DOUBLE / w)')} WHEN th > 0 THEN {dim('th')} ELSE h END AS height,
           CASE WHEN tw > 0 THEN {dim('tw')} ELSE w END AS free_width, CASE WHEN th > 0 THEN {dim('th')} ELSE h END AS free_height FROM d""")  # fmt: skip

    horizontal = "SELECT a.vec_id, a.x, a.y, CAST((sum(b.l)) % 256 AS BIGINT) AS value FROM tiles a JOIN tiles b ON a.vec_id = b.vec_id AND ((b.y = a.y AND b.x <= a.x) OR (b.x = 0 AND b.y < a.y)) GROUP BY ALL"
    vertical = "SELECT a.vec_id, a.x, a.y, CAST((sum(b.l)) % 256 AS BIGINT) AS value FROM tiles a JOIN tiles b ON a.vec_id = b.vec_id AND ((b.x = a.x AND b.y <= a.y) OR (b.y = 0 AND b.x < a.x)) GROUP BY ALL"
    diagonal = """SELECT a.vec_id, a.x, a.y, CAST(sum(b.l) % 256 AS BIGINT) AS value FROM tiles a JOIN tiles b ON a.vec_id = b.vec_id AND (
        (b.x - b.y = a.x - a.y AND b.x <= a.x) OR (a.x >= a.y AND b.y = 0 AND b.x < a.x - a.y) OR (a.x < a.y AND b.x = 0 AND b.y < a.y - a.x)) GROUP BY ALL"""
    undone = {
        "f04_l17_horizontal": (lambda: prediction.alpha("l", 8, 1), horizontal), "f05_l18_vertical": (lambda: prediction.alpha("l", 8, 2), vertical),
        # as the green of pixels
        "l20_diagonal": (lambda: F.transform(prediction.predicted(F.transform("l", lambda v: v * 256), 8, 4), px.green), diagonal),
    }
    for name, (values, sql) in undone.items():
        _add(name, lambda s, d, v=values: by_place(planes(s, d), v(), 8, "value").withColumnsRenamed({"tx": "x", "ty": "y"}), f"WITH {carriers.TILES} {sql}")
    _add("c12_c13_rollup", lambda s, d: animation.rollup(carriers.timeline(s, d)),
         f"WITH {carriers.TIMELINE} SELECT image_id, count(*) AS frame_count, bool_or(NOT lossless OR has_alpha) AS lossy, CAST(CASE WHEN count(*) > 1 THEN sum(duration_ms) ELSE 0 END AS BIGINT) AS loop_duration_ms FROM timeline GROUP BY image_id")
    _add("g03_timeline", lambda s, d: animation.playback(carriers.timeline(s, d)),
         f"WITH {carriers.TIMELINE} SELECT a.image_id, a.frame_no, CAST(coalesce(sum(CASE WHEN b.frame_no IS NOT NULL THEN greatest(1, b.duration_ms) END), 0) AS BIGINT) AS start_ms FROM timeline a LEFT JOIN timeline b ON a.image_id = b.image_id AND b.frame_no < a.frame_no GROUP BY ALL")


_pixel_queries()
_raster_queries()


def queries() -> dict[str, Query]:
    return _queries | image_queries.QUERIES | file_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return _sql | image_queries.SQL | file_queries.SQL
