"""Roll-ups, the playback timeline and the status line of animations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(frames: DataFrame) -> DataFrame:
    """Lossy if a frame isn't lossless or carries an alpha chunk; the loop's duration."""
    return frames.groupBy("image_id").agg(
        F.count("*").alias("frame_count"), F.bool_or(~F.col("lossless") | F.col("has_alpha")).alias("lossy"),
        F.when(F.count("*") > 1, F.sum("duration_ms")).otherwise(F.lit(0)).cast("long").alias("loop_duration_ms"),
    )


def segments(frames: DataFrame) -> DataFrame:
    """frames with `segment`, the number of the nearest frame at or before each that needs no earlier one.

    Such is the first; one that covers the canvas and isn't blended; one that covers it, or follows one that does, after
    a frame that is cleared away. frames: image_id, frame_no, x, y, width, height, blend, dispose, source_width,
    source_height; further columns stay. A window by image over its frames in order; an image is one file, which the
    format bounds to 4 GB, and a window without look-ahead holds one row at a time."""
    order = Window.partitionBy("image_id").orderBy("frame_no")
    whole = (F.col("width") == F.col("source_width")) & (F.col("height") == F.col("source_height"))
    cleared = F.lag("dispose").over(order) & (whole | F.lag(whole).over(order))
    anew = F.lag("frame_no").over(order).isNull() | (whole & ~F.col("blend")) | cleared
    rows = frames.withColumn("segment", F.when(anew, F.col("frame_no")))
    return rows.withColumn("segment", F.last("segment", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _shown() -> Column:
    return F.greatest(F.lit(1), F.col("duration_ms"))


def playback(frames: DataFrame) -> DataFrame:
    """A frame starts when those before it have been shown, each for at least 1 ms."""
    before = Window.partitionBy("image_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    return frames.select("image_id", "frame_no", F.coalesce(F.sum(_shown()).over(before), F.lit(0)).cast("long").alias("start_ms"))


def keyframes(frames: DataFrame, loop_count: Column | None = None) -> DataFrame:
    """G3 in full: playback and, for each image, a row without a frame number at the end of the loop; cycles is
    the loop count, null for ever (0)."""
    loops = F.lit(1) if loop_count is None else loop_count
    cycles = F.when(loops > 0, loops).cast("long").alias("cycles")
    ends = frames.groupBy("image_id").agg(F.sum(_shown()).cast("long").alias("start_ms"))
    rows = playback(frames).union(ends.select("image_id", F.lit(None).cast("long").alias("frame_no"), "start_ms"))
    return rows.select("image_id", "frame_no", "start_ms", cycles)


def status(name: Column, load_ms: Column) -> Column:
    """One line about an image row: name, size, frames or still, alpha, coding, time to load."""
    size = F.concat(F.col("source_width"), F.lit("x"), F.col("source_height"))
    loop = F.when(F.col("loop_count") == 0, F.lit("forever")).otherwise(F.col("loop_count").cast("string"))
    moving = F.concat(F.lit("frames="), F.col("frame_count"), F.lit(" | loop="), loop, F.lit(" | duration="), F.col("loop_duration_ms"), F.lit("ms"))
    coding = F.when(F.col("lossy"), F.lit("lossy")).otherwise(F.lit("lossless"))
    parts = [name, size, F.when(F.col("animated"), moving).otherwise(F.lit("still")), F.when(F.col("has_alpha"), F.lit("alpha")), coding, F.concat(F.lit("load="), load_ms, F.lit("ms"))]
    return F.concat_ws(" | ", *parts)


def on_screen(frames: DataFrame, moments: DataFrame, loops: DataFrame | None = None, parts: int = 64) -> DataFrame:
    """moments (image_id, at_ms and further columns) with frame_no: which frame of the image is shown then.

    An animation begins at 0 and each frame is shown for at least 1 ms; it begins again as often as its loop_count says
    (loops: image_id, loop_count; 0 or none: for ever) and then stays at its last frame. Null before 0, for a null time and
    for an image without frames. An image's loop is cut into `parts` stretches of equal length, each frame is in all
    those it reaches into, and the last frame at or before a moment is found by a window over frames and moments of
    one stretch: the moments of a hot image are dealt over its stretches."""
    last = Window.partitionBy("image_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    own = frames.select("image_id", "frame_no", F.sum(_shown()).over(last).cast("long").alias("end"), _shown().cast("long").alias("ms"))
    about = own.groupBy("image_id").agg(F.max("end").alias("total"), F.max_by("frame_no", "end").alias("final"))
    part = lambda at: F.floor(at * parts / F.col("total")).cast("int")
    starts = own.join(about, "image_id").select("image_id", (F.col("end") - F.col("ms")).alias("at"), "end", "total", "frame_no")
    starts = starts.select("image_id", F.explode(F.sequence(part(F.col("at")), part(F.col("end") - 1))).alias("part"), "at", "frame_no")
    asked = moments.join(about, "image_id", "left")
    asked = asked.join(loops.select("image_id", "loop_count"), "image_id", "left") if loops is not None else asked.withColumn("loop_count", F.lit(0))
    over = (F.col("loop_count") > 0) & (F.col("at_ms") >= F.col("total") * F.col("loop_count"))
    phase = F.when(~F.coalesce(over, F.lit(False)) & (F.col("at_ms") >= 0), F.col("at_ms") % F.col("total"))
    row = F.struct(*moments.columns)
    asked = asked.select("image_id", phase.cast("long").alias("at"), "total", F.when(over, F.col("final")).alias("frame_no"), row.alias("row"))
    asked = asked.select("image_id", part(F.col("at")).alias("part"), "at", "frame_no", "row")
    both = starts.withColumn("row", F.lit(None).cast(asked.schema["row"].dataType)).union(asked)
    order = Window.partitionBy("image_id", "part").orderBy("at", F.asc_nulls_first("row")).rowsBetween(Window.unboundedPreceding, 0)
    shown = F.coalesce("frame_no", F.when(F.col("at").isNotNull(), F.last("frame_no", True).over(order)))
    return both.withColumn("frame_no", shown).where("row is not null").select("row.*", "frame_no")
