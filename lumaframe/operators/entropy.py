"""Steps of the lossless format as relations: canonical codes, copies and the colour cache (L8-L14), without a loop over
symbols or pixels in one task. Positions are rows; what depends on earlier positions is found by windows, within blocks of
positions, and by pointer jumping from block to block."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumaframe.functions import pixels as px
from lumaframe.operators import groups
from lumaframe.sources.files import kept

#: The longest code word, and rounds of pointer jumping: enough for 2**40 steps.
LONGEST, MOST_ROUNDS = 15, 40
#: Places of a stream that a task follows at once.
BLOCK = 1 << 16


def canonical(lengths: DataFrame) -> DataFrame:
    """(code, symbol, length, word, first, end, complete) of the symbols with a length of 1 to 15.

    Words are given by length and then by symbol: a symbol's first place on the line of all 15-bit numbers is the sum of
    the shares of those before it, its word the upper bits of that. complete: the shares of the code fill the line
    exactly, or there is but one symbol, which takes no bits then (length 0). Symbols of a length of 0 or null are not
    in use; a code is bounded by its alphabet."""
    used = lengths.where(F.col("length").between(1, LONGEST)).select("code", "symbol", F.col("length").cast("int").alias("length"))
    share = F.expr(f"shiftleft(1L, {LONGEST} - length)")
    order = Window.partitionBy("code").orderBy("length", "symbol")
    every = Window.partitionBy("code")
    rows = used.select("code", "symbol", "length", share.alias("share"), F.count("*").over(every).alias("n"), F.sum(share).over(every).alias("filled"))
    rows = rows.withColumn("first", F.coalesce(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    one = F.col("n") == 1
    return rows.select(
        "code", "symbol", F.when(one, 0).otherwise(F.col("length")).alias("length"), F.when(one, F.lit(0).cast("long")).otherwise(F.expr(f"shiftright(first, {LONGEST} - length)")).alias("word"),
        F.when(one, F.lit(0).cast("long")).otherwise(F.col("first")).alias("first"), F.when(one, F.lit(1 << LONGEST).cast("long")).otherwise(F.col("first") + F.col("share")).alias("end"),
        (one | (F.col("filled") == 1 << LONGEST)).alias("complete"),
    )


def symbols_at(places: DataFrame, codes: DataFrame) -> DataFrame:
    """Places (code, stream, at, window: the next 15 bits, the first one highest) with `symbol` and `length`: the
    symbol in whose range the window lies, by an as-of window over ranges and places together. Places of codes that
    aren't complete are left out."""
    ranges = codes.where("complete").select("code", F.lit(None).cast("string").alias("stream"), F.lit(None).cast("long").alias("at"), F.col("first").alias("window"), F.struct("symbol", "length").alias("found"))
    asked = places.select("code", F.col("stream").cast("string").alias("stream"), F.col("at").cast("long").alias("at"), F.col("window").cast("long").alias("window"), F.lit(None).cast(ranges.schema["found"].dataType).alias("found"))
    last = Window.partitionBy("code").orderBy("window", F.asc_nulls_first("at")).rowsBetween(Window.unboundedPreceding, 0)
    both = ranges.union(asked).withColumn("found", F.last("found", True).over(last))
    return both.where("at is not null and found is not null").select("code", "stream", "at", "found.symbol", "found.length")


def _places(table: pa.Table, first: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """Of each different place of these blocks: its row (that of a step, if it has one), whether that is a step, whether it
    is marked as entered, where it goes on (-1: not in its block), and the place outside the block that it goes on to (-1:
    none)."""
    at, to, mark = groups.numbers(table, "at"), groups.numbers(table, "next", -1), table.column("entry").to_numpy()
    group = np.repeat(np.arange(len(first)), np.diff([*first, len(at)]))
    key = group * block + at % block
    row = np.flatnonzero(np.diff(key, prepend=-1))
    last = np.r_[row[1:], len(at)] - 1
    key, at, to, step = key[row], at[row], to[row], ~mark[row]
    onward = step & (to > at)
    own = onward & (to // block == at // block)
    wanted = np.where(own, key - at + to, -1)
    found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    return row, step, mark[last] | (at == 0), np.where(own & (key[found] == wanted), found, -1), np.where(onward & ~own, to, -1)


def _ways_through(block: int):
    """Blocks to (stream, at, next): of each place where a block is entered, where it is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in groups.whole_groups(batches, ["stream", "block"], lambda t: np.ones(t.num_rows, np.int64)):
            row, _, entered, onward, out = _places(table, first, block)
            out = out[groups.ends_of(np.where(onward >= 0, onward, np.arange(len(row))))]
            have = entered & (out >= 0)
            rows = table.select(["stream", "at"]).take(pa.array(row[have]))
            yield from rows.append_column("next", pa.array(out[have])).to_batches()

    return run


def _followed(block: int, names: list[str]):
    """Blocks to the steps that are reached from their marked places and from place 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in groups.whole_groups(batches, ["stream", "block"], lambda t: np.ones(t.num_rows, np.int64)):
            row, step, entered, onward, _ = _places(table, first, block)
            seen, onward = bytearray(len(row)), onward.tolist()
            for i in np.flatnonzero(entered).tolist():
                while i >= 0 and not seen[i]:
                    seen[i], i = 1, onward[i]
            yield from table.select(names).take(pa.array(row[step & np.frombuffer(seen, bool)])).to_batches()

    return run


def reached(steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Steps (stream, at, next and more columns; one for a place) without next, of those places that are reached from place
    0 of their stream.

    A stream is cut into blocks of places, each followed within a task; so steps are shuffled once. Only where steps cross
    from block to block do two more things come before: each block tells for the places where it is entered where it is
    left, and these ways, few for a block, are doubled from round to round."""
    names = [c for c in steps.columns if c != "next"]
    rows = kept(steps.where("stream is not null and at >= 0").withColumns({c: F.col(c).cast("long") for c in ("at", "next")}), "steps")
    of = lambda c: F.floor(F.col(c) / block)
    entries = kept(rows.where((F.col("next") > F.col("at")) & (of("next") > of("at"))).select("stream", F.col("next").alias("at")).distinct(), "entries")

    def blocks(marked: DataFrame | None) -> DataFrame:
        every = rows.withColumn("entry", F.lit(False))
        if marked is not None:
            every = every.unionByName(marked.select("stream", "at", F.lit(True).alias("entry")), allowMissingColumns=True)
        return every.withColumn("block", of("at")).repartition("stream", "block").sortWithinPartitions("stream", "block", "at", "entry")

    marked = None
    if not entries.isEmpty():
        ways = blocks(entries).mapInArrow(_ways_through(block), rows.select("stream", "at", "next").schema)
        marked = _doubled(ways)
    return blocks(marked).mapInArrow(_followed(block, names), rows.select(*names).schema)


def _doubled(ways: DataFrame) -> DataFrame:
    """(stream, at) of the places that are reached from place 0, itself included: ways (stream, at, next) are doubled from
    round to round, and each round reaches as many places again. Joins are by (stream, place), and never by a copy of
    one side on every machine."""
    jump = kept(ways.where("next > at"), "jumps")
    have = kept(ways.where("at = 0").select("stream", "at"), "reached")
    for _ in range(MOST_ROUNDS):
        more = have.join(jump.hint("merge"), ["stream", "at"]).select("stream", F.col("next").alias("at"))
        after = kept(have.union(more).distinct(), "reached")
        if after.count() == have.count():
            return have
        have = after
        ahead = jump.select("stream", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = kept(jump.join(ahead.hint("merge"), ["stream", "next"]).select("stream", "at", F.col("far").alias("next")), "jumps")
    raise RuntimeError("a stream of too many symbols")


def placed(tokens: DataFrame) -> DataFrame:
    """Tokens (stream, seq, value, length, distance) with `start`, the place of each token's first pixel: a literal has a
    value and takes one place, a copy takes `length`."""
    before = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.col("value").isNotNull(), F.lit(1)).otherwise(F.col("length")).cast("long")
    return tokens.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")))


def _within_blocks(block: int):
    """Tokens by block, sorted by start, to (stream, at, to, value, done) of the block's places: done with the value of the
    literal that a chain of copies ends at, or with null for a copy of nothing; else `to` is a place of an earlier block."""

    def places_of(table: pa.Table) -> np.ndarray:
        start, low = groups.numbers(table, "start"), groups.numbers(table, "block") * block
        return np.minimum(start + groups.numbers(table, "size"), low + block) - np.maximum(start, low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in groups.whole_groups(batches, ["stream", "block"], places_of):
            n = places_of(table)
            token = np.repeat(np.arange(len(n)), n)
            low = (groups.numbers(table, "block") * block)[token]
            at = np.maximum(groups.numbers(table, "start")[token], low) + np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            literal = table.column("value").is_valid().to_numpy()[token]
            far = groups.numbers(table, "distance")[token]
            wrong = ~literal & ((far < 1) | (far > at))
            base = np.repeat(np.arange(len(first)), np.diff([*first, len(n)]))[token] * block - low
            key, to = base + at, at - far
            inside = ~literal & ~wrong & (to >= low)
            own = np.arange(len(token))
            end = groups.ends_of(np.where(inside, np.searchsorted(key, base + to), own))
            done = (literal | wrong)[end]
            stream = table.column("stream").take(pa.array(token))
            value = table.column("value").take(pa.array(np.where(literal, token, 0)[end], mask=~literal[end]))
            rows = [stream, pa.array(at), pa.array(to[end], mask=done), value, pa.array(done)]
            yield from pa.Table.from_arrays(rows, ["stream", "at", "to", "value", "done"]).combine_chunks().to_batches()

    return run


def resolve_copies(tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """(stream, at, value) of every place of tokens with start, see placed: a stream's places follow each other.

    A place of a copy points `distance` places back, into itself if the copy overlaps; a literal's place is its own end. A
    stream is cut into blocks of places, and within each every pointer is followed to its end or out of the block. Each
    round replaces the pointers that are left by where they point to, so chains through any number of blocks end after
    log2 rounds of one join of the open places by (stream, place); places that are done are not written again. A copy
    from before the stream's start, or of no distance or one below 1, has null."""
    size = F.when(F.col("value").isNotNull(), F.lit(1)).otherwise(F.col("length")).cast("long")
    of = lambda c: F.floor(c / block)
    rows = tokens.where("stream is not null").select("stream", F.col("start").cast("long").alias("start"), size.alias("size"), F.col("distance").cast("long").alias("distance"), "value").where("size > 0")
    rows = rows.withColumn("block", F.explode(F.sequence(of(F.col("start")), of(F.col("start") + F.col("size") - 1))))
    rows = rows.repartition("stream", "block").sortWithinPartitions("stream", "block", "start")
    kind = T.StructType([tokens.schema["stream"], *(T.StructField(c, T.LongType()) for c in ("at", "to")), tokens.schema["value"], T.StructField("done", T.BooleanType())])
    state = kept(rows.mapInArrow(_within_blocks(block), kind), "pointers")
    ended, opened = [state.where("done")], state.where("not done")
    for _ in range(MOST_ROUNDS):
        if opened.isEmpty():
            return reduce(DataFrame.union, ended).select("stream", "at", "value")
        known = reduce(DataFrame.union, [*ended, opened])
        target = known.select("stream", F.col("at").alias("to"), F.col("to").alias("far"), F.col("done").alias("over"), F.col("value").alias("got"))
        more = opened.select("stream", "at", "to").join(target.hint("merge"), ["stream", "to"])
        more = kept(more.select("stream", "at", F.col("far").alias("to"), F.col("got").alias("value"), F.col("over").alias("done")), "pointers")
        ended, opened = [*ended, more.where("done")], more.where("not done")
    raise RuntimeError("a chain of too many copies")


def cache_slot(argb, bits: int):
    """The slot of a pixel in a cache of 2**bits colours."""
    return F.shiftright((F.lit(0x1E35A7BD) * px.wide(argb)).bitwiseAND(F.lit(px.WORD)), 32 - bits).cast("int")


def resolve_cache(places: DataFrame, bits: int) -> DataFrame:
    """(stream, at, argb) of places (stream, at, argb; of a reference: null, and slot): a reference is the last
    earlier pixel of its slot, 0 if there is none. What a reference finds would go into the slot that it came from, so
    references change nothing and need no order among themselves. A window by stream and slot."""
    slot = F.when(F.col("argb").isNotNull(), cache_slot(F.col("argb"), bits)).otherwise(F.col("slot").cast("int"))
    earlier = Window.partitionBy("stream", "own").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    found = F.coalesce("argb", F.last("argb", True).over(earlier), F.lit(0).cast(places.schema["argb"].dataType))
    return places.withColumn("own", slot).select("stream", "at", found.alias("argb"))
