"""Best-fit-decreasing packing of tokenized documents into sequences of bounded length.

Best-fit decreasing looks only at lengths, and lengths are at most the capacity. So tasks tokenize and
rank the pieces of each length, the driver runs best-fit decreasing over the counts by length (at most
`capacity` numbers, whatever the corpus) and tasks look up where rank k of length l went. Bins with equal
room stand together as a run; a segment tree over remaining capacities finds the tightest open run.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

CAPACITY = 2048
#: Words kept by each half of a worker's cache.
CACHE_WORDS = 300_000
#: A space before a non-space always starts a new word of the byte-level pattern.
CUT = re.compile(r" (?=\S)")
#: A space at which CUT doesn't cut; texts without one are cut at every space.
UNEVEN = re.compile(r" (?:\s|\Z)")
#: Characters of which both libraries surely know the same class.
PLAIN = re.compile(r"[\x00-ɏ]*")
#: A run of white space that tiktoken's pattern may not survive: it looks back from the run's end, on the stack.
LONG_RUN = 20_000
RUN = re.compile(rf"\s{{{LONG_RUN}}}")


def quick(text: str) -> bool:
    """May the text go through tiktoken?"""
    return bool(PLAIN.fullmatch(text)) and not (len(text) >= LONG_RUN and RUN.search(text))


class Words:
    """Token ids as bytes. A plain text goes through tiktoken (the same vocabulary, less than half the time). Of
    any other text, words go through a cache and then one by one through tiktoken or tokenizers: words are those
    of the vocabulary's own pattern or runs of them, so joining their ids gives the ids of the whole text. A text
    that holds a special token's string goes through tokenizers as a whole, which gives that token's id; so do very
    long runs of white space."""

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        if quick(word):
            found = self.quick.encode_ordinary(word)
        else:
            found = self.full.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def _after_space(self, part: str) -> bytes:
        """Of a space and the part, which wasn't in the younger half of the cache."""
        ids = self.old.get(part)
        if ids is None:
            ids = self._ids(" " + part)
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as unsigned little-endian 32-bit numbers."""
        if any(x in text for x in self.special):
            return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if quick(text):
            return np.array(self.quick.encode_ordinary(text), dtype="<u4").tobytes()
        first, *rest = CUT.split(text) if UNEVEN.search(text) else text.split(" ")
        out = list(map(self.young.get, rest))
        if None in out:
            out = [self._after_space(part) if ids is None else ids for part, ids in zip(rest, out, strict=True)]
        return (self._ids(first) if first else b"") + b"".join(out)


_loaded: dict[tuple[str, str, str], Words] = {}


def vocabulary(tokenizer: str, ranks: str, pattern: str) -> Words:
    """One a worker process, kept between tasks."""
    key = (tokenizer, ranks, pattern)
    if key not in _loaded:
        _loaded[key] = Words(*key)
    return _loaded[key]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: full ones, but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


class RoomTree:
    """Segment tree over remaining capacities 0..capacity: which hold an open run of bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.size
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open room of at least `least`."""
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit decreasing over counts[length]. Gives for each length the segments
    (first rank, first sequence, documents a sequence, first offset)."""
    tree, runs, opened, placed = RoomTree(capacity), {}, 0, {}

    def keep(room: int, first: int, bins: int) -> None:
        if bins and room:
            runs.setdefault(room, []).append((first, bins))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        out = placed.setdefault(length, [])
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, opened
                bins = -(-left // (capacity // length))
                opened += bins
            else:
                first, bins = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            each = room // length
            full = min(bins, left // each)
            if full:
                out.append((rank, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                keep(room - each * length, first, full)
            if left and full < bins:
                out.append((rank, first + full, left, capacity - room))
                keep(room - left * length, first + full, 1)
                keep(room, first + full + 1, bins - full - 1)
                left = 0
            elif full < bins:
                keep(room, first + full, bins - full)
    return placed


def _pieces(files: tuple[str, str, str], capacity: int, with_ids: bool):
    def run(batches):
        words, ranks = vocabulary(*files), {}
        for batch in batches:
            rows: list[tuple] = []
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = words.encode(text or "") + b"\0\0\0\0"
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    ranks[length] = ranks.get(length, -1) + 1
                    rows.append((uid, k, start, length, zlib.crc32(own), ranks[length], own if with_ids else None))
            names = ["uid", "piece", "start", "length", "ids_crc32", "rank", "ids"]
            kinds = [batch.schema.field("uid").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def default_vocabulary() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def pack(
    docs: DataFrame, vocab: tuple[str, str, str] | None = None, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and with_ids: ids, the
    piece's unsigned little-endian 32-bit ids).

    vocab: the tokenizer's file, the same vocabulary as ranks, and its pattern. A document is its ids and an
    end, id 0; a null or empty text is the end alone; a special token's string inside a text is that token, as
    the tokenizer has it. Documents of more than capacity tokens are cut; repeated rows and null ids are packed like any
    other row. No piece is dropped and every sequence is filled from 0 without gaps."""
    vocab = vocab or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"uid {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint, ids binary"
    rows = docs.select(F.col("doc_id").alias("uid"), "text").mapInArrow(_pieces(vocab, capacity, with_ids), schema)
    rows = rows.withColumn("part", F.spark_partition_id())
    rows = staged(rows if with_ids else rows.drop("ids"), "pieces")  # ranks must not change with a second run

    here = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    here = here.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = best_fit(counts, capacity)
    plan = rows.sparkSession.sparkContext.broadcast(
        {n: ([s[0] for s in x], np.array([s[1:] for s in x], dtype=np.int64)) for n, x in placed.items()}
    )

    @F.arrow_udf("struct<sequence_id:bigint, offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        lengths, ranks = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        out = np.zeros((2, len(lengths)), dtype=np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            firsts, where = plan.value[int(n)]
            k = np.searchsorted(firsts, ranks[at], side="right") - 1
            steps = ranks[at] - np.asarray(firsts)[k]
            first, each, offset = where[k].T
            out[0, at] = first + steps // each
            out[1, at] = offset + steps % each * n
        return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], ["sequence_id", "offset"])

    out = rows.join(here.drop("n"), ["part", "length"]).withColumn("at", place("length", F.col("rank") + F.col("base")))
    more = ["ids"] if with_ids else []
    return out.select(F.col("uid").alias("doc_id"), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *more)


def op10_pack(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
