"""Removal of repeated byte strings by bucket-pointer refinement of suffix buckets.

The suffixes of interest start a string of `length` bytes that also starts elsewhere. They are aligned at
anchors: every string of that length has one q-gram with the smallest hash (the leftmost of equals), chosen
by its content alone, so equal strings have equal q-grams at equal offsets. Neighbouring starts share their
anchor; such a run of starts enters the bucket of its q-gram.

Every offset of a text has a bucket identifier, at first that of its q-gram. Identifiers are refined by those of later
offsets: one for twice as many bytes is made of the one at the offset and the one at the offset where that ends, and
these in turn make the next (Buckets); so no byte is looked at again after the q-grams. Each round cuts the offsets of
a bucket into ranges and refines the bucket: members go on together if the identifiers at the offsets where the bytes
begin and end that all strings of the range hold (its core) are equal too. The bucket's pointer and those identifiers
make the pointer of the refined bucket, by which the next round refines. Buckets of one member end, and so do ranges
whose whole surroundings (hull) occur again. Spark groups by pointer; no bucket is gathered. Identifiers and pointers have
128 bits: strings count as equal if their pointers are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, release, staged, table

LENGTH, Q = 400, 64
#: Words of a passage, and of the strings inside it that are looked up.
PASSAGE, GRAM = 50, 25
#: Offsets in a range of each round.
WIDTHS = (48, 8, 1)
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 17) - 1, base, np.uint64)], dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def gram_hashes(symbols: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram of unsigned 64-bit symbols."""
    n = len(symbols)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * _power(_MULTIPLIER, n), dtype=np.uint64)))
    h = (sums[q:] - sums[:-q]) * _power(_INVERSE, n - q + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def byte_symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)


def anchors(h: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(position, first, last): the leftmost smallest hash of each window of that many hashes, and the first
    and last window that it belongs to."""
    n = len(h) - window + 1
    if n < 1:
        return []
    top = np.iinfo(np.uint64).max
    rows = np.concatenate((h, np.full(-len(h) % window, top, np.uint64))).reshape(-1, window)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    low = np.minimum(after[:n], before[window - 1 : len(h)])
    ends = np.flatnonzero(low[1:] != low[:-1])  # last windows with the same smallest value
    out, first = [], 0
    for last in [*ends.tolist(), n - 1]:
        while first <= last:
            at = first + int(h[first : first + window].argmin())
            out.append((at, first, min(at, last)))
            first = min(at, last) + 1
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Two numbers for each byte, so that the two halves of an identifier have nothing in common.
_BYTES = _mixed(np.arange(1, 513, dtype=np.uint64) * np.uint64(_MULTIPLIER)).reshape(2, 256)


def joined(*parts: np.ndarray) -> np.ndarray:
    """Identifiers or numbers, one after the other, to one identifier of two 64-bit halves (2, n)."""
    out = np.zeros((2, 1), np.uint64)
    for part in parts:
        out = _mixed(out * np.uint64(_MULTIPLIER) + part + np.uint64(1))
    return out


class Buckets:
    """The bucket identifiers of a text's offsets, for strings of q, 2 q, 4 q ... bytes. Those of q-grams come from sums
    over the text; those of a higher level are made where they are asked for."""

    def __init__(self, text: bytes, q: int):
        b, n = np.frombuffer(text, np.uint8), len(text)
        self.q, self.size = q, n
        self.sums = np.zeros((2, n + 1), np.uint64)
        for half in (0, 1):
            np.cumsum(_BYTES[half][b] * _power(_MULTIPLIER, n), dtype=np.uint64, out=self.sums[half, 1:])

    def level(self, k: int, at: np.ndarray) -> np.ndarray:
        """The identifiers of the strings of q << k bytes at these offsets: each made of the one of half as many bytes
        there and the one at the offset where that ends."""
        if k:
            return joined(self.level(k - 1, at), self.level(k - 1, at + (self.q << (k - 1))))
        return joined((self.sums[:, at + self.q] - self.sums[:, at]) * _power(_INVERSE, self.size + 1)[at])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The identifier of each string from first to end, of q bytes at least: by those of its first and its last
        offset of the highest level that it has room for."""
        size = end - first
        out, top = np.zeros((2, len(first)), np.uint64), np.log2(size // self.q).astype(np.int64)
        for k in np.unique(top).tolist():
            at = np.flatnonzero(top == k)
            out[:, at] = joined(self.level(k, first[at]), self.level(k, end[at] - (self.q << k)), size[at].astype(np.uint64))
        return out


def _binary(ids: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Identifiers (2, n) as 16 bytes each."""
    n = ids.shape[1]
    data = pa.py_buffer(np.ascontiguousarray(ids.T).tobytes())
    out = pa.Array.from_buffers(pa.binary(16), n, [None, data]).cast(pa.binary())
    return out if null is None else pc.if_else(pa.array(null), pa.scalar(None, pa.binary()), out)


def _groups(rows, size: int = 1 << 20):
    """Rows (text, ...) in groups of about `size` bytes of text, so that identifiers are made for many at once."""
    group, held = [], 0
    for row in rows:
        group.append(row)
        held += len(row[0])
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def _anchor_rows(length: int, q: int):
    """Rows (uid, text) to runs of starts at an anchor: the identifier of its q-gram's bucket and that of all that
    the run's strings hold."""

    def out(group: list[tuple]) -> pa.RecordBatch:
        buckets, base, runs = Buckets(b"".join(text for text, _ in group), q), 0, []
        for text, u in group:
            at, first, last = np.array(anchors(gram_hashes(byte_symbols(text), q), length - q + 1), np.int64).T
            runs.append((np.full(len(at), u, np.int64), at, first, last, np.full(len(at), base, np.int64)))
            base += len(text)
        uid, at, first, last, base = (np.concatenate(c) for c in zip(*runs, strict=True))
        numbers = [pa.array(c.astype(np.int32)) for c in (at, at - last, at - first)]
        columns = [pa.array(uid), *numbers, _binary(buckets.level(0, base + at)), _binary(buckets.of(base + first, base + last + length))]
        return pa.RecordBatch.from_arrays(columns, ["uid", "pos", "lo", "hi", "gram", "hull"])

    def run(batches):
        for batch in batches:
            texts = zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("uid").to_pylist(), strict=True)
            for group in _groups((t, u) for t, u in texts if t is not None and len(t) >= length):
                yield out(group)

    return run


def _refine(width: int, length: int, q: int):
    """Rows (uid, text, open: runs or ranges with their buckets) to their narrower ranges with the pointers of
    core and hull.

    A range is (a, b), the distances from starts to the anchor, on a grid that all texts share; lo and hi are
    the least and greatest distance in this run. The core of a range lies from a before the anchor to
    length - b after it. The hull of a range that the run fills in part is null, and of one offset core and hull are the
    same."""

    def out(group: list[tuple]) -> pa.RecordBatch | None:
        rows, parents, base = [], [], 0
        for text, u, ranges in group:
            for r in ranges:
                lo, hi = r["lo"], r["hi"]
                for a in range(max(r["a"], lo // width * width), min(r["b"], hi) + 1, width):
                    rows.append((u, r["pos"], lo, hi, a, a + width - 1, r["shown"], base))
                    parents.append(r["bucket"])
            base += len(text)
        if not rows:
            return None
        buckets = Buckets(b"".join(text for text, _, _ in group), q)
        uid, pos, lo, hi, a, b, shown, base = (np.array(c) for c in zip(*rows, strict=True))
        at, parent = base + pos, np.frombuffer(b"".join(parents), np.uint64).reshape(-1, 2).T
        core = joined(parent, a.astype(np.uint64), buckets.of(at - a, at - b + length))
        names = [_binary(core)] * 2
        if width > 1:
            whole = (a >= lo) & (b <= hi)
            hull = np.zeros_like(core)
            hull[:, whole] = joined(core[:, whole], buckets.of((at - b)[whole], (at - a)[whole] + length))
            names[1] = _binary(hull, ~whole)
        columns = [pa.array(uid, pa.int64()), *(pa.array(c.astype(np.int32)) for c in (pos, lo, hi, a, b)), *names, pa.array(shown, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["uid", "pos", "lo", "hi", "a", "b", "core", "hull", "shown"])

    def run(batches):
        for batch in batches:
            rows = zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("uid").to_pylist(), batch.column("open").to_pylist(), strict=True)
            yield from (found for found in map(out, _groups(rows)) if found is not None)

    return run


REFINED = "uid bigint, pos int, lo int, hi int, a int, b int, core binary, hull binary, shown boolean"


def repeated_spans(rows: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """rows: (uid long, unique; text). (uid, start, end) of bytes inside strings of `length` bytes that also
    start at another place; spans of a text may overlap."""
    schema = "uid bigint, pos int, lo int, hi int, gram binary, hull binary"
    found = staged(rows.mapInArrow(_anchor_rows(length, q), schema), "anchors")
    grams = staged(found.groupBy("gram").count().where("count > 1").select("gram"), "grams")
    shared = found.join(grams, "gram")
    hulls = staged(shared.groupBy("hull").agg(F.count("*").alias("n"), F.min(F.struct("uid", "pos")).alias("first")).where("n > 1").drop("n"), "hulls")
    shared = staged(shared.join(hulls, "hull", "left").select("uid", "pos", "lo", "hi", "gram", "first"), "shared")
    for done in (found, grams, hulls):
        forget(done)
    release(rows.sparkSession)

    # runs that occur again as a whole are covered; one of them stays as a partner for the others
    covered = shared.where("first is not null").select("uid", "pos", "lo", "hi")
    known = F.col("first").isNotNull().alias("shown")
    level = shared.where("first is null or (first.uid = uid and first.pos = pos)").select("uid", "pos", "lo", "hi", "gram", known)
    useful = level.groupBy("gram").agg(F.count("*").alias("n"), F.count_if(~F.col("shown")).alias("new")).where("n > 1 and new > 0")
    level = level.join(staged(useful.select("gram"), "useful"), "gram")
    level = level.select("uid", "pos", "lo", "hi", F.lit(0).alias("a"), F.lit(length - q).alias("b"), F.col("gram").alias("bucket"), "shown")
    texts = None
    for width in WIDTHS:
        of_text = level.groupBy("uid").agg(F.collect_list(F.struct("pos", "lo", "hi", "a", "b", "bucket", "shown")).alias("open"))
        if texts is None:
            of_text = staged(of_text, "open")
            texts = staged(rows.join(of_text.select("uid").hint("merge"), "uid", "left_semi").select("uid", "text"), "texts")
            release(rows.sparkSession)
        level = staged(texts.join(of_text.hint("merge"), "uid").mapInArrow(_refine(width, length, q), REFINED), "ranges")
        cores = level.groupBy("core").agg(F.count("*").alias("n"), F.count_if(~F.col("shown")).alias("new")).where("n > 1 and new > 0")
        again = level.join(staged(cores.select("core"), "cores"), "core").withColumnRenamed("core", "bucket")
        if width == 1:
            again = staged(again.where("not shown").select("uid", "pos", F.col("a").alias("lo"), F.col("b").alias("hi")), "found")
            covered = covered.union(again)
            forget(level)
            break
        again = staged(again, "again")
        same = again.where("hull is not null").groupBy("hull").agg(F.count("*").alias("n"), F.min(F.struct("uid", "pos", "a")).alias("first")).where("n > 1")
        before = (level, again)
        again = staged(again.join(staged(same.drop("n"), "same"), "hull", "left").drop("hull"), "buckets")
        for done in before:
            forget(done)
        release(rows.sparkSession)
        covered = covered.union(again.where("first is not null and not shown").select("uid", "pos", "a", "b"))
        level = again.where("first is null or (first.uid = uid and first.pos = pos and first.a = a)")
        level = level.select("uid", "pos", "lo", "hi", "a", "b", "bucket", (F.col("shown") | F.col("first").isNotNull()).alias("shown"))
    forget(texts)
    release(rows.sparkSession)
    return covered.select("uid", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + length).alias("end"))


def _passage_rows(words: int, gram: int):
    """Rows (uid, text) to the hashes of their content-chosen strings of `gram` words: every string of `words`
    words holds one."""

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            uid, found = [], []
            for u, text in zip(batch.column("uid").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                w = text.split() if text else []
                if len(w) < words:
                    continue
                h = gram_hashes(np.fromiter(map(digest, w), np.uint64, len(w)), gram)
                at = np.array([x[0] for x in anchors(h, words - gram + 1)])
                found.append(np.unique(h[at]))
                uid.append(np.full(len(found[-1]), u, np.int64))
            if uid:
                columns = [pa.array(np.concatenate(uid)), pa.array(np.concatenate(found).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "gram"])

    return run


def shared_passages(rows: DataFrame, words: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """rows: (uid long, unique; text). (uid, n) of texts that share passages with other texts: n of the strings of
    `gram` words that are looked up, by 64-bit hashes, occur elsewhere. A passage of at least `words` words (runs
    of anything but white space) in two texts always shows; texts that share less than `gram` words never do."""
    found = staged(rows.mapInArrow(_passage_rows(words, gram), "uid bigint, gram bigint"), "passages")
    shared = found.groupBy("gram").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).where("low <> high").select("gram")
    out = staged(found.join(shared.hint("merge"), "gram").groupBy("uid").agg(F.count("*").alias("n")), "counted")
    forget(found)
    return out


def _merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((max(0, x["start"]), min(size, x["end"])) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """docs with `repeats`: n_bytes, removed (merged spans of UTF-8 bytes, end exclusive), sha256 of the bytes
    that stay, n_passages (see shared_passages; they may be shorter than `length` bytes and are only counted)
    and, with keep_text, those bytes (kept).

    Every byte inside a string of `length` bytes that also starts elsewhere goes, copies in the same text
    and overlapping ones included; strings are judged on the input. Null is empty; texts shorter than length
    stay whole; of repeated rows all are removed; other columns stay as they are."""
    own = [c for c in docs.columns if c != "repeats"]
    # written once: uid must mean the same row in every job, whatever executors come and go
    rows = staged(docs.select(F.struct(*own).alias("row"), F.monotonically_increasing_id().alias("uid")), "rows")
    texts = rows.select("uid", F.col("row.text").alias("text"))
    spans = repeated_spans(texts, length).distinct().select("uid", F.struct("start", "end").alias("s"), F.lit(None).cast("long").alias("n"))
    passages = shared_passages(texts).select("uid", F.lit(None).cast("struct<start:int, end:int>").alias("s"), "n")
    spans = spans.union(passages).groupBy("uid").agg(F.collect_list("s").alias("spans"), F.sum("n").alias("n"))
    kind = {"n_bytes": pa.int64(), "removed": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})), "sha256": pa.string()}
    spark_kind = "n_bytes:bigint, removed:array<struct<start:bigint, end:bigint>>, sha256:string"
    if keep_text:
        kind["kept"], spark_kind = pa.binary(), spark_kind + ", kept:binary"

    @F.arrow_udf(f"struct<{spark_kind}>")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.cast(pa.binary()).to_pylist(), found.to_pylist(), strict=True):
            text = text or b""
            gone = _merged(spans, len(text))
            kept = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)], strict=True))
            row = {"n_bytes": len(text), "removed": [{"start": s, "end": e} for s, e in gone], "sha256": hashlib.sha256(kept).hexdigest()}
            out.append(row | {"kept": kept} if keep_text else row)
        return pa.array(out, pa.struct(kind))

    out = rows.join(spans.hint("merge"), "uid", "left").withColumn("repeats", cut("row.text", "spans"))
    return out.select("row.*", F.col("repeats").withField("n_passages", F.coalesce("n", F.lit(0).cast("long"))).alias("repeats"))


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    removed = F.aggregate("repeats.removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id", "repeats.n_bytes", removed.alias("n_removed"), F.size("repeats.removed").cast("long").alias("n_spans"),
        F.col("repeats.sha256").alias("kept_sha256"), "repeats.n_passages",
    )
