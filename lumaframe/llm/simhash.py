"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are cut into partitions of correlated bits. If the thresholds of m partitions sum to
tau - m + 1 (a threshold of -1 leaves a partition out), two fingerprints within tau bits agree within the
threshold in at least one of them; dynamic programming picks the thresholds with the least estimated work.
Fingerprints that share a probed value are compared in full. Buckets with too many pairs are cut once
more by slices of the other bits; what is still crowded goes another exact way: two fingerprints are within tau bits just if their balls of radius tau/2 meet, and a point has only a
bounded number of fingerprints around it.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, connected_components, forget, release, staged, table

SEED = 42
#: A bucket of more ordered pairs than this goes by balls; only speed depends on it.
BUCKET_PAIRS = 4096
#: SQL can't write the least long as one literal.
LEAST_LONG = ("-9223372036854775808L", "(-9223372036854775807L - 1L)")
#: Fingerprints from which correlations and candidate counts are estimated; only speed depends on it.
SAMPLE = 4096
#: Min-hash bands (of ROWS values each) that propose pairs for a similarity of 0.8 or more.
BANDS, ROWS = 12, 5
#: A shingle's entries are dealt out so that a share compares about so many; only speed depends on it.
BUCKET_WORK = 1 << 20


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; of the whole sequence if it is shorter."""
    w = (text or b"").translate(ASCII_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    line = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(w)) - 1
    digest = xxhash.xxh64_intdigest
    cut = zip(starts[: len(w) - k].tolist(), ends[k:].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], SEED) for a, b in cut), np.uint64, len(w) - k)


def simhash(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; as a signed 64-bit number."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(size: int):
    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(shingle_hashes(t, size)) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return of


def grouped_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """Cut the bit positions into m partitions of nearly equal width, correlated bits together."""
    n = bits.shape[1]
    x = bits - bits.mean(0)
    norm = np.sqrt((x * x).sum(0))
    alike = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9)
    free, parts = list(range(n)), []
    for k in range(m):
        width = len(free) // (m - k)
        part = [max(free, key=lambda b: (alike[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < width:
            part.append(max(free, key=lambda b: (alike[b, part].mean(), -b)))
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def allocation(bits: np.ndarray, n: int, tau: int, choices=(2, 3, 4)) -> list[tuple[list[int], int]]:
    """(bit positions, threshold) of the partitions to probe, by dynamic programming on the work
    (probes and candidates of a fingerprint among n) that the sampled fingerprints suggest."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    some = bits[: min(len(bits), 256)]
    for m in choices:
        parts, total = grouped_bits(bits, m), tau - m + 1
        work = []
        for part in parts:
            apart = (some[:, None, part] != bits[None, :, part]).sum(2)
            pairs = max(1, apart.size - len(some))
            cost = {-1: 0.0}
            for t in range(tau + 1):
                probes = sum(comb(len(part), i) for i in range(t + 1))
                near = max(((apart <= t).sum() - len(some)) / pairs, probes / 2.0 ** len(part))
                cost[t] = 4.0 * probes + n * near
            work.append(cost)
        # least[s]: the least work so far with thresholds that sum to s
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in work:
            after: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in least.items():
                for t, more in cost.items():
                    if s + t not in after or c + more < after[s + t][0]:
                        after[s + t] = (c + more, [*chosen, t])
            least = after
        if total in least and (best is None or least[total][0] < best[0]):
            best = (least[total][0], [(p, t) for p, t in zip(parts, least[total][1], strict=True) if t >= 0])
    assert best is not None
    return best[1]


def _signed(bits) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >> 63 else v


def links(fps: DataFrame, tau: int = 2, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """fps: distinct fingerprints (fp long). (u, v) pairs within tau bits, such that all fingerprints within
    tau bits of one another are connected through them."""
    if tau % 2:
        raise ValueError("tau must be even")
    sample = [r.fp for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    if len(sample) < 2:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    bits = np.unpackbits(np.array(sample, np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    plan = allocation(bits.astype(np.float32), fps.count(), tau)
    probes = [
        (k, _signed(part), _signed(flip))
        for k, (part, t) in enumerate(plan)
        for i in range(t + 1)
        for flip in combinations(part, i)
    ]
    array = ", ".join(f"struct({k} as part, {mask}L as mask, {flip}L as flip)" for k, mask, flip in probes).replace(*LEAST_LONG)
    entries = fps.select("fp", F.explode(F.expr(f"array({array})")).alias("p")).select(
        F.col("p.part").alias("part"), F.expr("(fp & p.mask) ^ p.flip").alias("value"), "fp", F.expr("p.flip = 0").alias("own")
    )
    stats = entries.groupBy("part", "value").agg(F.count_if("own").alias("own_n"), F.count("*").alias("n"))
    stats = staged(stats.where("own_n > 0 and n > 1"), "buckets")
    few = F.col("own_n") * F.col("n") <= bucket_pairs
    cold = entries.join(stats.where(few).select("part", "value"), ["part", "value"])
    a = cold.where("own").select("part", "value", F.col("fp").alias("u"))
    b = cold.select("part", "value", F.col("fp").alias("v"))
    near = a.join(b, ["part", "value"]).where(f"u <> v and bit_count(u ^ v) <= {tau}").select("u", "v")

    # crowded buckets are cut once more: within tau bits in the rest, one of tau + 1 slices of it agrees
    crowded = entries.join(stats.where(~few).select("part", "value"), ["part", "value"])
    masks = []
    for k, (part, _) in enumerate(plan):
        rest = [bit for bit in range(64) if bit not in part]
        masks += [(k, _signed(rest[i :: tau + 1])) for i in range(tau + 1)]
    slices = ", ".join(f"struct({k} as k, {mask}L as mask)" for k, mask in masks).replace(*LEAST_LONG)
    crowded = crowded.select("part", "value", "fp", "own", F.explode(F.expr(f"filter(array({slices}), s -> s.k = part)")).alias("s"))
    crowded = crowded.select("part", "value", "fp", "own", F.col("s.mask").alias("mask"), F.expr("fp & s.mask").alias("rest"))
    bucket = ["part", "value", "mask", "rest"]
    crowds = staged(crowded.groupBy(*bucket).agg(F.count_if("own").alias("own_n"), F.count("*").alias("n")).where("own_n > 0 and n > 1"), "crowds")
    cold = crowded.join(crowds.where(few).select(*bucket), bucket)
    a, b = cold.where("own").select(*bucket, F.col("fp").alias("u")), cold.select(*bucket, F.col("fp").alias("v"))
    near = near.union(a.join(b, bucket).where(f"u <> v and bit_count(u ^ v) <= {tau}").select("u", "v"))

    hot = crowded.join(crowds.where(~few).select(*bucket), bucket).select("fp").distinct()
    flips = ", ".join(f"{_signed(f)}L" for i in range(tau // 2 + 1) for f in combinations(range(64), i)).replace(*LEAST_LONG)
    balls = hot.select("fp", F.explode(F.expr(f"array({flips})")).alias("flip")).select("fp", F.expr("fp ^ flip").alias("point"))
    middle = balls.groupBy("point").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    met = balls.join(middle.select("point", "v"), "point").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return near.union(met).distinct()


def fingerprint_components(docs: DataFrame, size: int = 3, tau: int = 2) -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest doc_id that is reachable over links of at most
    tau bits between fingerprints of the word shingles of `size` words.

    Null and empty texts have fingerprint 0, linked like any other; repeated rows come back as often as they
    are given; null ids take part and are never the smallest (null if a component has no other)."""
    own = staged(docs.select("doc_id", fingerprint(size)("text").alias("fp")), "fingerprints")
    fps = staged(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    of = connected_components(links(fps.select("fp"), tau))
    known = fps.join(of, fps.fp == of.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    low = known.groupBy("component").agg(F.min("low").alias("component_id"))
    named = staged(known.select("fp", "component").join(staged(low, "lows"), "component").select("fp", "component_id"), "named")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = fingerprint_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sketch(size: int):
    """SimHash, a 128-bit hash of the words, and the min-hash bands, of the word shingles."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    kind = pa.struct({"fp": pa.int64(), "same": pa.binary(), "bands": pa.list_(pa.int64())})

    @F.arrow_udf("struct<fp:bigint, same:binary, bands:array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.cast(pa.binary()).to_pylist():
            h = shingle_hashes(t, size)
            low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(h), 4096):
                low = np.minimum(low, ((h[at : at + 4096, None] * a + b) >> np.uint64(20)).min(0))
            bands = [xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(low.reshape(BANDS, ROWS))]
            words = b" ".join((t or b"").translate(ASCII_LOWER).split())
            out.append({"fp": simhash(h), "same": xxhash.xxh3_128_digest(words), "bands": np.array(bands, np.uint64).view(np.int64).tolist()})
        return pa.array(out, kind)

    return of


def _alike(size: int, similarity: float):
    @F.arrow_udf("boolean")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left.cast(pa.binary()).to_pylist(), right.cast(pa.binary()).to_pylist(), strict=True):
            p, q = np.unique(shingle_hashes(x, size)), np.unique(shingle_hashes(y, size))
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= similarity * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    return of


def proposed_pairs(first: DataFrame, tau: int) -> DataFrame:
    """first: uid, fp, bands of each class. (u, v) of likely near-duplicates, a few for each class."""
    dealt = first.select("uid", F.posexplode("bands").alias("band", "value"))
    picks = [F.min_by("uid", F.xxhash64("uid", F.lit(k))).alias(f"p{k}") for k in range(3)]
    buckets = dealt.groupBy("band", "value").agg(F.count("*").alias("n"), *picks).where("n > 1")
    buckets = staged(buckets.select("band", "value", F.array_distinct(F.array("p0", "p1", "p2")).alias("picks")), "buckets")
    proposed = dealt.join(buckets, ["band", "value"]).select("uid", F.explode("picks").alias("pick"))

    fps = staged(first.groupBy("fp").agg(F.min("uid").alias("low")), "distinct")
    near = links(fps.select("fp"), tau)
    u, v = fps.select(F.col("fp").alias("u"), F.col("low").alias("uid")), fps.select(F.col("fp").alias("v"), F.col("low").alias("pick"))
    proposed = proposed.union(near.join(u, "u").join(v, "v").select("uid", "pick"))
    proposed = proposed.union(first.select("uid", "fp").join(fps.select("fp", F.col("low").alias("pick")), "fp").select("uid", "pick"))
    return _ordered(proposed)


def _confirmed(rows: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of uids whose sets of word shingles are as similar as that; texts are in row.text."""
    needed = staged(pairs.select("u").union(pairs.select("v")).distinct().toDF("uid"), "needed")
    texts = staged(rows.select("uid", F.col("row.text").alias("text")).join(needed.hint("merge"), "uid", "left_semi"), "texts")
    release(rows.sparkSession)
    wide = pairs.join(texts.toDF("v", "right").hint("merge"), "v").join(texts.toDF("u", "left").hint("merge"), "u")
    edges = staged(wide.where(_alike(size, similarity)("left", "right")).select("u", "v"), "similar")
    forget(texts)
    forget(needed)
    release(rows.sparkSession)
    return edges


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("uid <> pick").select(F.greatest("uid", "pick").alias("u"), F.least("uid", "pick").alias("v")).distinct()


#: Tasks that first add up the counts of one part of the ranges.
SPREAD = 64


def commonness(texts: DataFrame, size: int, bits: int) -> np.ndarray:
    """For each of 2**bits ranges of shingle hashes, about how many texts hold a shingle in it (8 log2, one byte).

    Tasks' counts are added in two levels, as they arrive: SPREAD tasks share a part of the ranges at first, so what one
    task reads grows with a SPREAD-th of the tasks, and it holds one sum a range."""
    part = 1 << min(bits, 13)

    def count(batches):
        n = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                n[shingle_hashes(t, size) >> np.uint64(64 - bits)] += 1
        for at in range(0, len(n), part):
            if n[at : at + part].any():
                yield _sums({at: n[at : at + part].astype(np.int64)})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True):
                sums.setdefault(at, np.zeros(part, np.int64))
                sums[at] += np.frombuffer(x, np.int64)
        yield _sums(sums)

    tasks = texts.select("text").mapInArrow(count, "at int, n binary").withColumn("share", F.spark_partition_id() % SPREAD)
    some = tasks.repartition("at", "share").select("at", "n").mapInArrow(add, "at int, n binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in some.repartition("at").mapInArrow(add, "at int, n binary").collect():
        out[r.at : r.at + part] = np.minimum(255, np.round(8 * np.log2(np.frombuffer(r.n, np.int64) + 1.0))).astype(np.uint8)
    return out


def _sums(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n.tobytes() for n in sums.values()], pa.binary())], ["at", "n"])


def prefixes(size: int, similarity: float, ranks):
    """Number n of distinct shingles and those of them that come first in one order for all texts, rare ones
    first: two texts as similar as that share at least one of these."""

    @F.arrow_udf("struct<n:int, prefix:array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        rank, out = ranks.value, []
        shift = np.uint64(64 - (len(rank).bit_length() - 1))
        for t in texts.cast(pa.binary()).to_pylist():
            h = np.unique(shingle_hashes(t, size))
            keep = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
            first = h[np.argsort(rank[h >> shift], kind="stable")[:keep]]
            out.append({"n": len(h), "prefix": first.view(np.int64).tolist()})
        return pa.array(out, pa.struct({"n": pa.int32(), "prefix": pa.list_(pa.int64())}))

    return of


def prefix_pairs(signed: DataFrame, similarity: float, work: int = BUCKET_WORK) -> DataFrame:
    """signed: uid, component, n, prefix. (u, v) of all pairs of different components that can be as similar
    as that, and no pair whose sizes and places of a shared shingle forbid it.

    At the first shared shingle, at place `at` of n, at most n - at shingles are shared; so the other text has
    at most `reach` shingles. The shorter of two texts thus holds it where reach >= n (own): a shingle that
    nobody holds there, or that one component alone holds, is left out before pairs are made."""
    c = similarity / (1 + similarity)
    entries = signed.select("uid", "component", "n", F.posexplode("prefix").alias("at", "token"))
    entries = entries.select("token", "uid", "component", "n", F.floor((F.col("n") - F.col("at")) / F.lit(c) - F.col("n") + F.lit(1e-6)).alias("reach"))
    own = F.col("reach") >= F.col("n")
    stats = entries.groupBy("token").agg(
        F.count("*").alias("size"), F.count_if(own).alias("own"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    salts = F.least(F.col("own"), F.ceil(F.col("own") * F.col("size") / work)).cast("int")
    stats = staged(stats.where("size > 1 and own > 0 and low <> high").select("token", salts.alias("salts")), "shared")
    release(signed.sparkSession)
    some = staged(entries.join(stats.hint("merge"), "token"), "entries")
    forget(stats)
    release(signed.sparkSession)
    a = some.where(own).select("token", F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int").alias("salt"), F.col("uid").alias("u"), F.col("component").alias("cu"), F.col("n").alias("nu"), F.col("reach").alias("ru"))
    b = some.select("token", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.col("uid").alias("v"), F.col("component").alias("cv"), F.col("n").alias("nv"), F.col("reach").alias("rv"))
    met = a.join(b.hint("merge"), ["token", "salt"]).where("cu <> cv and nv between nu and ru and nu <= rv")
    return _ordered(met.select(F.col("u").alias("uid"), F.col("v").alias("pick")))


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, tau: int = 2) -> DataFrame:
    """Keep one row of each group of near-duplicates, that with the smallest doc_id (null ids last).

    Rows with the same words are one class; groups are the connected components of classes whose sets of word
    shingles have at least that Jaccard similarity. SimHash links within tau bits and three members, picked by
    hash, of each shared min-hash band propose pairs first; this joins large groups with few comparisons and
    may miss pairs. Then every pair of different groups that shares a rare enough shingle (prefix_pairs) is
    compared as well, so none is missed. Joins that carry texts always shuffle, so disk grows in proportion at
    every size. Null and empty texts are one class. Columns stay as they are."""
    spark = docs.sparkSession
    # written once: uid must mean the same row in every job, whatever executors come and go
    rows = staged(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("uid")), "rows")
    sketch = _sketch(size)(F.col("row.text")).alias("s")
    small = staged(rows.select("uid", F.col("row.doc_id").alias("doc_id"), sketch).select("uid", "doc_id", "s.*"), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id"), F.col("uid"))
    first = small.groupBy("same").agg(F.min_by(F.struct("uid", "doc_id", "fp", "bands"), order).alias("x")).select("x.*")
    first = staged(first, "classes")

    proposed = staged(proposed_pairs(first, tau), "pairs")
    edges = _confirmed(rows, proposed, size, similarity)
    forget(proposed)
    forget(small)
    groups = first.select("uid").join(connected_components(edges).toDF("uid", "component").hint("merge"), "uid", "left")
    groups = staged(groups.select("uid", F.coalesce("component", "uid").alias("component")), "groups")

    # only speed depends on the table's size
    bits = min(22, max(12, (4 * first.count()).bit_length()))
    ranks = spark.sparkContext.broadcast(commonness(rows.select("row.text"), size, bits))
    signed = rows.select("uid", prefixes(size, similarity, ranks)("row.text").alias("s")).select("uid", "s.*")
    written = staged(signed, "prefixes")
    signed = staged(written.join(groups.hint("merge"), "uid"), "signed")
    forget(written)
    pairs = staged(prefix_pairs(signed, similarity), "pairs")
    forget(signed)
    confirmed = _confirmed(rows, pairs, size, similarity)
    forget(pairs)
    edges = staged(edges.union(confirmed), "edges")

    of = connected_components(edges)
    grouped = first.join(of, first.uid == of.node).select("uid", "doc_id", "component")
    keep = grouped.groupBy("component").agg(F.min_by("uid", order).alias("uid"))
    lost = staged(grouped.join(keep, "uid", "left_anti").select("uid"), "lost")
    kept = staged(first.select("uid").join(lost, "uid", "left_anti"), "kept")
    release(spark)
    return rows.join(kept.hint("merge"), "uid", "left_semi").select("row.*")
