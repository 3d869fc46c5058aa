"""Phrases whose words stand together more often than chance would have it, mined by hashing and pruning.

Texts are first turned into blocks of word numbers, each with its own dictionary. Pass k counts a block's phrases of k
words exactly, and hashes those of k + 1 words into buckets that are only counted. Buckets that reach the threshold
become a bitmap; so do the hashes of the phrases of k words that reach it. Pass k + 1 counts a phrase only if its bucket is
set and both its phrases of k words may be frequent. Both bitmaps have a fixed bound and only ever let too much
through: counts are of whole phrases, compared as strings, so nothing hangs on a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, new_path, staged, table

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Lower-case A-Z; every separator becomes a full stop, which no word holds.
CLEAN = bytes(46 if b in SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words that a task holds before it hands on its blocks; bytes of a slice of a text.
BLOCK, SLICE = 2_000_000, 1 << 22
#: Words of which a task keeps a number.
KNOWN_WORDS = 1_000_000
#: Bits of a bitmap, as a power of two: at most 32 MB. Buckets of a range, that are counted together.
LEAST_BITS, MOST_BITS, RANGE = 16, 28, 1 << 16
#: Ranges that a task counts on average.
RANGES = 64
#: A part that very many phrases begin or end with is dealt over so many keys.
SALTS = 8
TOTAL, PHRASE, BUCKET = 0, 1, 2
BLOCKS = "lang string, ids binary, words binary"
COUNTS = "kind int, lang string, phrase string, h bigint, n bigint, counts binary"
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Numbers(dict):
    """Words to numbers from 1; the full stop is 0."""

    def __init__(self):
        super().__init__({b".": 0})
        self.words = [b"."]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def numbered(text: str, numbers: Numbers) -> Iterator[np.ndarray]:
    """The words of a text as numbers, each piece ended by a 0; long texts in slices that end at a separator."""
    data, start = text.encode().translate(CLEAN), 0
    while start < len(data):
        end = data.find(b".", start + SLICE) + 1 or len(data)
        words = data[start:end].replace(b".", b" . ").split()
        yield np.array([*map(numbers.__getitem__, words), 0], np.int32)
        start = end


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def rolled(hashes: np.ndarray, k: int, salt: int) -> np.ndarray:
    """At each place the hash of the phrase of k words that begins there; the last k - 1 places have none."""
    h = mixed(hashes + np.uint64(salt))
    for j in range(1, k):
        h = mixed(h[:-1] * ODD + hashes[j:])
    return h


def is_set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def may_be_frequent(ids: np.ndarray, hashes: np.ndarray, k: int, salt: int, bitmaps) -> np.ndarray:
    """At each place: does a phrase of k words begin there that both bitmaps let through?"""
    word = ids > 0
    if k == 1:
        return word
    buckets, shorter = bitmaps
    inner = is_set(shorter, rolled(hashes, k - 1, salt))
    whole = word[: len(ids) - k + 1].copy()
    for j in range(1, k):
        whole &= word[j : len(ids) - k + 1 + j]
    at = np.flatnonzero(whole & inner[:-1] & inner[1:])
    good = np.zeros(len(whole), bool)
    good[at[is_set(buckets, rolled(hashes, k, salt)[at])]] = True
    return good


def counted(ids: np.ndarray, places: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place, how often) of each phrase of k words that begins at some of the places. Equal hashes are confirmed
    word by word."""
    order = np.argsort(h[places])
    places = places[order]
    same = np.diff(h[places]) == 0
    if any((same & (ids[places[1:] + j] != ids[places[:-1] + j])).any() for j in range(k)):
        grams = np.stack([ids[places + j] for j in range(k)], 1)
        _, first, n = np.unique(grams, axis=0, return_index=True, return_counts=True)
        return places[first], n
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(places)), bool), ~same]))
    return places[first], np.diff(np.append(first, len(places)))


def _blocks(batches):
    """Rows (lang, text) to blocks of one lang: word numbers, 0 after each piece, and the words from 1 on."""

    def out(waiting: dict[str, list], numbers: Numbers) -> pa.RecordBatch:
        ids, words = [], []
        for parts in waiting.values():
            used, own = np.unique(np.concatenate(parts), return_inverse=True)  # 0 is always used and stays 0
            ids.append(own.astype("<i4").tobytes())
            words.append(b".".join([numbers.words[i] for i in used[1:].tolist()]))
        return pa.RecordBatch.from_arrays([pa.array(list(waiting), pa.string()), pa.array(ids, pa.binary()), pa.array(words, pa.binary())], ["lang", "ids", "words"])

    numbers, waiting, held = Numbers(), {}, 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for part in numbered(text, numbers):
                waiting.setdefault(lang, []).append(part)
                held += len(part)
                if held >= BLOCK:
                    yield out(waiting, numbers)
                    waiting, held = {}, 0
                    numbers = numbers if len(numbers) < KNOWN_WORDS else Numbers()
    yield out(waiting, numbers)


def _pass(k: int, least: int, longest: int, bits: int, bitmaps):
    """Blocks to their counts: phrases of k words, buckets of those of k + 1, and in pass 1 all words. The counts of a
    range of buckets are one row; a count above `least` says no more than `least`."""
    wide = "<u1" if least < 256 else "<u8"

    def block(lang: str, ids: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
        salt, own = xxhash.xxh64_intdigest(lang, 42), np.array([0, *(xxhash.xxh64_intdigest(w, 42) for w in words)], np.uint64)[ids]
        enough = len(ids) >= k
        good = may_be_frequent(ids, own, k, salt, bitmaps.value if bitmaps else None) if enough else np.zeros(0, bool)
        rolls = rolled(own, k, salt) if enough else own[:0]
        at, n = counted(ids, np.flatnonzero(good), rolls, k)
        phrases = [b" ".join([words[i - 1] for i in gram]) for gram in np.stack([ids[at + j] for j in range(k)], 1).tolist()]
        rows = [(PHRASE, lang, p, h, c, None) for p, h, c in zip(phrases, rolls[at].astype(np.int64).tolist(), n.tolist(), strict=True)]
        if k < longest and len(good) > 1:
            longer = np.flatnonzero(good[:-1] & good[1:])
            bucket, times = np.unique(rolled(own, k + 1, salt)[longer] & np.uint64((1 << bits) - 1), return_counts=True)
            part, first = np.unique(bucket // np.uint64(RANGE), return_index=True)
            places, times = (bucket % np.uint64(RANGE)).astype("<u2"), np.minimum(times, least).astype(wide)
            for r, a, b in zip(part.tolist(), first.tolist(), np.append(first, len(bucket))[1:].tolist(), strict=True):
                rows.append((BUCKET, None, None, r, b - a, places[a:b].tobytes() + times[a:b].tobytes()))
        if k == 1:
            rows.append((TOTAL, lang, None, 0, int(good.sum()), None))
        kind, of_lang, phrase, h, n, counts = zip(*rows, strict=True) if rows else [()] * 6
        columns = [pa.array(kind, pa.int32()), pa.array(of_lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(counts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "lang", "phrase", "h", "n", "counts"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].as_py()
                yield block(batch.column("lang")[i].as_py(), np.frombuffer(batch.column("ids")[i].as_py(), "<i4"), words.split(b".") if words else [])

    return run


def _frequent_buckets(least: int):
    """Rows (h: a range, n, counts) to (h, bits): which buckets of a range are frequent. Rows are added as they come; a
    task holds one number a bucket of its own ranges."""
    wide = "<u1" if least < 256 else "<u8"

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for h, n, counts in zip(*(batch.column(c).to_pylist() for c in ("h", "n", "counts")), strict=True):
                own = sums.setdefault(h, np.zeros(RANGE, "<u2" if least < 1 << 15 else "<u8"))
                at = np.frombuffer(counts, "<u2", n)
                own[at] = np.minimum(own[at] + np.frombuffer(counts, wide, n, 2 * n).astype(own.dtype), least)
        found = {h: np.packbits(own >= least, bitorder="little").tobytes() for h, own in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["h", "bits"])

    return run


def bucket_bitmap(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bitmap of frequent buckets: at most 2**bits / 8 bytes come to the driver."""
    ranges = max(1, (1 << bits) // RANGE)
    found = rows.select("h", "n", "counts").repartition(-(-ranges // RANGES), "h").mapInArrow(_frequent_buckets(least), "h bigint, bits binary")
    out = np.zeros(ranges * RANGE // 8, np.uint8)
    for h, own in found.collect():
        out[h * RANGE // 8 : (h + 1) * RANGE // 8] = np.frombuffer(own, np.uint8)
    return out[: (1 << bits) // 8]


def phrase_bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """Bits h of the rows set, modulo 2**bits. Words of 64 bits come to the driver: at most 2**bits / 64."""
    at = F.col("h").bitwiseAND((1 << bits) - 1)
    words = rows.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {(1 << bits) - 1}) % 64 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), "<i8")
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint8)


def _kept(df: DataFrame, label: str) -> DataFrame:
    """Staged, more tightly packed than by default."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of each lang: (lang, n), n being all word occurrences, and (lang, k, phrase, f) of every phrase of 1 to
    `longest` words with f >= least, f being all its occurrences within pieces, overlaps included.

    docs: text, lang. A null text is empty, a null lang `und`; repeated rows count each time, other columns are left
    alone. bits: of the bitmaps; by default they grow with the texts' bytes. A saturated bitmap costs time alone."""
    spark = docs.sparkSession
    rows = docs.where("text is not null and text <> ''").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    if bits is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, (size // 64).bit_length()))
    blocks = _kept(rows.mapInArrow(_blocks, BLOCKS), "blocks")
    maps, found, totals = None, [], None
    for k in range(1, longest + 1):
        counts = _kept(blocks.mapInArrow(_pass(k, least, longest, bits, maps), COUNTS), "counts")
        exact = counts.where(F.col("kind") < BUCKET).groupBy("kind", "lang", "phrase", "h").agg(F.sum("n").alias("n"))
        kept = staged(exact.where((F.col("kind") == TOTAL) | (F.col("n") >= least)), f"phrases{k}")
        phrases = kept.where(F.col("kind") == PHRASE)
        found.append(phrases.select("lang", F.lit(k).alias("k"), "phrase", F.col("n").alias("f")))
        if k == 1:
            totals = kept.where(F.col("kind") == TOTAL).select("lang", "n")
        buckets = bucket_bitmap(counts.where(F.col("kind") == BUCKET), least, bits) if k < longest else np.zeros(0)
        forget(counts)
        if not buckets.any():
            break
        maps = spark.sparkContext.broadcast((buckets, phrase_bitmap(phrases, bits)))
    forget(blocks)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return totals, out


def maximal(phrases: DataFrame) -> DataFrame:
    """Phrases of two words and more without those whose words lie inside a longer one that is as frequent. Such a
    phrase lies in one that is longer by a single word and as frequent: f can't rise with length."""
    words = F.split("phrase", " ")
    longer = phrases.where("k > 2").select("lang", "f", words.alias("w"), "k")
    inner = longer.select("lang", "f", F.explode(F.array(F.slice("w", F.lit(1), F.col("k") - 1), F.slice("w", F.lit(2), F.col("k") - 1))).alias("w"))
    most = inner.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("f").alias("longer"))
    return phrases.where("k > 1").join(most, ["lang", "phrase"], "left").where("longer is null or longer < f").drop("longer")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, bits: int | None = None) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score): phrases of two words and more with a = f(phrase) >= least that aren't part
    of a longer, equally frequent one. Of all cuts into a first part (l = f) and a rest (r = f) that with the lowest
    floor(1000 * a * n / (l * r)) counts, the first of equals; arithmetic is of 38 digits. See frequent_phrases."""
    totals, found = frequent_phrases(docs, least, longest, bits)
    words = F.split("phrase", " ")
    own = maximal(found).select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"))
    cuts = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    first, rest = F.slice("w", F.lit(1), F.col("cut")), F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "salt", "cut", F.array_join(first, " ").alias("first"), F.array_join(rest, " ").alias("rest"))
    parts = found.where(F.col("k") < longest).select("lang", "phrase", "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    cuts = cuts.join(parts.toDF("lang", "first", "l", "salt"), ["lang", "first", "salt"]).join(parts.toDF("lang", "rest", "r", "salt"), ["lang", "rest", "salt"])
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.join(totals, "lang").withColumns({"over": wide("a", 17) * 1000 * wide("n", 17), "under": wide("l", 18) * wide("r", 18)})
    best = cuts.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r", "n")).alias("x"))
    return best.select("lang", "phrase", "x.k", "x.a", "x.l", "x.r", "x.n", "x.score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    found = collocations(table(spark, sf_dir, "documents").select("lang", "text"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = found.withColumn("rank", F.row_number().over(order)).where("rank <= 2000")
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS uid, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM t),
c AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM
  (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k)) GROUP BY ALL),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f FROM c WHERE f >= 100),
inner_ AS (SELECT lang, phrase, max(f) AS f FROM
  (SELECT lang, array_to_string(w[1 : k - 1], ' ') AS phrase, f FROM f WHERE k > 2 UNION ALL SELECT lang, array_to_string(w[2 : k], ' '), f FROM f WHERE k > 2) GROUP BY ALL),
own AS (SELECT f.* FROM f LEFT JOIN inner_ USING (lang, phrase) WHERE k > 1 AND (inner_.f IS NULL OR inner_.f < f.f)),
cut AS (SELECT o.lang, o.phrase, o.f AS a, l.f AS l, r.f AS r, n.n, x.cut, (1000::HUGEINT * o.f * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM own o JOIN (SELECT unnest(range(1, 5)) AS cut) x ON x.cut < o.k JOIN n USING (lang)
  JOIN f l ON l.lang = o.lang AND l.phrase = array_to_string(o.w[1 : x.cut], ' ') JOIN f r ON r.lang = o.lang AND r.phrase = array_to_string(o.w[x.cut + 1 : o.k], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
"""
