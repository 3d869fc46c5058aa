"""Benchmark decontamination by Wu-Manber search over words.

Test items are cut into windows of n consecutive words. For the windows of one length a block shift
table tells, from the two words at the end of the current position, how far the search may jump without
missing a window; where the shift is 0, the bucket of that suffix block and of the block at the window's
start gives the windows to compare word by word. Windows are few and gathered in blocks of bounded size,
each block searched over all texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table

#: Every ASCII byte that is neither a digit nor a letter becomes a space; A-Z are lower-cased.
WORD_BYTES = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)

HITS = "struct<n_words:bigint, spans:array<struct<start:bigint, end:bigint>>, items:array<bigint>>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class WuManber:
    """Finds all windows of m words each. windows: {tuple of words: set of item ids}."""

    def __init__(self, m: int, windows: dict[tuple[bytes, ...], set]):
        self.m, self.block = m, min(2, m)
        self.longest = m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[tuple[bytes, ...], set]]]] = {}
        for window, items in windows.items():
            for end in range(self.block, m + 1):
                block = b" ".join(window[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, self.longest), m - end)
            suffix, prefix = b" ".join(window[-self.block :]), b" ".join(window[: self.block])
            self.buckets.setdefault(suffix, {}).setdefault(prefix, []).append((window, items))

    def search(self, text: list[bytes]):
        """Yield (first word, items) of each occurrence."""
        m, two, longest, shift, n, end = self.m, self.block == 2, self.longest, self.shift, len(text), self.m
        while end <= n:
            block = text[end - 2] + b" " + text[end - 1] if two else text[end - 1]
            jump = shift.get(block, longest)
            if jump:
                end += jump
                continue
            at = end - m
            prefix = text[at] + b" " + text[at + 1] if two else text[at]
            for window, items in self.buckets[block].get(prefix, ()):
                if tuple(text[at:end]) == window:
                    yield at, items
            end += 1


class Windows:
    """Broadcast rows (window, item_id). A worker process builds the tables once and keeps them while it holds
    the broadcast, over batches and tasks."""

    def __init__(self, rows: list[tuple[str, int | None]]):
        self.rows, self.built = rows, None

    def searchers(self) -> list[WuManber]:
        if self.built is None:
            by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
            for window, item in self.rows:
                w = tuple(window.encode().split(b" "))
                by_length.setdefault(len(w), {}).setdefault(w, set()).add(item)
            self.built = [WuManber(m, windows) for m, windows in sorted(by_length.items())]
        return self.built


def _scan(searchers: list[WuManber], texts: pa.Array) -> pa.Array:
    out = []
    for text in texts.cast(pa.binary()).to_pylist():
        w, spans, found = words(text), [], set()
        for searcher in searchers:
            for start, items in searcher.search(w):
                spans.append((start, start + searcher.m))
                found |= items
        out.append({"n_words": len(w), "spans": merged(spans), "items": sorted(found, key=lambda i: (i is None, i or 0))})
    kind = pa.struct({
        "n_words": pa.int64(),
        "spans": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})),
        "items": pa.list_(pa.int64()),
    })
    return pa.array(out, type=kind)


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(window, item_id): the distinct windows of n words of each item; a shorter item is one window.

    Items without a word give none; those with a null id are one item of that id."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.cast(pa.binary()).to_pylist():
            w = words(text)
            out.append([b" ".join(w[i : i + n]).decode() for i in range(max(1, len(w) - n + 1))] if w else [])
        return pa.array(out, type=pa.list_(pa.string()))

    rows = benchmark.select("item_id", cut("text").alias("w"))
    return rows.select(F.explode("w").alias("window"), F.col("item_id").cast("long").alias("item_id")).distinct()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, block_rows: int = 200_000, block_bytes: int = 32_000_000
) -> DataFrame:
    """docs with a column `contamination`: n_words, the merged spans of words (start, end exclusive) inside
    any occurrence of a window, and the ids of the items with an occurring window (a null id last).

    A null or empty text has no words and no hits; repeated rows are each searched; other columns stay as
    they are (a column named contamination is replaced). About block_rows windows and block_bytes bytes are
    gathered and broadcast at once; a larger benchmark is searched in blocks and a row's hits are united."""
    spark = docs.sparkSession
    wins = windows(benchmark, n)
    rows, size = wins.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    blocks = max(1, -(-rows // block_rows), -(-size // block_bytes))
    if blocks > 1:
        blocks += blocks // 4 + 1  # rows are dealt by hash; leaves room for uneven blocks
        wins = staged(wins, "windows")

    def scan(part: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        blob = spark.sparkContext.broadcast(Windows([(r.window, r.item_id) for r in part.select("window", "item_id").toLocalIterator()]))

        @F.arrow_udf(HITS)
        def hits(column: pa.Array) -> pa.Array:
            return _scan(blob.value.searchers(), column)

        return texts.withColumn(name, hits("text"))

    if blocks == 1:
        return scan(wins, docs, "contamination")
    dealt = wins.withColumn("b", F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)))
    # written once: uid must mean the same row in every job, whatever executors come and go
    own = staged(docs.select(F.struct(*[c for c in docs.columns if c != "contamination"]).alias("row"), F.monotonically_increasing_id().alias("uid")), "rows")
    texts = own.select("uid", "row", F.col("row.text").alias("text"))
    found = None
    for b in range(blocks):
        one = scan(dealt.where(F.col("b") == b), texts.select("uid", "text"), "h")
        one = one.where("size(h.items) > 0").select("uid", "h.spans", "h.items")
        found = one if found is None else found.union(one)
    found = found.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    merge = F.arrow_udf(lambda c: pa.array([merged([(x["start"], x["end"]) for x in v or []]) for v in c.to_pylist()], type=c.type), "array<struct<start:bigint, end:bigint>>")
    count = F.arrow_udf(lambda c: pa.array([len(words(t)) for t in c.cast(pa.binary()).to_pylist()], type=pa.int64()), "bigint")
    whole = texts.withColumn("n_words", count("text")).join(found, "uid", "left")
    hit = F.struct("n_words", merge("s").alias("spans"), F.array_sort(F.array_distinct(F.coalesce("i", F.expr("cast(array() as array<bigint>)")))).alias("items"))
    return whole.select("row.*", hit.alias("contamination"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of find_contamination over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("contamination.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("contamination.items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "contamination.n_words", n_hit.alias("n_hit"), F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS win, least(len(w), 10) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
doc_windows AS (
  SELECT uid, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT uid, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM doc_words, (SELECT DISTINCT m FROM item_windows) WHERE len(w) >= m)),
hits AS (SELECT d.uid, d.i, d.m, t.item_id FROM doc_windows d JOIN item_windows t ON d.win = t.win AND d.m = t.m),
covered AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY uid),
items AS (SELECT uid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (uid) LEFT JOIN items USING (uid)
"""
