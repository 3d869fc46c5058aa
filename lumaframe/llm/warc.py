"""WARC archives written with the text writer, read by boundary-chain verification.

Tasks read splits of the archives, cut at every occurrence of the record magic, and emit each candidate's
offset and that of its successor (from its own header). Pointer jumping from the file's start keeps only the
records that the chain reaches, so magic inside a payload is rejected. Payloads of records that hold such
magic lie in several pieces and are put together in a second read.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import forget, new_path, staged, table

MAGIC = "WARC/1.0\r\n"
#: Ends every record; the writer puts it after each row.
END = "\r\n\r\n"
#: Payloads of at least so many bytes are written once, and again as revisits.
LEAST = 0
RECORDS_PER_FILE = 100_000


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@F.arrow_udf(StringType())
def sha1_base32(texts: pa.Array) -> pa.Array:
    return pa.array([digest(t) for t in texts.cast(pa.binary()).to_pylist()], pa.string())


def write_warc(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """One record per row (page_id, url, html); the payload is html in UTF-8, empty for null.

    Of the rows with equal payloads of at least `least` bytes, that with the largest page_id is a response
    and the others are revisits of it (rows with that same page_id are responses too, null ids are the
    smallest); smaller payloads are all responses. CR and LF in a url become spaces."""
    rows = pages.select("page_id", F.translate(F.coalesce("url", F.lit("")), "\r\n", "  ").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", sha1_base32("html")).withColumn("bytes", F.octet_length("html"))
    kept = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    kept = staged(kept.where("n > 1").select("digest", "first"), "digests")
    rows = rows.join(kept, "digest", "left")
    again = (F.col("bytes") >= least) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    kind = F.when(again, "revisit").otherwise("response")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    urn = "urn:page:"
    body = F.when(again, "").otherwise(F.col("html"))
    head = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <" + urn), page, F.lit(">\r\nWARC-Target-URI: "), "url",
        F.lit("\r\nWARC-Payload-Digest: sha1:"), "digest",
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: <" + urn), F.col("first").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )
    rows.select(head.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    forget(kept)


HEAD = "file string, block bigint, place bigint, size bigint, step bigint, whole boolean, page_id bigint, url string, kind string, refers_to bigint, bytes bigint, digest string, said string"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n"))
    return {k.decode("latin-1").strip().lower(): v.decode("utf-8", "replace").strip() for k, s, v in pairs if s}


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def _candidates(batches):
    """Pieces of a split, in its order, to candidate records. place: offset in the split's own pieces; step:
    the record's length by its header, null if there is none; whole: the piece is all of the record."""
    at: dict[tuple, int] = {}
    for batch in batches:
        out: list[list] = [[] for _ in range(13)]
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        for file, block, piece in zip(files, blocks, batch.column("value").cast(pa.binary()).to_pylist(), strict=True):
            place = at.get((file, block), 0)
            size = len(piece) + len(MAGIC)
            at[file, block] = place + size
            head, gap, body = piece.partition(END.encode())
            f = _fields(head)
            length = f.get("content-length", "")
            step, whole, sha = None, False, None
            if gap and length.isdigit():
                step = len(MAGIC) + len(head) + len(END) + int(length) + len(END)
                whole = step == size
                sha = digest(body[: int(length)]) if whole else None
            row = (file, block, place, size, step, whole, _page(f.get("warc-record-id")), f.get("warc-target-uri"), f.get("warc-type"), _page(f.get("warc-refers-to")), int(length) if step else None, sha, f.get("warc-payload-digest", "").removeprefix("sha1:"))
            for column, x in zip(out, row, strict=True):
                column.append(x)
        kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in HEAD.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every file's text after each magic. The reader drops nothing but the magic; the empty piece before a
    file's first magic is left out."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    read = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return read


def _drop_start(batches):
    """Leave out the empty piece before a file's first magic; later empty pieces stand between two magics."""
    begun: set[str] = set()
    for batch in batches:
        keep = []
        values = batch.column("value").cast(pa.binary()).to_pylist()
        for file, block, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), values, strict=True):
            keep.append(bool(block or len(value) or file in begun))
            begun.add(file)
        yield batch.filter(pa.array(keep, pa.bool_()))


def reachable(found: DataFrame) -> DataFrame:
    """found: (file, at, step). The (file, at) that the chain of steps reaches from each file's offset 0.

    Round k knows all records within 2**k steps of the start and each record's pointer 2**k steps on."""
    every = staged(found.where("step is not null").select("file", "at", (F.col("at") + F.col("step")).alias("to")), "pointers")
    ends = every.select("file", F.col("at").alias("to"))
    jump = staged(every.join(ends, ["file", "to"], "left_semi").select("file", "at", "to"), "pointers")
    forget(every)
    reached = found.where("at = 0").select("file", "at").distinct()
    before, last = -1, None
    while True:
        more = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = staged(reached.union(more).distinct(), "reached")
        if last is not None:
            forget(last)
        last, n = reached, reached.count()
        if n == before:
            forget(jump)
            return reached
        before = n
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        twice = staged(jump.join(far, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "pointers")
        forget(jump)
        jump = twice


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, kind, refers_to, bytes and digest (of the record's own block), said (its digest field),
    one row a record that the chain from the file's start reaches. An empty file or folder gives no rows."""
    pieces = _pieces(spark, path).mapInArrow(_drop_start, "value string, file string, block bigint")
    found = staged(pieces.mapInArrow(_candidates, HEAD), "candidates")
    splits = found.groupBy("file", "block").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    splits = staged(splits, "splits")
    found = found.join(splits, ["file", "block"]).withColumn("at", F.col("base") + F.col("place"))
    records = found.join(reachable(found.select("file", "at", "step")), ["file", "at"]).where("step is not null")
    cut = staged(records.where("not whole").select("file", "at", "step"), "cut")
    whole = records.where("whole").select("page_id", "url", "kind", "refers_to", "bytes", "digest", "said")
    if cut.isEmpty():
        return whole
    # pieces of records that hold the magic: each belongs to the last reached record that starts before it
    starts = found.select("file", "block", "place", "at", "size").join(cut.select("file", "at", "step"), ["file", "at"], "left")
    last = Window.partitionBy("file").orderBy("at")
    owner = F.last(F.when(F.col("step").isNotNull(), F.struct("at", "step")), True).over(last)
    parts = starts.withColumn("own", owner).where("own is not null and at < own.at + own.step")
    parts = staged(parts.select("file", "block", "place", "at", F.col("own.at").alias("owner")), "parts")
    texts = pieces.mapInArrow(_placed, "file string, block bigint, place bigint, value binary").join(parts, ["file", "block", "place"])
    joined = texts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("x"))

    @F.arrow_udf("struct<bytes:bigint, digest:string>")
    def body(lists: pa.Array) -> pa.Array:
        out = []
        for x in lists.to_pylist():
            text = MAGIC.encode().join(p["value"] for p in x)
            head, _, rest = text.partition(END.encode())
            n = int(_fields(head)["content-length"])
            out.append({"bytes": n, "digest": digest(rest[:n])})
        return pa.array(out, pa.struct({"bytes": pa.int64(), "digest": pa.string()}))

    joined = joined.select("file", F.col("owner").alias("at"), body("x").alias("b"))
    more = records.where("not whole").drop("bytes", "digest").join(joined, ["file", "at"])
    return whole.union(more.select("page_id", "url", "kind", "refers_to", "b.bytes", "b.digest", "said"))


def _placed(batches):
    """Pieces with their place in the split, as in _candidates."""
    at: dict[tuple, int] = {}
    for batch in batches:
        files, blocks, values = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
        places = []
        values = batch.column("value").cast(pa.binary()).to_pylist()
        for file, block, piece in zip(files, blocks, values, strict=True):
            places.append(at.get((file, block), 0))
            at[file, block] = places[-1] + len(piece) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(blocks), pa.array(places, pa.int64()), pa.array(values, pa.binary())], ["file", "block", "place", "value"])


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give revisits the payload's size and digest of the response that they refer to."""
    full = records.where("kind = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("said")).agg(F.max("bytes").alias("full"))
    again = records.where("kind = 'revisit'").join(staged(full, "responses"), ["refers_to", "said"], "left")
    return records.where("kind <> 'revisit'").select("page_id", "bytes", "digest", "kind", "refers_to").union(
        again.select("page_id", F.col("full").alias("bytes"), F.col("said").alias("digest"), "kind", "refers_to")
    )


def op2_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    out = resolve_revisits(staged(read_warc(spark, path), "records"))
    return out.select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to",
    )


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP2_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS uid, page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, array_to_string(list_transform(range(32), lambda i: substr('{_DIGITS}',
        1 + (((CAST('0x' || substr(h || '00', 1 + 2 * ((5 * i) // 8), 4) AS BIGINT)) >> (11 - (5 * i) % 8)) & 31), 1)), '') AS b32
      FROM (SELECT DISTINCT h FROM p)),
f AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN d USING (h) JOIN f USING (h)
"""
