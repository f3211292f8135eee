"""WARC archives: written as records, read back along verified record boundaries.

Every place where the format's magic stands is a candidate record. Tasks parse each candidate's header
and emit the offset of its successor; pointer jumping from each file's start keeps the candidates that
the chain reaches, so magic inside a payload starts no record. The reader takes any WARC/1.0 or 1.1
archive: a payload is the record's block, less the HTTP head that its content type tells of.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch

MAGIC = "WARC/1.1\r\n"
#: Where a candidate may start; the rest of the version and its line end follow.
MARK = "WARC/1."
CRLF2 = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
URN = "urn:textloom:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Base-32 SHA-1: forty bits, ten hex digits, at a time."""
    digest = F.sha1(data)
    part = lambda i: F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in (1, 11, 21, 31)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", few: int = 200_000) -> None:
    """Writes a record for each row; its payload is the html in UTF-8 (null: empty).

    Of rows with equal payloads of at least `least_bytes` bytes, the one with the largest page_id is the
    response and the others are revisits of it. Only the digests of repeated payloads are joined to the
    rows, broadcast up to `few` of them and shuffled beyond.
    """
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "") if "url" in pages.columns else F.lit("")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html"))
    same = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = Scratch(pages.sparkSession, "payloads").save(same, "same")
    rows = rows.join(F.broadcast(same) if same.count() <= few else same, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit(f"<{URN}"), F.col("first").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.when(revisit, 0).otherwise(F.col("size") + len(HTTP)).cast("string")), F.lit("\r\n"),
    )
    record = F.concat(head, F.when(revisit, "").otherwise(F.concat(F.lit(HTTP), F.col("html"))))
    rows.select(record.alias("value")).write.mode("overwrite").option("lineSep", CRLF2).option("compression", compression).text(path)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, value): what follows each mark, in the order of each file's blocks."""
    raw = spark.read.option("lineSep", MARK).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")


def chain(starts: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping. starts are sorted."""
    n = len(starts)
    at = np.searchsorted(starts, successors)
    jump = np.append(np.where((at < n) & (starts[np.minimum(at, n - 1)] == successors), at, n), n)
    on = np.zeros(n + 1, bool)
    on[: min(n, 1)] = n > 0 and starts[0] == 0
    for _ in range(max(1, n).bit_length()):
        on[jump[on]] = True
        jump = jump[jump]
    return on[:n]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, record_type, page_id, refers_to, header_digest, payload_bytes, payload_digest) of every record.

    One shuffle of offsets and header fields by file. Payloads are digested where they are read; only
    files with a record that holds the magic are read again, and such records put together.
    """
    head = F.substring_index("value", CRLF2, 1)
    field = lambda name, form: F.regexp_extract(F.col("head"), rf"(?im)^{name}:[ \t]*{form}[ \t]*\r?$", 1)
    seg = _scan(spark, path).withColumn("head", F.when(F.col("value").rlike(r"^[01]\r\n") & (F.instr("value", CRLF2) > 0), head))
    seg = seg.withColumn("skip", (F.octet_length("head") + 4).cast("long")).withColumn("length", field("Content-Length", r"(\d{1,18})").try_cast("long"))
    whole = F.octet_length("value") == F.col("skip") + F.col("length") + 4
    block = F.expr("substring(cast(value as binary), int(skip + 1), int(length))")
    spoken = F.substring_index(block.cast("string"), CRLF2, 1)
    seg = seg.withColumn("web", F.coalesce(F.lower(field("Content-Type", r"(\S+)[^\r\n]*")).startswith("application/http"), F.lit(False)))
    seg = seg.withColumn("http", F.when(F.col("web"), F.least(F.octet_length(spoken) + 4, F.col("length"))).otherwise(0).cast("long"))
    body = F.expr("substring(cast(value as binary), int(skip + 1 + http), int(length - http))")
    narrow = seg.select(
        "file", "block", "n", F.octet_length("value").cast("long").alias("bytes"), "skip", "length", "web", "http",
        field("WARC-Type", r"(\S+)").alias("kind"), field("WARC-Record-ID", rf"<{URN}(-?\d*)>").alias("page"), field("WARC-Refers-To", rf"<{URN}(-?\d*)>").alias("refers"),
        field("WARC-Payload-Digest", r"sha1:(\S+)").alias("said"), F.when(whole, base32_sha1(body)).alias("digest"),
    )
    schema = "file string, start long, stop long, web boolean, record_type string, page string, refers string, header_digest string, payload_bytes long, payload_digest string"

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by([("block", "ascending"), ("n", "ascending")])
        size = t["bytes"].to_numpy()
        offset = np.concatenate([[0], np.cumsum(size + len(MARK))])[:-1]  # of what follows the mark
        skip, length = (t[c].fill_null(-1).to_numpy().astype(np.int64) for c in ("skip", "length"))
        ok = (offset > 0) & (skip >= 0) & (length >= 0)
        at = np.flatnonzero(ok)
        starts, stops = offset[at] - len(MARK), offset[at] + skip[at] + length[at] + 4
        at = at[chain(starts, stops)]
        r = t.take(pa.array(at))
        stop = offset[at] + skip[at] + length[at] + 4
        payload = length[at] - r["http"].fill_null(0).to_numpy()
        yield from pa.table({"file": r["file"], "start": pa.array(offset[at] - len(MARK)), "stop": pa.array(stop), "web": r["web"], "record_type": r["kind"], "page": r["page"], "refers": r["refers"], "header_digest": r["said"], "payload_bytes": pa.array(payload), "payload_digest": r["digest"]}).to_batches()

    records = Scratch(spark, "warc").save(narrow.groupBy("file").applyInArrow(lambda t: pa.Table.from_batches(list(follow(t.to_batches())), schema=WANTED), schema), "records")
    broken = records.where("record_type = 'response' and payload_digest is null")
    files = broken.select("file").distinct()
    if files.take(1):
        spans = broken.select("file", "start", "stop", "web")
        bounds = spans.groupBy("file").agg(F.collect_list(F.struct("start", "stop", "web")).alias("spans"))
        again = _scan(spark, path).join(F.broadcast(bounds), "file")  # a row for each file that is read again

        def mend(t: pa.Table) -> pa.Table:
            t = t.sort_by([("block", "ascending"), ("n", "ascending")])
            data = MARK.encode().join(v.encode("utf-8", "surrogatepass") for v in t["value"].to_pylist())
            out = []
            for s in t["spans"][0].as_py():
                block = data[s["start"] : s["stop"] - 4].split(CRLF2.encode(), 1)[1]
                payload = block.partition(CRLF2.encode())[2] if s["web"] else block
                out.append((t["file"][0].as_py(), s["start"], b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)))
            return pa.table({k: [x[i] for x in out] for i, k in enumerate(MENDED.names)}, schema=MENDED)

        mended = again.groupBy("file").applyInArrow(mend, "file string, start long, mended string, mended_bytes long")
        records = records.join(mended, ["file", "start"], "left").withColumns({"payload_digest": F.coalesce("payload_digest", "mended"), "payload_bytes": F.coalesce("mended_bytes", "payload_bytes")}).drop("mended", "mended_bytes")
    return records.select("file", "start", "record_type", F.col("page").try_cast("long").alias("page_id"), F.col("refers").try_cast("long").alias("refers_to"), "header_digest", "payload_bytes", "payload_digest")


MENDED = pa.schema([("file", pa.string()), ("start", pa.int64()), ("mended", pa.string()), ("mended_bytes", pa.int64())])
WANTED = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("web", pa.bool_()), ("record_type", pa.string()), ("page", pa.string()), ("refers", pa.string()), ("header_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row, as read back.

    A revisit takes its size from the response it refers to. Rows that repeat page_id and payload are
    both responses. An empty table gives an empty archive and result.
    """
    spark = pages.sparkSession
    path = f"{Scratch(spark, 'archive').root}/warc"
    write_archive(pages, path, least_bytes)
    records = read_archive(spark, path)
    responses = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    sizes = responses.select(F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("full")).dropDuplicates(["refers_to", "full"])
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(sizes, "refers_to").where("header_digest = full")
    return responses.unionByName(revisits.select("page_id", "payload_bytes", F.col("full").alias("payload_digest"), "record_type", "refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
b AS (SELECT page_id, payload_bytes, translate(array_to_string(list_transform([1, 11, 21, 31], lambda i: lpad(to_base(('0x' || substr(h, i, 10))::BIGINT, 32), 8, '0')), ''),
        '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM d),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""
