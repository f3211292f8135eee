"""Chunks of each source, and the index build that joins them in order.

Static chunks and prefixes are parameters: what a deployment says about itself is not part of the engine.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import VIDEO_ID, first_group, free_text_label, strip
from textloom.operators.chunking import paragraphs, recursive_split, sections
from textloom.scratch import Scratch
from textloom.sources.records import CHUNK, transcript

COLUMNS = ["content", "source", "section", "anchor", "url", "title"]
TEXT = re.compile(rb"\[((?:[^\]\\]|\\.)*)\]\s*TJ|\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|(T\*|(?:Td|TD|Tm)\b)", re.S)
STRING = re.compile(rb"\(((?:[^()\\]|\\.)*)\)|(-?\d+(?:\.\d+)?)", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unescaped(s: bytes) -> str:
    one = lambda m: ESCAPES.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", one, s, flags=re.S).decode("latin-1")


def plain_pdf_pages(data: bytes) -> list[str]:
    """Text of the content streams of a PDF, plain or deflated, with one-byte fonts; a stream that can't be read is skipped."""
    out = []
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[2]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        parts = []
        for t in TEXT.finditer(body):
            if t[3]:
                parts.append("\n")
            elif t[1] is not None:  # numbers under -200 are gaps between words
                parts += [_unescaped(s[1]) if s[1] is not None else " " * (float(s[2]) < -200) for s in STRING.finditer(t[1])]
            else:
                parts.append(_unescaped(t[2]))
        out.append(re.sub(r"\s*\n\s*", "\n", "".join(parts)).strip())
    return out


def pdf_text(content: Column, pages_of: Callable[[bytes], list[str]] = plain_pdf_pages) -> Column:
    """Text of PDF bytes, its pages joined by line breaks; blank pages are skipped, and what isn't a PDF gives "". pages_of may be any extractor."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(data) -> str:
            if data is None or bytes(data[:4]) != b"%PDF":
                return ""
            return "\n".join(p for p in pages_of(bytes(data)) if p.strip())

        for b in batches:
            yield b.map(one)

    return text(content)


def static_chunks(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Chunks that are given as they are, such as where a document can be found; absent fields are null."""
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], CHUNK)


def _pieces(rows: DataFrame, paras: Column, size: int, overlap: int) -> DataFrame:
    """rows with each paragraph's pieces as (para, piece, p)."""
    return rows.withColumn("_p", paras).select("*", F.posexplode("_p").alias("para", "_t")).select("*", F.posexplode(recursive_split(F.col("_t"), size, overlap)).alias("piece", "p")).drop("_p", "_t")


def resume_chunks(resumes: DataFrame, source: str = "resume", size: int = 500, overlap: int = 60) -> DataFrame:
    """(doc_id, ord, chunk columns) of (doc_id, text, url): the sections under title lines, in pieces led by their heading."""
    parts = sections(resumes, "doc_id", "text", "title", "Summary").join(resumes.select("doc_id", "url"), "doc_id")
    rows = parts.select("doc_id", "section_no", "heading", "url", F.posexplode(recursive_split(F.col("body"), size, overlap)).alias("piece", "p"))
    name = lambda x: F.concat(F.lit("Resume — "), x)
    ordered = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "piece")) - 1
    return rows.select("doc_id", ordered.alias("ord"), F.concat("heading", F.lit(": "), "p").alias("content"), F.lit(source).alias("source"), name(F.col("heading")).alias("section"), F.lit(None).cast("string").alias("anchor"), "url", name(free_text_label(F.col("heading"))).alias("title"))


def paper_chunks(papers: DataFrame, source: str = "research_paper", size: int = 400, overlap: int = 80) -> DataFrame:
    """(doc_id, ord, chunk columns) of (doc_id, text, section, anchor, url, title): each paragraph's pieces."""
    rows = _pieces(papers, paragraphs(F.col("text")), size, overlap)
    ordered = F.row_number().over(Window.partitionBy("doc_id").orderBy("para", "piece")) - 1
    return rows.select("doc_id", ordered.alias("ord"), F.col("p").alias("content"), F.lit(source).alias("source"), "section", "anchor", "url", "title")


def _link_chunk(rows: DataFrame, content: Column, title: Column) -> DataFrame:
    return rows.select(content.alias("content"), F.lit("external_link").alias("source"), "section", "anchor", "url", title.alias("title"))


def video_chunks(links: DataFrame, prefix: Column) -> DataFrame:
    """Chunks of (url, label, section, anchor, metadata, segments): one of the metadata if it has a title, and the transcript's pieces.

    metadata and segments are JSON as their services return it; a link without a video id has no transcript.
    """
    m = F.from_json("metadata", "struct<title:string,author_name:string>")
    some = links.withColumn("name", F.coalesce(m["title"], F.lit(""))).withColumn("author", F.coalesce(m["author_name"], F.lit("")))
    said = F.when(first_group(F.col("url"), VIDEO_ID).isNotNull(), transcript(F.col("segments"))).otherwise("")
    shown = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("label"))
    by = F.when(F.col("author") != "", F.concat(F.lit(" by "), "author")).otherwise("")
    about = _link_chunk(some.where("name != ''"), F.concat(prefix, F.lit(' YouTube video: "'), "name", F.lit('"'), by), shown)
    spoken = _pieces(some.withColumn("said", said).where("said != ''"), F.when(F.size(paragraphs(F.col("said"))) > 0, paragraphs(F.col("said"))).otherwise(F.array("said")), 400, 80)
    return about.unionByName(_link_chunk(spoken, F.concat(prefix, F.lit(" "), shown, F.lit(" — transcript: "), "p"), shown))


def drive_chunks(links: DataFrame, prefix: Column, most: int = 10) -> DataFrame:
    """Chunks of (url, label, section, anchor, text): the first `most` paragraphs of a linked document (a feature: documents are excerpted)."""
    rows = _pieces(links.where(strip(F.col("text")) != ""), F.slice(paragraphs(F.col("text")), 1, most), 400, 80)
    return _link_chunk(rows, F.concat(prefix, F.lit(" "), "label", F.lit(": "), "p"), F.col("label"))


def profile_link(links: DataFrame, content: Column, title: str) -> DataFrame:
    """One chunk for each link that is never fetched."""
    return _link_chunk(links, content, F.lit(title))


def assemble(sources: list[DataFrame], order: str = "ord") -> DataFrame:
    """(ord, chunk columns): the sources one after the other, each in its own order, numbered through.

    Each source is read once: its rows are sorted into range partitions and written with their partition and place,
    so a row's offset and place come from the same partitions, and no task sees them all. A null order comes last.
    """
    tagged = [df.select(F.lit(i).alias("s"), (F.col(order) if order in df.columns else F.monotonically_increasing_id()).cast("long").alias("k"), *COLUMNS) for i, df in enumerate(sources)]
    rows = tagged[0]
    for df in tagged[1:]:
        rows = rows.unionByName(df)
    keys = ["s", F.asc_nulls_last("k"), "content"]
    keyed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())  # the partition in the upper bits, the place in the lower 33
    kept = Scratch(rows.sparkSession, "assembly").save(keyed.select("at", *COLUMNS), "sorted").withColumn("part", F.shiftright("at", 33))
    sizes = kept.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return kept.join(F.broadcast(before), "part").select((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("ord"), *COLUMNS)
