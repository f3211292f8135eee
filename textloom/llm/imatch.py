"""I-Match fingerprints: hashes of the sorted distinct terms of medium document frequency.

Each of 64 randomised lexicons holds a term with a fixed chance (a half down to one in 1024). A text's
fingerprint has one short hash for each lexicon, over those of its terms in the band that the lexicon
holds. Two fingerprints are alike in the share of equal hashes among lexicons that hold a term of either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import let, texts

#: A lexicon holds a term with the chance 2^-rate; eight lexicons for each rate.
RATES = np.repeat([1, 3, 5, 6, 7, 8, 9, 10], 8)
#: So many term hashes (32 MB) a task holds before it counts them.
BUFFER = 1 << 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def terms(text: str) -> np.ndarray:
    """Sorted distinct term hashes: lower-cased words between ASCII white space, without outer punctuation."""
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(w) for w in {w.strip(b".,;:!?\"'()*#%&$|") for w in text.lower().encode("utf-8", "surrogatepass").split()}), np.uint64))


def fingerprint(t: np.ndarray, band: np.ndarray) -> np.ndarray:
    """A 16-bit hash for each lexicon; 0 where it holds no term. A text without terms in the band uses all."""
    kept = t[in_band(t, band)]
    kept = kept if len(kept) else t
    out = np.zeros(len(RATES), np.uint16)
    if not len(kept):
        return out
    salt = (np.arange(1, len(RATES) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None]
    draw = (kept[None, :] ^ salt) * MIX
    draw = (draw ^ (draw >> np.uint64(31))) * MIX
    inside = (draw >> np.uint64(44)) < (1 << (20 - RATES)).astype(np.uint64)[:, None]
    for i in np.flatnonzero(inside.any(1)):
        out[i] = xxhash.xxh32_intdigest(kept[inside[i]].tobytes()) % 65535 + 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a > 0) | (b > 0)
    return float((a == b)[used].mean()) if used.any() else 1.0


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): in how many rows each 64-bit term hash (as a signed long) occurs; counts are merged for BUFFER terms first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            found, df = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 100_000].view(np.int64)), pa.array(df[i : i + 100_000])], ["term", "df"])

        for b in batches:
            for t in b.column(1):
                held.append(terms(t.as_py()))
                n += len(held[-1])
                if n >= BUFFER:
                    yield from counted()
                    held, n = [], 0
        if n:
            yield from counted()

    return texts(docs).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def band_of(docs: DataFrame, rarest: float, commonest: float) -> np.ndarray:
    """The sorted hashes of the terms that at least max(2, rarest * rows) and at most commonest * rows of the rows hold.

    The band lies between two inverse document frequencies, log(1 / commonest) and log(1 / rarest). Each
    term in it is in rarest * rows rows at least, so with m distinct terms a row on average the band has
    at most m / rarest terms, however many rows there are: 8 bytes for each.
    """
    n = docs.count()
    least = max(2.0, rarest * n)
    chosen = document_frequencies(docs).where(F.col("df").between(least, max(commonest * n, least))).select("term").toArrow()
    return np.sort(chosen.column("term").to_numpy().view(np.uint64))


def in_band(t: np.ndarray, band: np.ndarray) -> np.ndarray:
    if not len(band):
        return np.zeros(len(t), bool)
    return band[np.minimum(np.searchsorted(band, t), len(band) - 1)] == t


def _place(edges: Column, n: int, x: Column) -> Column:
    """How many of the n sorted edges are at most x, by halving; 0 for null."""
    def halved(step: int):
        return lambda at: F.when((at + step <= n) & (F.get(edges, at + step - 1) <= x), at + step).otherwise(at)

    found, step = F.lit(0), 1 << max(n.bit_length() - 1, 0)
    while n and step:
        found, step = let(found, halved(step)), step >> 1
    return found


def slots(spark: SparkSession, n: int) -> Column:
    """An array of n keys that hash partitioning deals to n different partitions."""
    tried = spark.range(40 * n + 200).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()  # n rows
    found = {r["p"]: r["id"] for r in tried}
    return F.array(*[F.lit(found.get(i, i)).cast("long") for i in range(n)])


def fingerprint_edits(docs: DataFrame, rarest: float = 1e-4, commonest: float = 0.1) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text replaces the last quarter of the code points (rounded down) by the first as many of
    the next row's text, in the order of doc_id and then text; after the last row comes the first. A row
    with a null doc_id has no place in that order, and its next text is empty. Null texts count as empty.
    """
    spark = docs.sparkSession
    packed = band_of(docs, rarest, commonest).tobytes()
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = texts(docs)
    cuts = sorted(set(map(int, body.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))))
    edge = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    placed = body.withColumn("part", _place(edge, len(cuts), F.col("doc_id")))
    # the first row of each part (at most one for each cut) follows the last row of the part before
    heads = placed.where("doc_id is not null").groupBy("part").agg(F.min("doc_id").alias("head"))
    after = heads.select(F.col("head").alias("doc_id"), F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy())).alias("part"))
    extra = body.join(F.broadcast(after), "doc_id").groupBy("doc_id", "part").agg(F.min("text").alias("text")).select("doc_id", "text", "part", F.lit(True).alias("extra"))
    rows = placed.withColumn("extra", F.lit(False)).unionByName(extra).withColumn("slot", slots(spark, parts)[F.col("part")]).repartition(parts, "slot").drop("slot").sortWithinPartitions("part", F.col("doc_id").isNull(), "extra", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.frombuffer(packed, np.uint64)
        held = None  # the row that waits for its next: (part, doc_id, text, fingerprint)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def done(row, nxt: str, nxt_print: np.ndarray):
            _, doc, text, own = row
            q = len(text) // 4
            edited = text[: len(text) - q] + nxt[:q]
            e = fingerprint(terms(edited), band)
            return doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.astype(">u2").tobytes().hex(), e.astype(">u2").tobytes().hex(), likeness(own, e), likeness(own, nxt_print)

        def batch(out):
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        none = np.zeros(len(RATES), np.uint16)
        for b in batches:
            out = []
            for doc, text, part, more in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                text = text.as_py()
                own = fingerprint(terms(text), band)
                if held is not None:
                    follows = held[0] == part and doc is not None
                    out.append(done(held, text if follows else "", own if follows else none))
                    held = None
                if doc is None:
                    out.append(done((part, doc, text, own), "", none))
                elif not more:
                    held = (part, doc, text, own)
            yield batch(out)
        if held is not None:
            yield batch([done(held, "", none)])

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
