"""Packing into optimal length buckets.

The global histogram of sequence lengths is bounded by the context length. A dynamic program over it
chooses the bucket boundaries with the least padding, and batches within a token budget form inside
each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textloom.llm.common import Scratch, texts


def words_of(text: Column) -> Column:
    """Default tokens: words, each with the ASCII white space before it, so that joined they are the text less white space at its end."""
    parts = F.split(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.filter(parts, lambda x: x != "")


def tokens_of(path: str):
    """Token ids by a tokenizers JSON file, read on the executors."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batch):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        return batch.map(lambda t: tok.encode(t or "", add_special_tokens=False).ids)

    return encode


def boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets that minimise the padding of all sequences.

    counts[l] sequences have length l. With N and T the running counts and tokens, putting lengths
    i+1..j in one bucket pads j * (N[j] - N[i]) - (T[j] - T[i]) tokens; ties choose the smallest i.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    n = np.concatenate([[0], np.cumsum(counts[lengths])]).astype(np.int64)
    t = np.concatenate([[0], np.cumsum(counts[lengths] * lengths)]).astype(np.int64)
    m = len(lengths)
    best = np.full(m + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, m)):
        cost, cut = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            pad = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (t[j] - t[:j])
            i = int(pad.argmin())
            if pad[i] < cost[j]:
                cost[j], cut[j] = pad[i], i
        best = cost
        cuts.append(cut)
    out, j = [], m
    for cut in reversed(cuts):
        if cut[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1]


def sequences(docs: DataFrame, context: int, encode=words_of) -> DataFrame:
    """(doc_id, piece, n_tokens, content): every text whole, in pieces of at most `context` tokens.

    content is the piece's slice of the text, or its token ids. Null and empty texts give no piece.
    """
    tokens = texts(docs).select("doc_id", encode(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    strings = dict(tokens.dtypes)["tokens"] == "array<string>"
    cut = lambda k: F.slice("tokens", k * context + 1, context)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / context).cast("int")), lambda k: F.struct(F.least(F.lit(context), F.size("tokens") - k * context).cast("long").alias("n"), (F.array_join(cut(k), "") if strings else cut(k)).alias("c")))
    return tokens.select("doc_id", F.posexplode(pieces).alias("piece", "x")).select("doc_id", F.col("piece").cast("long").alias("piece"), F.col("x.n").alias("n_tokens"), F.col("x.c").alias("content"))


def pack(docs: DataFrame, context: int = 2048, buckets: int = 8, budget: int = 65536, block_rows: int = 100_000, encode=words_of) -> DataFrame:
    """(doc_id, piece, n_tokens, bucket, batch, slot, padding, content), one row for each piece.

    A batch of bucket b holds budget // b pieces (at least one), padded to b. Pieces are ranked inside
    a bucket by block, doc_id, piece, length and content: blocks, of about `block_rows` pieces, deal out hot
    buckets, and the counts of the blocks give each its offset, so no task sees a whole bucket. Only a
    bucket's last batch is not full. Repeated rows are separate sequences; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    seqs = scratch.save(sequences(docs, context, encode), "sequences")
    histogram = np.zeros(context + 1, np.int64)
    for r in seqs.groupBy("n_tokens").agg(F.count("*").alias("n")).collect():  # at most `context` rows
        histogram[r["n_tokens"]] = r["n"]
    edges = F.array(*[F.lit(b).cast("long") for b in boundaries(histogram, buckets)]) if histogram.any() else F.array().cast("array<bigint>")
    placed = seqs.withColumn("bucket", F.element_at(F.filter(edges, lambda b: b >= F.col("n_tokens")), 1) if histogram.any() else F.lit(0).cast("long"))
    blocks = max(1024, -(-int(histogram.sum()) // block_rows))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    sizes = placed.groupBy("bucket", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("bucket", "block").orderBy("doc_id", "piece", "n_tokens", "content")) - 1
    ranked = placed.withColumn("rank", rank).join(F.broadcast(before), ["bucket", "block"])  # a row for `block_rows` pieces or for each of 1024 * buckets
    per = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1)).cast("long")
    at = F.col("before") + F.col("rank")
    return ranked.select("doc_id", "piece", "n_tokens", "bucket", F.floor(at / per).cast("long").alias("batch"), (at % per).alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"), "content")
