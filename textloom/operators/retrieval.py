"""Hybrid retrieval for many queries in one plan.

chunks: (chunk_id, content, embedding, source, url, project_id, ...); queries: (query_id, q_text, q_embedding).
Only the survivors of the vector and keyword passes are shuffled, keyed by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.config import DEFAULT, EXTERNAL, PRIMARY, Settings
from textloom.functions.text import let, sentences, tokens
from textloom.scratch import Scratch

BLOCK = 4096


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by the smaller id."""
    if len(sims) > k:
        near = np.flatnonzero(sims >= np.partition(sims, -k)[-k])
    else:
        near = np.arange(len(sims))
    return near[np.lexsort((ids[near], -sims[near]))][:k]


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT.pool) -> DataFrame:
    """(query_id, chunk_id, vector_score, vec_rank): the k chunks of largest cosine similarity.

    Queries are read in blocks of 4096; each task multiplies its chunks with a block and passes on its
    own k best, so k rows for each query and task are shuffled. Zero vectors score 0.
    """
    rows = queries.select("query_id", F.col("q_embedding").cast("array<double>").alias("v"))
    out, block = None, []

    def one(block: list) -> DataFrame:
        qid = np.array([r[0] for r in block], np.int64)
        q = np.array([r[1] for r in block], np.float64)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(qid)
            for b in batches:
                if not b.num_rows:
                    continue
                ids = b.column(0).to_numpy(zero_copy_only=False)
                e = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                e = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-9)
                s = np.round(q @ e.T, 6) + 0.0
                for i in range(len(qid)):
                    c, v = np.concatenate([best[i][0], ids]), np.concatenate([best[i][1], s[i]])
                    at = _top(c, v, k)
                    best[i] = c[at], v[at]
            for i in range(len(qid)):
                if len(best[i][0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best[i][0]), qid[i])), pa.array(best[i][0]), pa.array(best[i][1])], ["query_id", "chunk_id", "vector_score"])

        return chunks.where("embedding is not null").select(F.col("chunk_id").cast("long"), "embedding").mapInArrow(run, "query_id long, chunk_id long, vector_score double")

    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            out, block = one(block) if out is None else out.union(one(block)), []
    if block:
        out = one(block) if out is None else out.union(one(block))
    if out is None:
        return queries.sparkSession.createDataFrame([], "query_id long, chunk_id long, vector_score double, vec_rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("vector_score"), "chunk_id")
    return out.withColumn("vec_rank", F.row_number().over(w)).where(F.col("vec_rank") <= k)


def keyword_topk(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT.keyword_limit, normalise=None, stop: list[str] | None = None, most: int = 1_000_000) -> DataFrame:
    """(query_id, chunk_id, hits, kw_rank): chunks that hold every term of a query, most occurrences first,
    then shorter, then by id. An inverted-index join on terms; normalise may stem a column of terms, and
    stop words count on neither side. Chunks meet the asked words of all queries first (broadcast if
    there are at most `most`), so only asked terms are counted and written. Each distinct word is normalised
    once, and a query meets only the chunks that hold its rarest term."""
    scratch = Scratch(chunks.sparkSession, "keywords")
    kept = lambda t: ~t.isin(stop) if stop else F.lit(True)
    term = normalise or (lambda c: c)
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("q_text")))).alias("t")).where(kept(F.col("t"))).select("query_id", term(F.col("t")).alias("term")).distinct()
    asked = q.select("term").distinct()
    # Lengths are taken before words become rows: afterwards each word would measure its whole chunk.
    c = chunks.select("chunk_id", F.length("content").alias("len"), tokens(F.col("content")).alias("w")).select("chunk_id", "len", F.explode("w").alias("t"))
    if normalise:
        forms = scratch.save(c.select("t").where(kept(F.col("t"))).distinct().select("t", term(F.col("t")).alias("term")), "forms")
        asked = forms.join(asked, "term")
    else:
        asked = asked.withColumn("t", F.col("term"))
    asked = F.broadcast(asked) if asked.count() <= most else asked
    tf = scratch.save(c.join(asked, "t").groupBy("chunk_id", "len", "term").agg(F.count("*").alias("tf")), "tf")
    held = q.join(tf.groupBy("term").agg(F.count("*").alias("df")), "term", "left")
    lead = held.groupBy("query_id").agg(F.count("*").alias("need"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))["term"].alias("term"))
    near = tf.join(lead, "term").select("query_id", "need", "chunk_id", "len").join(q, "query_id")
    met = near.join(tf, ["chunk_id", "len", "term"]).groupBy("query_id", "need", "chunk_id", "len").agg(F.count("*").alias("n"), F.sum("tf").alias("hits")).where("n = need")
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "len", "chunk_id")
    return met.withColumn("kw_rank", F.row_number().over(w)).where(F.col("kw_rank") <= k).select("query_id", "chunk_id", "hits", "kw_rank")


def bm25(pool: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, bm25_raw, bm25_score) over each query's own pool of (query_id, chunk_id).

    k1 1.5, b 0.75; negative idf become a quarter of the mean idf of all terms of the pool. Query terms
    count as often as they stand in the query. Scores are divided by the query's largest (1 if that is 0).
    """
    docs = pool.select("query_id", "chunk_id").join(chunks.select("chunk_id", tokens(F.col("content")).alias("w")), "chunk_id")
    stats = docs.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    tf = docs.select("query_id", "chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("query_id", "chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df")).join(stats, "query_id").withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.groupBy("query_id").agg(F.avg("idf").alias("mean_idf"))
    asked = queries.select("query_id", F.explode(tokens(F.col("q_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("m"))
    idf = df.join(asked, ["query_id", "term"]).join(mean, "query_id").withColumn("idf", F.when(F.col("idf") < 0, 0.25 * F.col("mean_idf")).otherwise(F.col("idf")))
    part = F.col("m") * F.col("idf") * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    score = tf.join(idf.select("query_id", "term", "idf", "m", "avgdl"), ["query_id", "term"]).groupBy("query_id", "chunk_id").agg(F.sum(F.round(part, 12)).alias("raw"))
    full = pool.select("query_id", "chunk_id").join(score, ["query_id", "chunk_id"], "left").withColumn("bm25_raw", F.round(F.coalesce("raw", F.lit(0.0)), 6))
    most = F.max("bm25_raw").over(Window.partitionBy("query_id"))
    return full.select("query_id", "chunk_id", "bm25_raw", F.round(F.col("bm25_raw") / F.when(most == 0, 1.0).otherwise(most), 6).alias("bm25_score"))


def candidates(chunks: DataFrame, queries: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, chunk_id, pool_ord, vector_score, bm25_score): the vector pool, then keyword hits that it lacks.

    A keyword hit that repeats the source, url and content of a pooled chunk is left out; the others
    have a BM25 score of 1 and take no part in the pool's statistics.
    """
    vec = vector_topk(chunks, queries, s.pool)
    kw = keyword_topk(chunks, queries, s.keyword_limit)
    same = chunks.select("chunk_id", F.struct("source", "url", F.xxhash64("content").alias("h"), F.length("content").alias("n")).alias("same"))
    pooled = vec.join(same, "chunk_id").select("query_id", "same")
    only = kw.join(same, "chunk_id").alias("k").join(pooled.alias("p"), F.expr("k.query_id = p.query_id and k.same <=> p.same"), "left_anti")
    v, q = chunks.select("chunk_id", F.col("embedding").cast("array<double>").alias("e")), queries.select("query_id", F.col("q_embedding").cast("array<double>").alias("v"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    dot = F.aggregate(F.zip_with("e", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    only = only.join(v, "chunk_id").join(q, "query_id").select("query_id", "chunk_id", (F.col("kw_rank") + 1000).alias("pool_ord"), F.round(F.coalesce(dot / F.greatest(norm("e") * norm("v"), F.lit(1e-9)), F.lit(0.0)), 6).alias("vector_score"), F.lit(1.0).alias("bm25_score"))
    scored = vec.join(bm25(vec, chunks, queries), ["query_id", "chunk_id"]).select("query_id", "chunk_id", F.col("vec_rank").alias("pool_ord"), "vector_score", "bm25_score")
    return scored.union(only)


def shortlist(cands: DataFrame, chunks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds score and rank: candidates that pass either gate, best first, ties in pool order, the first 75."""
    rows = cands.join(chunks.select("chunk_id", "source", "project_id"), "chunk_id")
    boost = F.when(F.col("source").isin(PRIMARY), s.source_boost).when(F.col("source") == EXTERNAL, -s.source_boost).otherwise(0.0)
    score = F.round(s.vector_weight * F.col("vector_score") + s.bm25_weight * F.col("bm25_score") + boost, 8)
    passed = rows.withColumn("score", score).where((F.col("vector_score") >= s.vector_min) | (F.col("bm25_score") >= s.bm25_min))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_ord"))
    return passed.withColumn("rank", rank).where(F.col("rank") <= s.shortlist)


def diversify(short: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds div_rank (the first chunk of each project, then the rest) and slot (1 to 7 for guaranteed chunks, else null)."""
    named = F.coalesce("project_id", F.lit("")) != ""
    nth = F.row_number().over(Window.partitionBy("query_id", "project_id").orderBy("rank"))
    rows = short.withColumn("lead", named & (nth == 1))
    slot = F.sum(F.col("lead").cast("int")).over(Window.partitionBy("query_id").orderBy("rank"))
    div = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lead"), "rank"))
    return rows.withColumn("div_rank", div).withColumn("slot", F.when(F.col("lead") & (slot <= s.guaranteed), slot)).drop("lead")


def mmr_order(query: np.ndarray, vectors: np.ndarray, k: int, weight: float = DEFAULT.mmr_lambda) -> list[int]:
    """Places of k vectors picked by maximal marginal relevance; ties take the earliest."""
    if k <= 0 or not len(vectors):
        return []
    norm = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norm == 0, 1e-9, norm)[:, None]
    relevance = unit @ (query / max(np.linalg.norm(query), 1e-9))
    picked, nearest, left = [], np.full(len(vectors), -np.inf), np.ones(len(vectors), bool)
    while left.any() and len(picked) < k:
        value = relevance if not picked else weight * relevance - (1 - weight) * nearest
        i = int(np.argmax(np.where(left, np.round(value, 12), -np.inf)))
        picked.append(i)
        left[i] = False
        nearest = np.maximum(nearest, unit @ unit[i])
    return picked


def select_final(div: DataFrame, chunks: DataFrame, queries: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds final_rank: guaranteed chunks in order, then MMR picks; at most 75 rows of a query meet in a task."""
    rows = div.join(chunks.select("chunk_id", F.col("embedding").cast("array<double>").alias("e")), "chunk_id").join(queries.select("query_id", F.col("q_embedding").cast("array<double>").alias("v")), "query_id")

    def pick(t: pa.Table) -> pa.Table:
        t = t.sort_by("div_rank")
        slot = t["slot"].to_pylist()
        sure = sorted((i for i, x in enumerate(slot) if x is not None), key=lambda i: slot[i])[: s.top_k]
        rest = [i for i in range(t.num_rows) if slot[i] is None]
        e = np.array(t["e"].to_pylist(), np.float64)
        order = sure + [rest[i] for i in mmr_order(np.array(t["v"][0].as_py()), e[rest], s.top_k - len(sure), s.mmr_lambda)]
        out = t.select(["query_id", "chunk_id", "score", "vector_score", "bm25_score", "source", "project_id"]).take(pa.array(order, pa.int64()))
        return out.append_column("final_rank", pa.array(range(1, len(order) + 1), pa.int32()))

    return rows.groupBy("query_id").applyInArrow(pick, "query_id long, chunk_id long, score double, vector_score double, bm25_score double, source string, project_id string, final_rank int")


def compress(content, q_text, most: int = DEFAULT.max_sentences):
    """The sentences that share most words with the query (first wins ties), in text order."""
    words = F.array_distinct(tokens(q_text))

    def shorten(s, asked):
        item = lambda x, i: F.struct((-F.size(F.array_intersect(tokens(x), asked))).alias("o"), i.alias("i"), x.alias("t"))
        top = F.transform(F.slice(F.array_sort(F.transform(s, item)), 1, most), lambda x: x["t"])
        return let(top, lambda t: F.array_join(F.filter(s, lambda x: F.array_contains(t, x)), " "))

    return let(sentences(content), lambda s: F.when(F.size(s) <= most, content).otherwise(let(words, lambda asked: shorten(s, asked))))


def retrieve(chunks: DataFrame, queries: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, final_rank, chunk_id, score, vector_score, bm25_score, source, project_id, content): up to 15 compressed chunks of each query."""
    final = select_final(diversify(shortlist(candidates(chunks, queries, s), chunks, s), s), chunks, queries, s)
    rows = final.join(chunks.select("chunk_id", "content"), "chunk_id").join(queries.select("query_id", "q_text"), "query_id")
    return rows.withColumn("content", compress(F.col("content"), F.col("q_text"), s.max_sentences)).drop("q_text")
