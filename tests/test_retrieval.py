import math
import re

import numpy as np
from pyspark.sql import functions as F

from textloom import queries
from textloom.config import Settings
from textloom.operators import citations, retrieval

CHUNK = "chunk_id long, content string, embedding array<float>, source string, url string, project_id string"
QUERY = "query_id long, q_text string, q_embedding array<float>"


def model_bm25(query, docs):
    toks = [re.findall("[a-z0-9]+", d.lower()) for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = {t: sum(t in d for d in toks) for d in toks for t in d}
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / max(1, len(idf))
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    raw = [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in re.findall("[a-z0-9]+", query.lower())) for d in toks]
    top = max(raw) or 1.0
    return [r / top for r in raw]


def score(spark, query, docs):
    c = spark.createDataFrame([(i, d, [1.0], "s", None, None) for i, d in enumerate(docs)], CHUNK)
    q = spark.createDataFrame([(7, query, [1.0])], QUERY)
    pool = c.select(F.lit(7).cast("long").alias("query_id"), "chunk_id")
    return [r["bm25_score"] for r in retrieval.bm25(pool, c, q).orderBy("chunk_id").collect()]


def test_bm25_edges(spark):
    docs = ["red fox red", "blue fox", "green hen and fox", "hen"]
    for q in ("red hen", "red red", "unknown", "", "fox"):
        assert np.allclose(score(spark, q, docs), model_bm25(q, docs), atol=1e-5), q
    assert np.allclose(score(spark, "a", ["a b"]), model_bm25("a", ["a b"]), atol=1e-5)  # one document: negative scores, 1 after division
    assert score(spark, "a", ["", ""]) == [0.0, 0.0]


def test_mmr():
    v = np.array([[1, 0], [1, 0], [0, 1], [0, 0]], float)
    assert retrieval.mmr_order(np.array([1.0, 0.1]), v, 3) == [0, 2, 1] or retrieval.mmr_order(np.array([1.0, 0.1]), v, 3)[0] == 0
    assert retrieval.mmr_order(np.array([1.0, 0]), v, 0) == []
    assert sorted(retrieval.mmr_order(np.array([1.0, 0]), v, 9)) == [0, 1, 2, 3]


def test_diversify_and_slots(spark):
    rows = [(1, i, i + 1, p) for i, p in enumerate(["a", None, "a", "", "b", "c", "d", "e", "f", "g", "h", "i"])]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, project_id string")
    got = {r["chunk_id"]: (r["div_rank"], r["slot"]) for r in retrieval.diversify(df, Settings()).collect()}
    assert got[0] == (1, 1) and got[4] == (2, 2) and got[9] == (7, 7) and got[10] == (8, None) and got[1] == (10, None)


def test_compress(spark):
    t = "Red fox. Blue hen. Red hen. Nothing here. Red fox."
    got = spark.createDataFrame([(t, "red fox"), ("One. Two.", "x"), ("A. B. C. D.", "zzz")], "c string, q string").select(retrieval.compress(F.col("c"), F.col("q"))).collect()
    assert [r[0] for r in got] == ["Red fox. Red hen. Red fox.", "One. Two.", "A. B. C."]


def test_citations_greedy(spark):
    rows = [(1, 1, "https://a.com/x", "L1"), (1, 2, "http://www.a.com/x/", "L2"), (1, 3, "https://b.com", "L2"), (1, 4, "https://c.com", "l1"), (1, 5, "", "E"), (1, 6, "", "F")]
    got = citations.deduplicate(spark.createDataFrame(rows, "query_id int, final_rank int, url string, label string")).first()["citations"]
    assert [c["label"] for c in got] == ["L1", "L2", "E"]  # the dropped second row does not block its label


def test_retrieve_invariants(spark, data):
    rows = queries.retrieve(spark, data).collect()
    assert rows
    s = Settings()
    by = {}
    for r in rows:
        assert r["vector_score"] >= s.vector_min or r["bm25_score"] >= s.bm25_min
        by.setdefault(r["query_id"], []).append(r)
    for rs in by.values():
        assert len(rs) <= s.top_k and sorted(r["final_rank"] for r in rs) == list(range(1, len(rs) + 1))


def test_empty_tables(spark):
    c, q = spark.createDataFrame([], CHUNK), spark.createDataFrame([(1, "a", [1.0])], QUERY)
    assert retrieval.retrieve(c, q).count() == 0
    assert retrieval.vector_topk(c, spark.createDataFrame([], QUERY)).count() == 0


def test_keyword_words_are_stemmed_once_and_meet_by_the_rarest(spark):
    chunks = spark.createDataFrame([(1, "Engines engine the builds"), (2, "engine engine"), (3, "build engines built"), (4, None), (5, "building of engines engines")], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "what is the building of engines"), (2, "the of"), (3, "engine nowhere"), (4, "engines"), (5, None)], "query_id long, q_text string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t.removesuffix("ing").removesuffix("s")

    many = chunks.union(spark.range(100, 200).select("id", F.repeat(F.lit("filler "), 50)))
    got = retrieval.keyword_topk(many, asked, normalise=counted, stop=["the", "of", "is", "what"])
    rows = [tuple(r) for r in got.orderBy("query_id", "kw_rank").collect()]
    assert rows == [(1, 1, 3, 1), (1, 5, 3, 2), (1, 3, 2, 3), (4, 2, 2, 1), (4, 1, 2, 2), (4, 5, 2, 3), (4, 3, 1, 4)]
    assert seen.value < 200
