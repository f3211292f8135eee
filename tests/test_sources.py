import datetime as dt
import zlib

import pytest
from pyspark.sql import functions as F

from textloom import queries
from textloom.functions import times
from textloom.operators import embedding, retrieval, stemming
from textloom.plans import index
from textloom.sources import assembly, html
from textloom.streaming import sessions

PAGE = """<html><body><nav><a href="http://x.y/nav">gone</a></nav><h1>Intro &amp; more</h1><p>lead <a href="http://x.y/a">one</a></p>
<section id="work-history"><h2>Jobs</h2><h2>Jobs</h2><ul><li>first <b>bold</b></li><li>first <b>bold</b></li></ul><div id="inner"><a href="https://z.w/q">bare</a><a href="https://me.site/x">own</a></div>
<a href="http://x.y/a">again</a><p><svg><text>no</text></svg></p></section>
<section id="skills"><div class="x skill-cell"><span class="st">Lang</span><div class="tags"><span>A</span><span>B c</span></div></div><div class="skill-cell"><span class="st">Empty</span></div><a>no address</a></section></body></html>"""


def test_html_structure(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>open <p>nested</body>"), (4, "<header id=top><h3>T</h3></header>")], "page_id long, html string")
    found = html.elements(pages).cache()
    lines = [r["line"] for r in html.tagged_lines(found).where("page_id = 1").orderBy("ord").collect()]
    assert lines == [
        "[Skills](#skills) Lang: A, B c", "\n## [Work History] Intro & more\n", "[Work History](#work-history) lead one", "\n## [Work History] Jobs\n", "[Work History](#work-history) first bold",
        "[Work History](#work-history) bare", "[Work History](#work-history) own", "[Work History](#work-history) again", "[Skills](#skills) no address",
    ]
    links = [tuple(r)[1:] for r in html.external_links(found, "me.site").orderBy("page_id", "n").collect()]
    assert links == [(1, "http://x.y/a", "again", "Work History", "#work-history"), (2, "https://z.w/q", "bare", "Work History", "#work-history")]
    assert [r["text"] for r in found.where("page_id = 3").orderBy("ord").collect()] == ["open nested", "nested"]
    assert found.where("page_id = 4").first()["anchor"] == "#top" and found.where("page_id = 3").first()["anchor"] == "#about"
    before = html.page_markdown(found, "# Site")
    assert before.where("page_id = 4").first()["markdown"] == "# Site\n\n## [Top] T\n"
    after = before.withColumn("markdown", F.when(F.col("page_id") == 4, F.concat("markdown", F.lit(" \n"))).otherwise(F.concat("markdown", F.lit("x"))))
    assert {r["page_id"]: r["changed"] for r in html.changed(before, after).collect()} == {1: True, 3: True, 4: False}


def test_pdf_text(spark):
    stream = zlib.compress(b"BT /F1 12 Tf (Hello \\(you\\)) Tj T* [(wor) -20 (ld) -300 (again)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 9 /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\n2 0 obj\n<< /Length 3 >>\nstream\nq Q\nendstream\n3 0 obj\n<< >>\nstream\n(two) Tj\nendstream\n"
    got = spark.createDataFrame([(1, bytearray(pdf)), (2, bytearray(b"nope")), (3, None)], "id int, content binary").select("id", assembly.pdf_text(F.col("content")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in got} == {1: "Hello (you)\nworld again\ntwo", 2: "", 3: ""}


def test_link_chunks(spark):
    kind = "url string, label string, section string, anchor string, metadata string, segments string"
    rows = [("https://youtu.be/abcdefghijk", "L", "S", "#s", '{"title": "T", "author_name": "A"}', '[{"text": "said"}, {"text": "more"}]'), ("https://youtu.be/abcdefghijk", "L2", "S", None, "x", "[]"), ("https://youtu.be/abc", "L3", "S", None, "{}", '[{"text": "no id"}]')]
    prefix = F.concat(F.lit("(in "), "section", F.lit(")"))
    got = {(r["content"], r["title"]) for r in assembly.video_chunks(spark.createDataFrame(rows, kind), prefix).collect()}
    assert got == {('(in S) YouTube video: "T" by A', "T"), ("(in S) T — transcript: said more", "T")}
    texts = spark.createDataFrame([("u", "L", "S", None, "\n\n".join(f"p{i}" for i in range(14))), ("v", "L", "S", None, " ")], "url string, label string, section string, anchor string, text string")
    drive = assembly.drive_chunks(texts, prefix)
    assert sorted(r["content"] for r in drive.collect()) == sorted(f"(in S) L: p{i}" for i in range(10))
    profile = assembly.profile_link(texts.limit(1), F.concat(F.lit("Profile: "), "url"), "Profile")
    static = assembly.static_chunks(spark, [{"content": "here", "source": "resume", "title": "Resume"}])
    resumes = spark.createDataFrame([(1, "Work Experience\nbuilt x\nEducation\nstudied y", "http://r")], "doc_id long, text string, url string")
    resume = assembly.resume_chunks(resumes)
    assert [tuple(r) for r in resume.orderBy("ord").select("content", "section", "title").collect()] == [("Work Experience: built x", "Resume — Work Experience", "Resume — Experience"), ("Education: studied y", "Resume — Education", "Resume — Education")]
    papers = spark.createDataFrame([(1, "one\n\ntwo", "S", "#p", "u", "t")], "doc_id long, text string, section string, anchor string, url string, title string")
    built = assembly.assemble([resume, static, assembly.paper_chunks(papers), profile]).orderBy("ord").collect()
    assert [(r["ord"], r["content"]) for r in built] == list(enumerate(["Work Experience: built x", "Education: studied y", "here", "one", "two", "Profile: u"]))


def test_times_and_vectors(spark):
    r = spark.range(1).select(times.epoch_year(F.lit(1704067199)).alias("y"), times.spoken_time(F.lit("2024-01-01 20:00:00").cast("timestamp_ntz")).alias("t"), times.elapsed_ms(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:01.5").cast("timestamp")).alias("ms"), embedding.parse_vector(F.lit("[0.5,-1]")).alias("v")).first()
    assert (r["y"], r["t"], r["ms"], r["v"]) == (2023, "Tuesday, 02 January 2024, 01:30 AM IST", 1500, [0.5, -1.0])
    assert times.new_batch_id() != times.new_batch_id()
    got = {r["i"]: r["embedding"] for r in embedding.embed(spark.createDataFrame([(1, "A b"), (2, "b a"), (3, None)], "i int, content string")).collect()}
    assert got[1] == got[2] and len(got[3]) == 384 and not any(got[3])


def test_stemmed_search_ignores_stop_words(spark):
    chunks = spark.createDataFrame([(1, "He builds engines"), (2, "the engine"), (3, "build")], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "what is the building of engines"), (2, "the of")], "query_id long, q_text string")
    got = retrieval.keyword_topk(chunks, asked, normalise=stemming.stem, stop=stemming.SEARCH_STOP_WORDS).collect()
    assert [(r["query_id"], r["chunk_id"]) for r in got] == [(1, 1)]


def test_memory_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=i), "user", f"m{i}", "e1") for i in range(5)] + [(2, t0, "user", "old", "e1"), (2, t0 + dt.timedelta(hours=6), "user", "late", "e1"), (3, t0, "user", "a", "e1"), (3, t0 + dt.timedelta(minutes=1), "user", "b", "e2")]
    kind = "conv long, ts timestamp, role string, text string, epoch string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = sessions.memory_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), "conv", "ts", most=3)
    q = out.writeStream.format("memory").queryName("memory").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start()
    q.awaitTermination(60)
    q.stop()
    assert {r["key"]: r["history"] for r in spark.table("memory").collect()} == {1: "user: m2\nuser: m3\nuser: m4", 2: "user: late", 3: "user: b"}


def test_refresh_publishes_new_pages_once(spark, tmp_path):
    ix = index.Index(spark, f"file://{tmp_path}/ix")
    kind = "ord long, content string"
    spark.createDataFrame([(1, "a"), (2, "b")], kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    go = lambda: sessions.refresh(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), lambda df, n: ix.publish(df, f"b{n}"), f"{tmp_path}/c")
    go()
    first = ix.current()
    go()
    assert first["n"] == 2 and ix.current() == first


def test_readers_outlive_a_swap(spark, tmp_path):
    ix = index.Index(spark, f"file://{tmp_path}/ix")
    rows = lambda t: spark.createDataFrame([(1, t)], "ord long, content string")
    ix.publish(rows("one"), "one")
    reader = ix.read()
    ix.publish(rows("two"), "two")
    assert reader.first()["content"] == "one" and ix.read().first()["content"] == "two"
    ix.publish(rows("three"), "three")
    with pytest.raises(Exception):
        reader.collect()


def test_content_hash_by_levels(spark):
    rows = spark.range(500).select(F.col("id").alias("ord"), F.concat(F.lit("c"), "id").alias("content"))
    deep, flat = index.content_hash(rows, group=4).first(), index.content_hash(rows.repartition(7), group=4).first()
    assert deep == flat and deep["n"] == 500
    other = rows.withColumn("content", F.when(F.col("ord") == 77, "x").otherwise(F.col("content")))
    assert index.content_hash(other, group=4).first()["content_hash"] != deep["content_hash"]
    assert index.content_hash(rows.limit(0)).first()["n"] == 0


def test_assembled_order_is_whole_in_many_partitions(spark, tmp_path):
    n = 40000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("text"), F.when(F.col("id") % 7 != 6, F.concat(F.lit("src"), F.col("id") % 7)).alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        got = [(r["ord"], r["title"]) for r in queries.assembled_index(spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == list(enumerate(sorted(range(n), key=lambda i: (min(i % 7, 4), i))))


def test_headings_keep_cut_references_and_count_blanks(spark, tmp_path):
    rows = [(1, "<article><h1>a&amp;&amp</h1></article>"), (2, "<h1>b&lt;&#39;&#x27;&quot;&gt; &am</h1><h2> </h2><h3>&amp;lt; &nbsp; &copy &#38; &</h3>"), (3, "<a href='?a=1&lt=2'>x</a>"), (4, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r["page_id"], r["n"], r["text"]) for r in queries.page_headings(spark, str(tmp_path)).orderBy("page_id", "n").collect()]
    assert got == [(1, 0, "a&&amp"), (2, 0, "b<''\"> &am"), (2, 2, "&lt; &nbsp; &copy &#38; &")]
    assert html.elements(spark.createDataFrame(rows[:1], "page_id long, html string")).first()["text"] == "a&&"


def test_texts_whose_tokens_cancel_have_unit_vectors(spark, tmp_path):
    sign = lambda w: 1 - 2 * (zlib.crc32(w.encode()) & 1)
    place = lambda w: (zlib.crc32(w.encode()) >> 1) % 64
    one = "w0"
    other = next(w for w in (f"w{i}" for i in range(10000)) if place(w) == place(one) and sign(w) != sign(one))
    rows = [(1, f"{one} {other}"), (2, one), (3, "é ."), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: (r["n"], r["norm"]) for r in queries.embedded_texts(spark, str(tmp_path)).collect()} == {1: (64, 1.0), 2: (64, 1.0), 3: (64, 0.0), 4: (64, 0.0)}
