import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from textloom.plans import index
from textloom.sources import records
from textloom.streaming import sessions

T0 = dt.datetime(2024, 1, 1)


def test_sessions_gap(spark):
    rows = [(1, T0), (1, T0 + dt.timedelta(hours=6)), (1, T0 + dt.timedelta(hours=11, minutes=59)), (2, T0)]
    got = sorted((r["user"], r["n"]) for r in sessions.sessions(spark.createDataFrame(rows, "user int, ts timestamp"), "user", "ts").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_admit():
    ok, opened, used = sessions.admit([float(i) for i in range(31)], None, 0, 30, 60)
    assert ok == [True] * 30 + [False] and opened == 0 and used == 31
    assert sessions.admit([60.0], opened, used, 30, 60) == ([True], 60.0, 1)


def test_snapshot_swap(spark, tmp_path):
    ix = index.Index(spark, f"file://{tmp_path}/ix")
    assert ix.current() is None and ix.read() is None
    rows = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0])], "ord long, content string, embedding array<double>")
    first = ix.publish(rows, "one", 2)
    assert first["changed"] and ix.read().count() == 2
    with pytest.raises(ValueError):
        ix.publish(rows, "two", 3)
    with pytest.raises(ValueError):
        ix.publish(rows.limit(0), "three")
    assert ix.current()["batch_id"] == "one"
    assert not ix.publish(rows, uuid.uuid4().hex)["changed"]


def test_streams(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(seconds=i)) for i in range(4)] + [(2, T0), (2, T0 + dt.timedelta(days=2))]
    spark.createDataFrame(rows, "user int, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    src = lambda: spark.readStream.schema("user int, ts timestamp").parquet(f"{tmp_path}/in")
    q = sessions.session_stream(src(), "user", "ts").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["user"], r["n"]) for r in spark.table("closed").collect()) == [(1, 4), (2, 1)]
    q = sessions.rate_limit_stream(src(), "user", "ts", limit=3).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(once=True).start()
    q.awaitTermination(60)
    q.stop()
    assert spark.table("limited").where("not admitted").count() == 1 and spark.table("limited").count() == 6


def test_records(spark, tmp_path):
    assert records.link_manifest(spark, f"file://{tmp_path}/none.json").count() == 0
    cat = spark.createDataFrame([("r", "u", "dev", "d", None, False), ("f", "u", "main", None, None, True)], "name string, html_url string, default_branch string, description string, language string, fork boolean")
    assert [r["content"] for r in records.repositories(cat).collect()] == ["r: d"]
    files = spark.createDataFrame([("r", "master", "M"), ("r", "main", "A"), ("r", "dev", " ")], "name string, branch string, text string")
    assert {r["name"]: r["readme"] for r in records.readmes(cat, files).collect()} == {"r": "A", "f": None}
    h = '<script type="application/ld+json">{"name":"N","description":"D"}</script><script type="application/ld+json">oops</script><meta property="og:description" content="og"><math><annotation encoding="application/x-tex">x^2</annotation></math>'
    r = spark.createDataFrame([(h,)], "h string").select(records.json_ld_text(F.col("h")), records.meta_description(F.col("h")), records.inline_math(F.lit("a <math><annotation encoding=\"application/x-tex\">x^2</annotation></math> b"))).first()
    assert (r[0], r[1]) == ("N: D", "og") and "$x^2$" in r[2]
    fails = iter([(503, None), (200, "body")])
    assert records.with_retries(lambda u: next(fails), wait=0)("u") == "body"


def test_history_and_flush(spark):
    rows = spark.createDataFrame([(1, i, "x") for i in range(25)], "conv int, turn int, text string")
    assert sessions.last_messages(rows, "conv", "turn").agg(F.min("turn"), F.count("*")).first() == (5, 20)
    left, n = sessions.flush(spark.createDataFrame([("s:1",), ("h",)], "key string"), "s:")
    assert n == 1 and left.count() == 1
