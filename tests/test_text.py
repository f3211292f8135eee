import re

from pyspark.sql import functions as F

from textloom.functions import text as tx


def one(spark, rows, kind, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, kind).select(*cols).collect()]


def test_small_talk(spark):
    yes = ["hello there", "Good  morning", "bye", "thanks a lot", "how are you", "what time is it", "what's the date", "  hey  "]
    no = ["", "   ", None, "hi-fi systems", "hello one two three four five six seven eight", "tell me about it"]
    got = one(spark, [(m,) for m in yes + no], "m string", tx.small_talk(F.col("m")))
    assert [bool(x[0]) for x in got] == [True] * len(yes) + [False] * len(no)


def test_boilerplate(spark):
    lines = ["Corresponding author: x", "ORCID 1", "© me", "a@b.co", "x" * 299 + "", "doi: 5", "", "plain", "copyright " + "y" * 300]
    got = one(spark, [("\n".join(lines),)], "t string", tx.strip_boilerplate(F.col("t")))[0][0]
    assert got.split("\n") == ["x" * 299, "", "plain", "copyright " + "y" * 300]


def test_headers(spark):
    rows = ["EDUCATION", "Work History", "work history", "Skills:", "A, B", "ab", "x" * 41, "One Two Three Four Five", "1234", ""]
    got = [x[0] for x in one(spark, [(r,) for r in rows], "s string", tx.is_section_header(F.col("s")))]
    assert got == [True, True, False, False, False, False, False, False, False, False]


def test_url_key(spark):
    rows = {"https://WWW.A.com/B/": "a.com/b", "http://a.com:80/x?y#z": "a.com:80/x", "": "", None: "", " https://a.com ": "a.com", "a.com/b": "a.com/b", "https://u@h/p;q": "u@h/p"}
    got = [x[0] for x in one(spark, [(k,) for k in rows], "u string", tx.url_key(F.col("u")))]
    assert got == list(rows.values())


def test_lines_and_sentences(spark):
    t = "a\r\nb\x0bc\n"
    assert one(spark, [(t,)], "t string", tx.split_lines(F.col("t")))[0][0] == t.splitlines()
    s = " One. Two!  Three? four"
    assert one(spark, [(s,)], "t string", tx.sentences(F.col("t")))[0][0] == re.split(r"(?<=[.!?])\s+", s.strip())


def test_html(spark):
    h = "<html><nav>no</nav><script>x='</p>'</script><!-- c --><p>A &amp; B<br>C</p><a class=x href=\"/u\">l</a></html>"
    assert one(spark, [(h,)], "h string", tx.html_text(F.col("h")), tx.html_links(F.col("h"))) == [("A & B C l", ["/u"])]
