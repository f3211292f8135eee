import random

from pyspark.sql import functions as F

from textloom.operators import chunking


def model(text, size, overlap):
    """An independent model of the splitter."""
    if len(text) <= size:
        return [text] if text.strip() else []
    for sep in chunking.SEPARATORS:
        parts = text.split(sep)
        if len(parts) > 1:
            out, cur = [], ""
            for p in parts:
                c = cur + sep + p if cur else p
                if len(c) <= size:
                    cur = c
                else:
                    if cur:
                        out.append(cur.strip())
                    cur = p
            if cur:
                out.append(cur.strip())
            out = [p if i == 0 else out[i - 1][-overlap:] + " " + p for i, p in enumerate(out)]
            return [p for p in out if p.strip()]
    return [w for i in range(0, len(text), size - overlap) if (w := text[i : i + size]).strip()]


def test_recursive_split(spark):
    rng = random.Random(1)
    texts = ["", "   ", "x" * 20, "x" * 21, "ab\n\ncd" * 9, "\n\nlead" + "y" * 30, "a. b. " * 12, "w " * 40, "z" * 100] + ["".join(rng.choice("ab .\n") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.recursive_split(F.col("t"), 20, 5).alias("c")).collect()
    assert {r["i"]: r["c"] for r in rows} == {i: model(t, 20, 5) for i, t in enumerate(texts)}


def test_tagged_lines(spark):
    lines = ["# Title", "## [Work] Acme", "[Work](#work) did a", "[Work](#work) did b", "## [Skills] Skills", "[Skills](#skills) sql", "loose"]
    got = chunking.tagged_lines(spark.createDataFrame(list(enumerate(lines)), "ord int, line string"), "https://x/").orderBy("ord").collect()
    assert [(r["content"], r["url"]) for r in got] == [("Acme: did a did b", "https://x/#work"), ("sql", "https://x/#skills")]


def test_paragraphs(spark):
    assert spark.createDataFrame([(" a \n \nb\n\n\n c",)], "t string").select(chunking.paragraphs(F.col("t"))).first()[0] == ["a", "b", "c"]
