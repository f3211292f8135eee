"""Sources: link manifests, tagged markdown, and the JSON that profile and catalogue services return.

Fetching is left to the caller (a reader, a file, a table); these functions turn what was fetched into
chunks (content, source, section, anchor, url, title).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import CODING_USER, DRIVE_ID, ORCID_ID, VIDEO_ID, first_group, html_text, strip
from textloom.operators.chunking import paragraphs, recursive_split

CHUNK = "content string, source string, section string, anchor string, url string, title string"


def _read(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    """What a reader gives; an empty table where the path doesn't exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return read(path)


def link_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "url string, label string, section string, anchor string"
    return _read(spark, path, lambda p: spark.read.schema(schema).option("multiLine", True).json(p), schema)


def markdown_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) of one file."""
    whole = lambda p: spark.read.option("wholetext", True).text(p).select(F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    return _read(spark, path, whole, "ord int, line string")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files that start as PDF files do."""
    return spark.read.format("binaryFile").load(path).select("path", "content").where(F.substring("content", 1, 4) == F.lit(b"%PDF"))


def repositories(catalogue: DataFrame) -> DataFrame:
    """Repositories that aren't forks: a baseline chunk for each."""
    own = catalogue.where(~F.coalesce("fork", F.lit(False)))
    text = F.concat(F.col("name"), F.when(F.col("language").isNotNull(), F.concat(F.lit(" (written in "), "language", F.lit(")"))).otherwise(""), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise(""))
    return own.select(text.alias("content"), F.lit("github_repo").alias("source"), F.lit("Projects").alias("section"), F.lit("#projects").alias("anchor"), F.col("html_url").alias("url"), F.col("name").alias("title"))


def readmes(catalogue: DataFrame, files: DataFrame) -> DataFrame:
    """(name, readme): the first non-blank README of the default branch, main, then master; null where there is none."""
    rank = F.when(F.col("branch") == F.col("default_branch"), 0).when(F.col("branch") == "main", 1).when(F.col("branch") == "master", 2)
    both = catalogue.select("name", "default_branch").join(files.where(strip(F.col("text")) != ""), "name", "left").withColumn("rank", rank)
    return both.groupBy("name").agg(F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "text"))).alias("best")).select("name", F.col("best.text").alias("readme"))


def chess_summary(stats: Column) -> Column:
    """One sentence from a stats document; absent parts are skipped."""
    kind = "struct<last:struct<rating:int>,best:struct<rating:int>,record:struct<win:int,loss:int,draw:int>>"
    s = F.from_json(stats, f"struct<chess_rapid:{kind},chess_blitz:{kind},chess_bullet:{kind},chess_daily:{kind},tactics:struct<highest:struct<rating:int>>,puzzle_rush:struct<best:struct<score:int>>>")

    def mode(name: str) -> Column:
        m = s[f"chess_{name}"]
        best = F.when(m["best"]["rating"].isNotNull(), F.concat(F.lit(", best "), m["best"]["rating"].cast("string"))).otherwise("")
        record = F.when(m["record"].isNotNull(), F.concat(F.lit(", "), F.concat_ws("/", *[F.coalesce(m["record"][k], F.lit(0)).cast("string") for k in ("win", "loss", "draw")]), F.lit(" W/L/D"))).otherwise("")
        return F.when(m["last"]["rating"].isNotNull(), F.concat(F.lit(f"{name} rating "), m["last"]["rating"].cast("string"), best, record))

    tactics = F.when(s["tactics"]["highest"]["rating"].isNotNull(), F.concat(F.lit("highest tactics rating "), s["tactics"]["highest"]["rating"].cast("string")))
    rush = F.when(s["puzzle_rush"]["best"]["score"].isNotNull(), F.concat(F.lit("puzzle rush best "), s["puzzle_rush"]["best"]["score"].cast("string")))
    return F.concat_ws("; ", *[mode(n) for n in ("rapid", "blitz", "bullet", "daily")], tactics, rush)


def affiliations(record: Column, kind: str) -> Column:
    """Lines "role, department, organisation (start - end)" of a nested affiliation record."""
    date = "struct<year:struct<value:string>>"
    item = f"struct<organization:struct<name:string>,`role-title`:string,`department-name`:string,`start-date`:{date},`end-date`:{date}>"
    r = F.from_json(record, f"struct<`affiliation-group`:array<struct<summaries:array<map<string,{item}>>>>>")
    each = F.flatten(F.transform(r["affiliation-group"], lambda g: F.transform(g["summaries"], lambda s: F.element_at(s, F.lit(kind)))))
    span = lambda x: F.concat(F.lit(" ("), F.coalesce(x["start-date"]["year"]["value"], F.lit("?")), F.lit(" - "), F.coalesce(x["end-date"]["year"]["value"], F.lit("present")), F.lit(")"))
    line = lambda x: F.concat(F.concat_ws(", ", x["role-title"], x["department-name"], x["organization"]["name"]), span(x))
    return F.transform(F.filter(each, lambda x: x["organization"]["name"].isNotNull()), line)


def work_titles(record: Column) -> Column:
    """The first title of each group of works."""
    r = F.from_json(record, "struct<group:array<struct<`work-summary`:array<struct<title:struct<title:struct<value:string>>>>>>>")
    return F.filter(F.transform(r["group"], lambda g: F.get(F.filter(F.transform(g["work-summary"], lambda w: w["title"]["title"]["value"]), lambda t: t.isNotNull()), F.lit(0))), lambda t: t.isNotNull())


def transcript(segments: Column) -> Column:
    """The texts of a JSON list of segments, joined by spaces; "" for anything else."""
    s = F.from_json(segments, "array<struct<text:string>>")
    return F.coalesce(F.array_join(F.filter(F.transform(s, lambda x: x["text"]), lambda t: t != ""), " "), F.lit(""))


def coding_summary(stats: Column, link: Column) -> Column:
    """Solved counts of a coding profile; the bare link where the answer isn't a success."""
    s = F.from_json(stats, "struct<status:string,totalSolved:int,totalQuestions:int,easySolved:int,totalEasy:int,mediumSolved:int,totalMedium:int,hardSolved:int,totalHard:int,ranking:int,acceptanceRate:double>")
    part = lambda name, a, b: F.when(s[a].isNotNull(), F.concat(F.lit(f"{name} "), s[a].cast("string"), F.when(s[b].isNotNull(), F.concat(F.lit("/"), s[b].cast("string"))).otherwise("")))
    text = F.concat_ws("; ", part("solved", "totalSolved", "totalQuestions"), part("easy", "easySolved", "totalEasy"), part("medium", "mediumSolved", "totalMedium"), part("hard", "hardSolved", "totalHard"), F.when(s["ranking"].isNotNull(), F.concat(F.lit("ranking "), s["ranking"].cast("string"))))
    return F.when((s["status"] == "success") & (text != ""), text).otherwise(F.concat(F.lit("Coding profile: "), link))


def json_ld_text(html: Column) -> Column:
    """"name: description" of each linked-data block of a page, objects or lists; malformed blocks are skipped."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    item = "struct<name:string,description:string>"
    listed = lambda b: F.when(F.ltrim(b).startswith("["), F.from_json(b, f"array<{item}>")).otherwise(F.array(F.from_json(b, item)))
    items = F.flatten(F.transform(blocks, listed))
    text = F.transform(items, lambda x: F.concat_ws(": ", F.nullif(x["name"], F.lit("")), F.nullif(x["description"], F.lit(""))))
    return F.array_join(F.filter(text, lambda t: t != ""), "\n")


def meta_description(html: Column) -> Column:
    """The og:description of a page, else its description, else ""."""
    find = lambda attr, name: F.nullif(strip(F.regexp_extract(html, rf'(?is)<meta[^>]*{attr}="{name}"[^>]*content="([^"]*)"', 1)), F.lit(""))
    return F.coalesce(find("property", "og:description"), find("name", "description"), F.lit(""))


def inline_math(html: Column) -> Column:
    """Math elements as $latex$ from their alt text or annotation; others go."""
    s = F.regexp_replace(html, r'(?is)<math[^>]*>(?:(?!</math>).)*?<annotation[^>]*application/x-tex[^>]*>(.*?)</annotation>.*?</math>', r" \$$1\$ ")
    s = F.regexp_replace(s, r'(?is)<img[^>]*class="[^"]*math[^"]*"[^>]*alt="([^"]*)"[^>]*>', r" \$$1\$ ")
    return F.regexp_replace(s, r"(?is)<math.*?</math>", " ")


def longest(*texts: Column) -> Column:
    """The longest of a few texts; the first wins ties."""
    best = F.array_sort(F.array(*[F.struct((-F.length(t)).alias("n"), F.lit(i).alias("i"), t.alias("t")) for i, t in enumerate(texts)]))
    return F.get(best, F.lit(0))["t"]


def page_chunks(pages: DataFrame, chars: int = 12_000, most: int = 20) -> DataFrame:
    """(page_id, url, para, piece, content) of whole pages: the longest of linked data, description and body,
    its first `chars` characters and `most` paragraphs (a feature: pages are excerpted for the index)."""
    body = html_text(inline_math(F.col("html")))
    text = F.substring(longest(json_ld_text(F.col("html")), meta_description(F.col("html")), body), 1, chars)
    paras = pages.select("page_id", "url", text.alias("text")).select("page_id", "url", F.posexplode(F.slice(paragraphs(F.col("text")), 1, most)).alias("para", "p"))
    return paras.select("page_id", "url", "para", F.posexplode(recursive_split(F.col("p"))).alias("piece", "content"))


def identifiers(url: Column) -> Column:
    """struct of the ids that a link may hold."""
    return F.struct(first_group(url, DRIVE_ID).alias("drive"), first_group(url, ORCID_ID).alias("orcid"), first_group(url, VIDEO_ID).alias("video"), first_group(url, CODING_USER).alias("coder"), F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1).alias("last"))


def with_retries(fetch, attempts: int = 2, retry_on: tuple[int, ...] = (429, 503), wait: float = 2.0):
    """A fetch(url) -> (status, body) that tries again after the given statuses; any other failure gives no body."""
    import time

    def run(url: str):
        for k in range(attempts):
            status, body = fetch(url)
            if status == 200:
                return body
            if status not in retry_on or k == attempts - 1:
                return None
            time.sleep(wait)

    return run


