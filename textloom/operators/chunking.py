"""Text splitters: one row in, its pieces as an array or as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.config import DEFAULT
from textloom.functions.text import is_section_header, let, split_lines, strip

# Separators in the order in which they are tried.
SEPARATORS = ["\n\n", "\n", ". ", " "]


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")


def fixed_windows(text: Column, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap) -> Column:
    """Windows of `size` characters at a stride of size - overlap; the short last ones stay."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def with_tails(pieces: Column, overlap: int) -> Column:
    """Every piece but the first is led by the end of the piece before it."""
    return let(pieces, lambda ps: F.transform(ps, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.right(F.get(ps, i - 1), F.lit(overlap)), F.lit(" "), p))))


def _packed(text: Column, sep: str, size: int) -> Column:
    """Parts between separators, joined greedily while they fit."""
    state = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, part: Column) -> Column:
        joined = F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit(sep), part)).otherwise(part)
        fits = F.length(joined) <= size
        done = F.when(fits | (acc["cur"] == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(strip(acc["cur"]))))
        return F.struct(F.when(fits, joined).otherwise(part).alias("cur"), done.alias("out"))

    return F.aggregate(F.split(text, f"\\Q{sep}\\E", -1), state, add, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(strip(a["cur"])))).otherwise(a["out"]))


def recursive_split(text: Column, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap) -> Column:
    """Chunks of about `size` characters: the first separator that splits the text is the only one used,
    and a part that is too long is a chunk by itself. Short texts stay whole; blank chunks go."""
    out = F.when(F.length(text) <= size, F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(F.array(text)))
    for sep in SEPARATORS:
        out = out.when(F.contains(text, F.lit(sep)), F.filter(with_tails(_packed(text, sep, size), overlap), lambda p: strip(p) != ""))
    return out.otherwise(F.filter(fixed_windows(text, size, overlap), lambda p: strip(p) != ""))


def sections(docs: DataFrame, key: str, text: str, header: str = "heading", default: str = "Overview") -> DataFrame:
    """(key, section_no, heading, body): lines grouped under the heading above them; empty bodies go.

    header "heading" takes lines that start with #, "title" lines that look like section headers.
    """
    lines = docs.select(key, F.posexplode(split_lines(F.col(text))).alias("ord", "line"))
    is_head = F.startswith(strip(F.col("line")), F.lit("#")) if header == "heading" else is_section_header(F.col("line"))
    name = strip(F.regexp_replace(strip(F.col("line")), "^[# ]+|[# ]+$", "")) if header == "heading" else strip(F.col("line"))
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("head", F.coalesce(is_head, F.lit(False))).withColumn("name", F.when(F.col("head"), name))
    marked = marked.withColumn("section_no", F.sum(F.col("head").cast("int")).over(w)).withColumn("heading", F.coalesce(F.last("name", ignorenulls=True).over(w), F.lit(default)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return marked.where(~F.col("head")).groupBy(key, "section_no", "heading").agg(strip(body).alias("body")).where("body != ''")


def tagged_lines(lines: DataFrame, site: str = "") -> DataFrame:
    """(section, anchor, heading, content, url) from (ord, line) rows of a tagged markdown file."""
    head = r"^##\s*\[(.+?)\]\s*(.*)$"
    tag = r"^\[(.+?)\]\((#[^)]*)\)\s*(.*)$"
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)  # one file of lines
    rows = lines.withColumn("h", F.col("line").rlike(head))
    rows = rows.withColumn("heading", F.last(F.when(F.col("h"), F.regexp_extract("line", head, 2)), ignorenulls=True).over(w))
    rows = rows.where(~F.col("h") & F.col("line").rlike(tag)).select("ord", F.coalesce("heading", F.lit("")).alias("heading"), F.regexp_extract("line", tag, 1).alias("section"), F.regexp_extract("line", tag, 2).alias("anchor"), F.regexp_extract("line", tag, 3).alias("t"))
    out = rows.groupBy("section", "anchor", "heading").agg(F.min("ord").alias("ord"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), " ").alias("body"))
    content = F.when((F.col("heading") != "") & (F.col("heading") != F.col("section")), F.concat("heading", F.lit(": "), "body")).otherwise(F.col("body"))
    return out.select("ord", "section", "anchor", "heading", content.alias("content"), F.concat(F.lit(site), "anchor").alias("url"))
