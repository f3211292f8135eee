"""Structure of web pages: anchors, skill cells, the walk over headings, lines and links, and links by address.

A page is parsed once, where it is read; what follows are DataFrame rules over its elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import anchor_label

# Elements that go with all they hold, elements whose id names a section, elements that become lines.
DROPPED = ("script", "style", "nav", "svg")
CONTAINERS = ("section", "footer", "header", "main", "article")
HEADINGS = ("h1", "h2", "h3", "h4")
BLOCKS = ("p", "li")
DEFAULT_ANCHOR, DEFAULT_TITLE = "#about", "About"
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))

ELEMENT = "ord int, tag string, text string, anchor string, href string, in_block boolean"


class Walk(HTMLParser):
    """Collects (ord, tag, text, anchor, href, in_block) of headings, lines and links, and of skill cells (tag "skill").

    Open elements are a stack; a text goes to every open element that is collected. anchor is that of
    the nearest open container with an id, or null; the first such id of the page is `first`.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str | None, dict | None]] = []
        self.out: list[dict] = []
        self.first: str | None = None
        self.dropped = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a = dict(attrs)
        if tag in DROPPED:
            self.dropped += 1
        classes = (a.get("class") or "").split()
        found, here = None, f"#{a['id']}" if tag in CONTAINERS and a.get("id") else None
        if not self.dropped:
            self.first = self.first or here
            kind = tag if tag in (*HEADINGS, *BLOCKS, "a") else "skill" if "skill-cell" in classes else "category" if "st" in classes else "tags" if "tags" in classes else "tag" if tag == "span" else None
            inside = [k for _, _, e in self.stack if e for k in [e["tag"]]]
            if kind in ("category", "tags") and "skill" not in inside or kind == "tag" and not {"skill", "tags"} <= set(inside):
                kind = None
            if kind:
                found = {"tag": kind, "texts": [], "anchor": here or next((x for _, x, _ in reversed(self.stack) if x), None), "href": a.get("href") if tag == "a" else None, "in_block": any(k in BLOCKS for k in inside), "parent": next((e for _, _, e in reversed(self.stack) if e and e["tag"] == "skill"), None)}
                self.out.append(found)
        self.stack.append((tag, here, found))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None:
            self.dropped -= sum(t in DROPPED for t, _, _ in self.stack[at:])
            del self.stack[at:]

    def handle_data(self, data):
        text = data.strip()
        if text and not self.dropped:
            for _, _, e in self.stack:
                if e:
                    e["texts"].append(text)

    def elements(self, blanks: bool = False) -> list[tuple]:
        rows = []
        for e in self.out:
            text = " ".join(e["texts"])
            if e["tag"] == "skill":
                part = lambda kind, e=e: [" ".join(x["texts"]) for x in self.out if x["parent"] is e and x["tag"] == kind]
                tags = part("tag")
                text = f"{(part('category') or [''])[0]}: {', '.join(tags)}" if tags else ""
            if text and e["tag"] in (*HEADINGS, *BLOCKS, "a", "skill") or blanks and e["tag"] in HEADINGS:
                rows.append((e["tag"], text, e["anchor"] or self.first or DEFAULT_ANCHOR, e["href"], e["in_block"]))
        rows.sort(key=lambda r: r[0] != "skill")  # skill cells lead
        return [(i, *r) for i, r in enumerate(rows)]


def elements(pages: DataFrame, references: tuple[str, ...] | None = None, blanks: bool = False) -> DataFrame:
    """(page_id, ord, tag, text, anchor, href, in_block) of every page, in document order after its skill cells. One scan, no shuffle.

    references: the only character references to decode, closed by a semicolon; all others stay as they stand, as do
    those that are cut off. By default all are decoded as browsers do, cut off or not. blanks keeps headings without text.
    """
    other = re.compile(f"&(?!(?:{'|'.join(map(re.escape, references))});)") if references else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                walk = Walk()
                text = html.as_py() or ""
                walk.feed(other.sub("&amp;", text) if other else text)
                walk.close()
                rows += [(page, *e) for e in walk.elements(blanks)]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "ord", "tag", "text", "anchor", "href", "in_block"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, " + ELEMENT)


def tagged_lines(found: DataFrame) -> DataFrame:
    """(page_id, ord, line): headings and tagged lines of elements(); a bare link is a line if no block holds it. Repeats on a page go."""
    section = F.coalesce(anchor_label(F.col("anchor")), F.lit(DEFAULT_TITLE))
    head = F.col("tag").isin(*HEADINGS)
    line = F.when(head, F.concat(F.lit("\n## ["), section, F.lit("] "), "text", F.lit("\n"))).otherwise(F.concat(F.lit("["), section, F.lit("]("), "anchor", F.lit(") "), "text"))
    kept = found.where((F.col("tag") != "a") | ~F.col("in_block")).select("page_id", "ord", line.alias("line"))
    return kept.groupBy("page_id", "line").agg(F.min("ord").alias("ord")).select("page_id", "ord", "line")


def external_links(found: DataFrame, site: str) -> DataFrame:
    """(page_id, n, url, label, section, anchor): links that start with http and don't hold the site's address, each address once."""
    return last_of_each(found.where((F.col("tag") == "a") & F.startswith("href", F.lit("http")) & ~F.contains("href", F.lit(site))))


def last_of_each(links: DataFrame) -> DataFrame:
    """(page_id, n, url, label, section, anchor) of (page_id, ord, href, text, anchor): each address of a page stands where it came first, with the values of its last link."""
    last = F.max_by(F.struct("text", "anchor"), "ord")
    one = links.groupBy("page_id", F.col("href").alias("url")).agg(F.min("ord").alias("first"), last.alias("x"))
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("first"))
    return one.select("page_id", n.alias("n"), "url", F.col("x.text").alias("label"), F.coalesce(anchor_label(F.col("x.anchor")), F.lit(DEFAULT_TITLE)).alias("section"), F.col("x.anchor").alias("anchor"))


def page_markdown(found: DataFrame, title: str) -> DataFrame:
    """(page_id, markdown) of each page: the title and its lines in order. A page's lines meet in one row."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return tagged_lines(found).groupBy("page_id").agg(F.concat_ws("\n", F.lit(title), F.transform(listed, lambda x: x["line"])).alias("markdown"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page_id, changed) of pages in either (page_id, markdown): whether the text differs but for white space at its ends."""
    a, b = (df.select("page_id", F.sha2(F.trim(F.regexp_replace("markdown", r"^\s+|\s+$", "")), 256).alias(n)) for df, n in ((before, "a"), (after, "b")))
    return a.join(b, "page_id", "full").select("page_id", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
