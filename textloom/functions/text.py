"""Column functions over text: every one stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.config import DEFAULT

# Patterns that decide results.
GREETING = r"^\s*(hi|hello+|hey+|yo|sup|good\s*(morning|afternoon|evening|night))\b(?!-)"
FAREWELL = r"^\s*(bye+|goodbye|see\s*(you|ya)|take\s*care|catch\s*you\s*later)\b"
THANKS = r"^\s*(thanks|thank\s*you|thx|ty|cheers|appreciate\s*it)\b"
HOW_ARE_YOU = r"how\s*(are|r)\s*(you|u|ya)\b"
DATE_TIME = r"(what.?s|what\s+is)\s+(the\s+)?(current\s+)?(date|day|time)\b|current\s+(date|time)\b|today.?s\s+date\b|what\s+time\s+is\s+it\b"
SMALL_TALK = [GREETING, FAREWELL, THANKS, HOW_ARE_YOU, DATE_TIME]
BOILERPLATE = [
    r"corresponding author", r"contributed equally", r"\borcid\b", r"\d{4}-\d{4}-\d{4}-\d{3}[\dXx]", r"©|copyright",
    r"ceur-ws\.org", r"\bissn\b", r"\bdoi\s*:", r"[\w.+-]+@[\w-]+\.[\w.-]+", r"this work is licen",
]
STOP_WORDS = ["the", "and", "for", "with", "using", "app", "api", "system", "project", "based", "a", "an", "of", "to", "in", "on", "this", "that", "is", "are"]
LABEL_BUCKETS = [
    ("Education", ["educat"]), ("Experience", ["experien", "intern"]), ("Projects", ["project", "garage"]), ("Skills", ["skill", "tech stack"]),
    ("Research", ["research", "public", "paper", "wind tunnel"]), ("Certifications", ["certif"]), ("Interests", ["interest", "beyond", "hobb", "off track"]), ("Contact", ["contact", "debrief"]),
]
DRIVE_ID = [r"/d/([a-zA-Z0-9_-]+)", r"[?&]id=([a-zA-Z0-9_-]+)"]
ORCID_ID = [r"orcid\.org/(\d{4}-\d{4}-\d{4}-\d{3}[\dXx])"]
VIDEO_ID = [r"[?&]v=([a-zA-Z0-9_-]{11})", r"youtu\.be/([a-zA-Z0-9_-]{11})"]
CODING_USER = [r"leetcode\.com/u/([^/]+)/?", r"leetcode\.com/([^/]+)/?$"]


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def split_lines(x: Column) -> Column:
    parts = F.split(x, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)


def tokens(x: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def sentences(x: Column) -> Column:
    return F.split(strip(x), r"(?<=[.!?])\s+")


def small_talk(message: Column, most_words: int = DEFAULT.small_talk_words) -> Column:
    s = strip(message)
    hit = reduce(lambda a, b: a | b, [s.rlike(f"(?i){p}") for p in SMALL_TALK])
    return (s != "") & (F.size(F.split(s, r"\s+")) <= most_words) & hit


def is_boilerplate(line: Column, shorter_than: int = DEFAULT.boilerplate_max) -> Column:
    s = strip(line)
    hit = reduce(lambda a, b: a | b, [s.rlike(f"(?i){p}") for p in BOILERPLATE])
    return (s != "") & (F.length(s) < shorter_than) & hit


def strip_boilerplate(text: Column) -> Column:
    """The text's lines less the boilerplate ones; blank lines stay."""
    return F.array_join(F.filter(split_lines(text), lambda line: ~is_boilerplate(line)), "\n")


def is_section_header(line: Column) -> Column:
    """3 to 40 characters, no closing punctuation, colon or comma, and all capitals or up to four capitalised words."""
    s = strip(line)
    alpha = F.filter(F.split(s, r"\s+"), lambda w: w.rlike(r"^\p{L}+$"))
    shape = F.length(s).between(3, 40) & ~s.rlike(r"[.,;]$") & ~F.contains(s, F.lit(":")) & ~F.contains(s, F.lit(","))
    capitals = (s == F.upper(s)) & (s != F.lower(s))
    titled = (F.size(alpha) <= 4) & F.forall(alpha, lambda w: w.rlike(r"^\p{Lu}"))
    return F.coalesce(shape & (F.size(alpha) > 0) & (capitals | titled), F.lit(False))


def first_group(x: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in patterns])


def title_case(x: Column) -> Column:
    """Every run of letters capitalised, also after digits and apostrophes."""
    parts = F.regexp_extract_all(x, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def anchor_label(anchor: Column) -> Column:
    return title_case(F.nullif(strip(F.regexp_replace(F.regexp_replace(anchor, "^#+", ""), "[-_]", " ")), F.lit("")))


def free_text_label(text: Column) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for label, parts in LABEL_BUCKETS:
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.coalesce(F.nullif(text, F.lit("")), F.lit("General")))


def display_label(source: Column, anchor: Column, section: Column, title: Column) -> Column:
    repo = source.isin("github_repo", "github_readme") & (F.coalesce(title, F.lit("")) != "")
    return F.when(repo, F.concat(F.lit("Projects — "), title)).otherwise(F.coalesce(anchor_label(anchor), free_text_label(section)))


def url_key(url: Column) -> Column:
    """Host without a leading www., and path without closing slashes, in lower case; scheme, query and fragment dropped."""
    s = strip(F.coalesce(url, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(s, r"#.*$", ""), r"\?.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?", "")
    return F.concat(host, F.lower(F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), "/+$", "")))


def route(url: Column, own_paper: str = "", own_user: str = "", own_file: str = "") -> Column:
    """Which connector a link goes to; the first arm that fits wins, and null drops the link."""
    has = lambda p: F.contains(url, F.lit(p))
    return (
        F.when(~F.startswith(url, F.lit("http")), None)
        .when(has("chess.com/member/"), "chess")
        .when(has("orcid.org/"), "orcid")
        .when(has("youtube.com/watch") | has("youtu.be/"), "video")
        .when(has("linkedin.com/"), "static")
        .when(has("leetcode.com/"), "coding")
        .when(url == own_paper, None)
        .when(url.rlike(r"^https?://github\.com/[^/]+/?$"), None)
        .when(url.rlike(rf"^https?://github\.com/{own_user}/[^/]+/?$") if own_user else F.lit(False), None)
        .when(has("drive.google.com") & first_group(url, DRIVE_ID).eqNullSafe(F.lit(own_file)), None)
        .when(has("drive.google.com"), "drive")
        .otherwise("page")
    )


def html_text(html: Column) -> Column:
    """Text of a page: dropped elements go with their content, tags and comments become spaces."""
    s = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "header", "footer", "aside", "form"):
        s = F.regexp_replace(s, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
