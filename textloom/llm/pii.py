"""Personal data: fixed patterns, then identifiers found by the contexts in which those stand.

Base spans come from four patterns. They seed the bootstrapping: the two words before a base span, and
the two words after it, form lexical patterns, all identifier-like strings in the corpus that stand
beside a pattern are its instances, and scores pass between patterns and instances for a few rounds.
Identifiers that no base pattern matches are reported where a high-confidence pattern stands beside them.

Only DataFrame functions; texts are never split into rows except around identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, find_spans, let, spans_text, texts

BASE = ["email", "ip", "card", "phone"]
#: Spans found by context carry the kind of their pattern.
KINDS = BASE + [f"context_{k}" for k in BASE]

# The same matches as the plain patterns, written so that long runs cost linear time: a match can only
# start where its run of characters starts (or where the last match ended), and loops are possessive.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An identifier-like string: a local part with its host, groups of digits, or a run with a digit in it.
CANDIDATE = r"(?<![A-Za-z0-9@._+/-])(?:[A-Za-z0-9._+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*+|[+(]?[0-9][0-9().-]*(?:\x20[(0-9][0-9().-]*)+(?<=[0-9])|(?=[A-Za-z@._+/-]*+[0-9])[A-Za-z0-9@._+/-]{4,}+)"
OCTET = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
#: Code points before or after a span in which its two context words must stand.
REACH = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def add(acc: Column, i: Column, d: Column, n: Column) -> Column:
        v = F.substring(d, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + v - F.when(v > 9, 9).otherwise(0)

    def valid(d: Column) -> Column:
        n = F.length(d)
        return F.when(n.between(14, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: add(acc, i, d, n)) % 10 == 0).otherwise(False)

    return let(_digits(m), valid)


def base_spans(text: Column) -> Column:
    """Valid matches of the four patterns, by start and then kind; a failing match is dropped, not retried."""
    email = find_spans(text, 0, EMAIL)
    ip = find_spans(text, 1, IP, lambda m: F.forall(F.split(m, r"\."), lambda x: x.rlike(OCTET)))
    card = find_spans(text, 2, CARD, _luhn)
    phone = find_spans(text, 3, PHONE, lambda m: F.length(_digits(m)).between(10, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def _contexts(text: Column, start: Column, end: Column) -> Column:
    """The patterns beside a span: the two words before it and the two after it, lower-cased and with digits as 0, if there are two."""
    plain = lambda x: F.regexp_replace(F.lower(x), "[0-9]", "0")
    before = F.regexp_extract(plain(F.substring(text, F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH)))), r"(?:^|\s)(\S+\s+\S+)\s+$", 1)
    after = F.regexp_extract(plain(F.substring(text, end + 1, F.lit(REACH))), r"^\s+(\S+\s+\S+)(?:\s|$)", 1)
    named = lambda side, x: F.concat(F.lit(side), F.regexp_replace(x, r"\s+", " "))
    return F.filter(F.array(named("<", before), named(">", after)), lambda x: F.length(x) > 1)


def find_personal_data(docs: DataFrame, rounds: int = 3, support: int = 5, purity: float = 0.9, confidence: float = 0.8) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    A pattern needs `support` distinct seed strings, `purity` of them of one kind, and a confidence:
    the summed scores of its instances over all places in the corpus where its words stand, whatever
    follows. Seeds score 1; another identifier scores 1 - prod(1 - confidence of its patterns).
    Null and empty texts have no spans. Rows that repeat id and text get the same spans.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    body = texts(docs)
    base = body.withColumn("base", base_spans(F.col("text")))

    around = base.withColumn("found", find_spans(F.col("text"), len(BASE), CANDIDATE)).select(
        "doc_id",
        F.xxhash64("text").alias("h"),
        F.transform("base", lambda x: F.struct(x["s"], x["k"], x["e"])).alias("base"),
        F.transform(F.concat("base", "found"), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.xxhash64(F.lower(x["m"])).alias("v"), _contexts(F.col("text"), x["s"], x["e"]).alias("cs"))).alias("near"),
    )
    around = scratch.save(around, "around")
    spots = around.where(F.size("near") > 0).select("doc_id", "h", F.inline("near")).distinct()
    beside = spots.withColumn("c", F.explode("cs")).drop("cs")
    # an identifier that overlaps a base span of its text is no discovery
    base_only = spots.where(f"k < {len(BASE)}")
    seeds = beside.where(f"k < {len(BASE)}").groupBy("c", "k").agg(F.count_distinct("v").alias("n"))
    kinds = seeds.groupBy("c").agg(F.sum("n").alias("n"), F.max(F.struct("n", "k")).alias("best"))
    patterns = kinds.where((F.col("n") >= support) & (F.col("best.n") >= purity * F.col("n"))).select("c", F.col("best.k").alias("kind"))
    patterns = scratch.save(patterns.withColumn("p", F.xxhash64(F.expr("substring(c, 2)"))), "patterns")
    found = None
    if patterns.take(1):
        uses = _uses(body, patterns)
        graph = patterns.join(uses, "p").join(beside, "c").select("doc_id", "h", "s", "e", "k", "v", "c", "kind", "uses")
        graph = scratch.save(graph, "graph")
        edges = scratch.save(graph.groupBy("c", "kind", "uses", "v").agg(F.count("*").alias("n"), F.max((F.col("k") < len(BASE)).cast("double")).alias("seed")), "edges")
        scores = edges.groupBy("v").agg(F.max("seed").alias("score"))
        for k in range(rounds):
            conf = edges.join(scores, "v").groupBy("c", "kind").agg(F.least(F.lit(1.0), F.sum(F.col("score") * F.col("n")) / F.max("uses")).alias("conf"))
            conf = scratch.save(conf, f"conf{k}")
            raised = edges.join(conf.select("c", "conf"), "c").groupBy("v").agg(F.max("seed").alias("seed"), (1 - F.product(1 - F.col("conf"))).alias("raised"))
            scores = scratch.save(raised.select("v", F.greatest("seed", "raised").alias("score")), f"scores{k}")
        strong = conf.where(F.col("conf") >= confidence).select("c", "conf")
        found = graph.where(f"k = {len(BASE)}").join(strong, "c").join(scores.where(F.col("score") >= confidence), "v").select("doc_id", "h", "s", "e", (F.col("kind") + len(BASE)).alias("k")).distinct()
        found = found.alias("f").join(base_only.alias("b"), F.expr("f.doc_id <=> b.doc_id and f.h = b.h and f.s < b.e and b.s < f.e"), "left_anti")
        found = found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "k", "e")).alias("more"))
        out = around.alias("a").join(found.alias("f"), F.expr("a.doc_id <=> f.doc_id and a.h = f.h"), "left").select("a.doc_id", "a.base", F.coalesce("f.more", F.array().cast("array<struct<s:int,k:int,e:int>>")).alias("more"))
    else:
        out = around.select("doc_id", "base", F.array().cast("array<struct<s:int,k:int,e:int>>").alias("more"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(spans_text(F.col("base"), BASE), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", "more")), KINDS).alias("spans"),
    )


def _uses(body: DataFrame, patterns: DataFrame) -> DataFrame:
    """(p, uses): in how many places of the whole corpus the two words of each pattern stand, p their hash.

    One pass over the texts. Hashes of few patterns are broadcast; those of many meet the pairs, which
    are counted first, by a shuffle.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower(F.col("text")), "[0-9]", "0"), r"\s+"), lambda x: x != "")
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1))))
    pairs = body.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(hashes).alias("p"))
    wanted = patterns.select("p").distinct()
    if wanted.count() <= 1_000_000:
        pairs = pairs.join(F.broadcast(wanted), "p")
    return pairs.groupBy("p").agg(F.count("*").alias("uses")).join(wanted, "p")
