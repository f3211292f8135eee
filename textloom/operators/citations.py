"""Citations and prompt context of a retrieval result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import display_label, url_key


def deduplicate(rows: DataFrame, key: str = "query_id", order: str = "final_rank") -> DataFrame:
    """(key, citations) from rows (key, order, url, label): in order, a citation stays unless its URL key
    or its lower-cased label is that of one that stays. A dropped citation blocks nothing."""
    item = F.struct(F.col(order).alias("o"), F.col("url").alias("url"), F.col("label").alias("label"), url_key(F.col("url")).alias("u"), F.lower(F.trim(F.coalesce("label", F.lit("")))).alias("l"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))  # one result's few chunks
    kind = "array<struct<o:int,url:string,label:string,u:string,l:string>>"

    def add(kept: Column, x: Column) -> Column:
        seen = F.exists(kept, lambda k: (k["u"] == x["u"]) | (k["l"] == x["l"]))
        return F.when(seen, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(F.col("items").cast(kind), F.array().cast(kind), add)
    return listed.select(key, F.transform(kept, lambda x: F.struct(x["label"].alias("label"), x["url"].alias("url"))).alias("citations"))


def context(rows: DataFrame, key: str = "query_id", order: str = "final_rank") -> DataFrame:
    """(key, context): numbered blocks with label, source and content, joined by blank lines."""
    label = display_label(F.col("source"), F.col("anchor"), F.col("section"), F.col("title"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), label.alias("label"), "source", "content"))).alias("items"))
    block = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Section: "), x["label"], F.lit(" | Source: "), x["source"], F.lit("\n"), x["content"])
    return listed.select(key, F.array_join(F.transform("items", block), "\n\n").alias("context"))


# What a prompt and an answer say without context.
NO_CONTEXT = "(no relevant context found)"
DECLINE = "I don't have information about that in the indexed documents."


def answer(queries: DataFrame, contexts: DataFrame, generate=None) -> DataFrame:
    """(query_id, answer): generate maps a prompt column to a text column; without context the answer is a fixed decline."""
    generate = generate or (lambda prompt: F.concat(F.lit("stub: "), F.substring(prompt, 1, 200)))
    rows = queries.join(contexts, "query_id", "left")
    prompt = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit(NO_CONTEXT)), F.lit("\n\nQuestion: "), "q_text")
    return rows.select("query_id", F.when(F.col("context").isNull(), DECLINE).otherwise(generate(prompt)).alias("answer"))


def small_talk_prompt(message: Column, now: Column) -> Column:
    """What a generator gets for small talk: the time it may tell, and the message."""
    return F.concat(F.lit("CURRENT_DATETIME: "), now, F.lit("\n\nMESSAGE: "), message)


def small_talk_reply(messages: DataFrame, now: Column, generate=None) -> DataFrame:
    """messages with the column reply: generate maps the prompt to a text. No context is searched."""
    generate = generate or (lambda prompt: F.concat(F.lit("stub: "), F.substring(prompt, 1, 200)))
    return messages.withColumn("reply", generate(small_talk_prompt(F.col("text"), now)))
