"""Project tags: the project whose keywords share most words with a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.config import DEFAULT
from textloom.functions.text import STOP_WORDS, tokens


def keyword_sets(projects: DataFrame) -> DataFrame:
    """(project, ord, keywords) from (project, ord, words): distinct words of over two characters that are no stop-words."""
    words = F.filter(F.array_distinct(tokens(F.col("words"))), lambda w: F.length(w) > 2)
    return projects.select("project", "ord", F.array_except(words, F.array(*map(F.lit, STOP_WORDS))).alias("keywords"))


def tag(docs: DataFrame, sets: DataFrame, key: str, text: str, least: int = DEFAULT.tag_min_overlap) -> DataFrame:
    """(key, project, overlap): the largest overlap of at least `least` words, ties to the first project."""
    have = docs.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("w"))
    want = sets.select("project", "ord", F.explode("keywords").alias("w"))
    met = have.join(want, "w").groupBy(key, "project", "ord").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least)
    best = met.groupBy(key).agg(F.min(F.struct((-F.col("overlap")).alias("o"), "ord", "project")).alias("b"))
    return best.select(key, F.col("b.project").alias("project"), (-F.col("b.o")).alias("overlap"))
