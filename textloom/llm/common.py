"""What the corpus operators share: reading columns, array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import let
from textloom.scratch import Scratch, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) and nothing else; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most `most` of them."""
    return F.broadcast(df) if df.count() <= most else df


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in ids (a written table)."""
    gone = ids.select(F.col("doc_id").alias("_gone"))
    return docs.join(few(gone), docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("int"), lambda a, x: a + x)


def running_starts(lengths: Column, block: int = 256) -> Column:
    """For an array of ints the sum of all elements before each one.

    Sums inside blocks plus block offsets, so an array of n costs n * block steps, not n * n.
    """

    def offsets(sums: Column) -> Column:
        return F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))

    def within(offs: Column) -> Column:
        def at(_, i):
            b = F.floor(i / F.lit(block)).cast("int")
            return F.get(offs, b) + total(F.slice(lengths, b * block + 1, i - b * block))

        return F.transform(lengths, at)

    n_blocks = F.ceil(F.size(lengths) / F.lit(block)).cast("int")
    sums = F.transform(F.sequence(F.lit(0), F.greatest(n_blocks, F.lit(1)) - 1), lambda b: total(F.slice(lengths, b * block + 1, F.lit(block))))
    return let(sums, lambda s: let(offsets(s), within))


SPAN = "array<struct<s:int,k:int,e:int,m:string>>"


def find_spans(text: Column, kind: int, pattern: str, keep=None) -> Column:
    """All matches of a pattern as (start, kind, end, match), code points, end exclusive.

    The texts between the matches give the positions, so no Python is needed.
    """
    none = F.array().cast(SPAN)

    def located(found: Column) -> Column:
        def placed(between: Column) -> Column:
            lengths = F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.length(m))
            return let(lengths, lambda n: let(running_starts(n), lambda starts: F.transform(found, lambda m, i: let(F.get(starts, i) + F.length(F.get(between, i)), lambda s: F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + F.length(m)).alias("e"), m.alias("m"))))))

        return let(F.split(text, pattern, -1), placed)

    hits = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(located(m)))
    return F.filter(hits, lambda x: keep(x["m"])) if keep else hits


def spans_text(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
