"""Repeated runs of lines, found with suffix ranks over line-ID sequences.

Lines that occur once end every run, so only chains of repeated lines that are long enough go on.
Prefix doubling ranks their suffixes: the rank by the first 2^(k+1) lines is the order of the pairs of
ranks by 2^k lines. Suffixes with equal ranks over a stretch form a longest-common-prefix interval; in
each interval all but the first stretch of the corpus are later copies, and their lines are deleted.

Each line of a chain has at least one word, so a stretch with `least` words has at most `least` lines,
and the shortest stretches that start or end at each line cover every maximal repeated run that has
`least` words. So log2(least) doublings are enough, however long the runs are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import Scratch, few

#: Most keys that are joined by broadcast for their number of rows: one has over a 100,000th of all rows.
HOT = 100_000


def words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def numbered(keys: DataFrame, on: list[str], scratch: Scratch, step: str) -> DataFrame:
    """(on, n, rank): the place of each row of distinct keys in sorted order, by range partitions and offsets."""
    parts = scratch.save(keys.repartitionByRange(*on).withColumn("part", F.spark_partition_id()), f"{step}_parts")
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))  # a row for each partition
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*on))
    out = scratch.save(parts.withColumn("place", place).join(F.broadcast(before), "part").select(*on, "n", (F.col("before") + F.col("place")).alias("rank")), step)
    scratch.drop(f"{step}_parts")
    return out


def with_ranks(rows: DataFrame, ranks: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows with the column rank of ranks (on, n, rank), null without one; n is how many of the `total` rows have the key.

    The at most HOT keys with over total / HOT rows are broadcast, so the rows of a hot key stay where
    they are; what is shuffled has no key with more rows than that.
    """
    cut = total // HOT
    hot = ranks.where(F.col("n") > cut).select(*on, F.col("rank").alias("_hot"))
    met = rows.join(F.broadcast(hot), on, "left")
    if cut < 1:
        return met.withColumnRenamed("_hot", "rank")
    cold = ranks.where(F.col("n") <= cut).select(*on, "rank")
    none = F.expr(" or ".join(f"{c} is null" for c in on))  # rows without a key don't go to one task either
    here = met.where(F.col("_hot").isNotNull() | none).withColumnRenamed("_hot", "rank")
    return here.unionByName(met.where(F.col("_hot").isNull() & ~none).drop("_hot").join(cold, on, "left"))


def suffix_ranks(chains: DataFrame, scratch: Scratch, levels: int) -> DataFrame:
    """Adds ranks, an array: element k ranks the suffix at (doc, chain, q) by its first 2^k lines; null past a chain's end."""
    w = Window.partitionBy("doc_id", "t", "chain").orderBy("q")
    level, total = chains.withColumn("ranks", F.array(F.col("line"))), chains.count()
    for k in range(levels):
        pairs = scratch.save(level.withColumn("r", F.get("ranks", F.lit(k))).withColumn("s", F.lead("r", 1 << k).over(w)), f"pairs{k}")
        full = pairs.where("r is not null and s is not null").groupBy("r", "s").agg(F.count("*").alias("n"))
        ranks = numbered(full, ["r", "s"], scratch, f"keys{k}")
        level = with_ranks(pairs, ranks, ["r", "s"], total).withColumn("ranks", F.concat("ranks", F.array("rank"))).drop("r", "s", "rank")
        level = scratch.save(level, f"ranks{k}")
        for old in (f"pairs{k}", f"keys{k}", *[f"ranks{k - 1}"] * bool(k)):
            scratch.drop(old)
    return level


def _body(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, t, t2): rows packed into one column, so that no name of theirs can clash; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]) if len(docs.columns) > 1 else F.struct(F.lit(0).alias("_"))
    return docs.select(packed.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"t": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def repeated_texts(body: DataFrame, scratch: Scratch) -> DataFrame:
    """(t, t2, first) of each text that several rows have: its smallest doc_id (null is the smallest)."""
    low = F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id"))["doc_id"]
    return scratch.save(body.groupBy("t", "t2").agg(low.alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")


def repeated_lines(body: DataFrame, copies: DataFrame, scratch: Scratch, least: int = 50) -> DataFrame:
    """(doc_id, t, dead): the line numbers to delete in the first row of each distinct text t."""
    line = F.split("text", "\n")
    filled = F.filter(F.transform(line, lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("h2"), words(x).alias("w"))), lambda x: x["w"] > 0)
    firsts = body.drop("row").join(few(copies.withColumn("copied", F.lit(True))), ["t", "t2"], "left").where("copied is null or doc_id <=> first")
    lines = firsts.select("doc_id", "t", F.posexplode(filled).alias("q", "x")).select("doc_id", "t", "q", "x.pos", "x.h", "x.h2", "x.w")
    lines = scratch.save(lines, "lines")
    counted = lines.groupBy("h", "h2").agg(F.count("*").alias("n"))
    common = numbered(counted.where("n > 1"), ["h", "h2"], scratch, "common")
    again = with_ranks(lines, common, ["h", "h2"], lines.count()).where("rank is not null").select("doc_id", "t", "q", "pos", "w", F.col("rank").alias("line")).dropDuplicates(["doc_id", "t", "q"])
    by_doc = Window.partitionBy("doc_id", "t").orderBy("q")
    chained = again.withColumn("chain", F.col("q") - F.row_number().over(by_doc)).withColumn("cw", F.sum("w").over(Window.partitionBy("doc_id", "t", "chain")))
    chains = scratch.save(chained.where(F.col("cw") >= least).drop("cw"), "chains")
    scratch.drop("lines")
    ranked = suffix_ranks(chains, scratch, max(1, (least - 1).bit_length() - 1 if least > 1 else 1))
    near = Window.partitionBy("doc_id", "t", "chain").orderBy("q")
    ahead = F.collect_list("w").over(near.rowsBetween(0, least - 1))
    behind = F.reverse(F.collect_list("w").over(near.rowsBetween(-(least - 1), 0)))

    def shortest(ws: Column) -> Column:
        """How many of the words' lines reach `least`; null if all together don't."""
        acc = F.aggregate(ws, F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum")), lambda a, x: F.when(a["sum"] >= least, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["sum"] + x).alias("sum"))))
        return F.when(acc["sum"] >= least, acc["n"])

    sized = ranked.withColumn("ahead", ahead).withColumn("behind", behind).withColumn("m", F.array(shortest(F.col("ahead")), shortest(F.col("behind"))))
    spans = sized.select("doc_id", "t", "chain", "q", F.posexplode("m").alias("back", "m")).where("m is not null")
    spans = spans.select("doc_id", "t", "chain", F.when(F.col("back") == 1, F.col("q") - F.col("m") + 1).otherwise(F.col("q")).alias("q"), "m").distinct()
    spans = spans.withColumn("k", F.floor(F.log2(F.col("m").cast("double")) + 1e-9).cast("int"))
    at = ranked.select("doc_id", "t", "chain", "q", "ranks")
    here = lambda df: df.withColumn("doc_id", F.struct("doc_id"))  # noqa: E731  a struct of null equals itself
    head = here(spans).join(here(at), ["doc_id", "t", "chain", "q"]).withColumn("a", F.get("ranks", F.col("k"))).drop("ranks").withColumn("q2", F.expr("q + m - shiftleft(1, k)"))
    tail = here(at).select("doc_id", "t", "chain", F.col("q").alias("q2"), F.col("ranks").alias("ranks2"))
    named = head.join(tail, ["doc_id", "t", "chain", "q2"]).select("doc_id.doc_id", "t", "chain", "q", "m", "a", F.get("ranks2", F.col("k")).alias("b"))
    named = scratch.save(named, "intervals")
    where = F.struct("doc_id", "t", "q")
    origin = scratch.save(named.groupBy("m", "a", "b").agg(F.min(where).alias("rank"), F.count("*").alias("n")).where("n > 1"), "origins")
    later = with_ranks(named, origin, ["m", "a", "b"], named.count()).where(where > F.col("rank"))
    dead = here(later.select("doc_id", "t", F.explode(F.sequence("q", F.col("q") + F.col("m") - 1)).alias("q")).distinct())
    return dead.join(here(chains).select("doc_id", "t", "q", "pos"), ["doc_id", "t", "q"]).groupBy("doc_id", "t").agg(F.collect_set("pos").alias("dead")).select("doc_id.doc_id", "t", "dead")


def edited_rows(docs: DataFrame, least: int = 50, broadcast_mb: int = 32) -> DataFrame:
    """(row, text, n_lines, n_deleted): each row's columns but text as one struct, and what dedup_lines makes of its text."""
    scratch = Scratch(docs.sparkSession, "lines")
    body = _body(docs)
    copies = repeated_texts(body, scratch)
    dead = repeated_lines(body, copies, scratch, least).withColumn("whole", F.lit(False))
    later = body.where(words(F.col("text")) >= least).join(few(copies), ["t", "t2"]).where("not (doc_id <=> first)")
    later = later.select("doc_id", "t", F.array().cast("array<int>").alias("dead"), F.lit(True).alias("whole")).distinct()
    edits = scratch.save(dead.unionByName(later).toDF("e_id", "e_t", "dead", "whole"), "edits")
    small = (edits.agg((F.count("*") * 24 + F.coalesce(F.sum(F.size("dead")), F.lit(0)) * 8)).first()[0] or 0) <= broadcast_mb << 20
    out = body.join(F.broadcast(edits) if small else edits, F.expr("doc_id <=> e_id and t = e_t"), "left")
    line = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(line) - 1), "dead"), lambda i: F.get(line, i))
    text = F.when(F.col("whole"), F.lit("")).when(F.col("dead").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    gone = F.when(F.col("whole"), F.size(line)).when(F.col("dead").isNotNull(), F.size("dead")).otherwise(0)
    return out.select("row", text.alias("text"), F.size(line).alias("n_lines"), gone.alias("n_deleted"))


def dedup_lines(docs: DataFrame, least: int = 50, broadcast_mb: int = 32) -> DataFrame:
    """(row's own columns but text, n_lines, n_deleted, text) of every row: repeated runs of lines are
    deleted but for their first copy in the order of doc_id and line.

    A run counts from `least` words on. Blank lines neither count nor break a run, and stay. A row whose
    whole text repeats a row of smaller doc_id loses all its lines if it has `least` words; rows that
    repeat both id and text stay alike. Null texts count as empty. A null doc_id is the smallest. An
    empty table gives an empty result. Columns named n_lines or n_deleted are replaced; any other name may stand in docs.
    """
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_deleted")]
    return edited_rows(docs, least, broadcast_mb).select(*[F.col("row").getField(c).alias(c) for c in own], "n_lines", "n_deleted", "text")
