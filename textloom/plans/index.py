"""Index snapshots: a batch is written beside the current one, verified, and then pointed to.

Readers resolve the pointer once, so they see one batch whole. A failed check leaves the old batch.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import DEFAULT


def content_hash(chunks: DataFrame, order: str = "ord", text: str = "content", group: int = 4096) -> DataFrame:
    """(content_hash, n): SHA-256 over the digests of consecutive groups of contents in order.

    Digests are grouped again until one group is left, so no task holds more than `group` of them.
    """
    rows = chunks.select(F.col(order).cast("long").alias("g"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("h"), F.lit(1).cast("long").alias("n"))
    most = rows.agg(F.max(F.abs("g"))).first()[0] or 0
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "\n"), 256)
    while True:
        rows = rows.groupBy((F.col("g") / group).cast("long").alias("up")).agg(joined.alias("h"), F.sum("n").alias("n")).withColumnRenamed("up", "g")
        most //= group
        if most < group:
            return rows.agg(joined.alias("content_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def inactive_count(chunks: DataFrame, status: str = "status", active: str = "active") -> DataFrame:
    """(n): rows whose status is another than active; a null status is not counted."""
    return chunks.where(F.col(status) != active).agg(F.count("*").alias("n"))


def health(chunks: DataFrame, expected: list[str], least: int = DEFAULT.index_min_chunks) -> DataFrame:
    """(n, missing, healthy): enough chunks, and every expected source among them."""
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, expected)), F.collect_set("source")))
    return chunks.agg(F.count("*").alias("n"), missing.alias("missing")).select("n", F.array_join("missing", ",").alias("missing"), ((F.col("n") >= least) & (F.size("missing") == 0)).alias("healthy"))


class Index:
    """Batches of chunks under one folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[tuple[int, str]]:
        """(number, path) of the manifests, the newest first."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(((int(n[9:-5]), f"{self.root}/{n}") for n in names if n.startswith("MANIFEST-") and n.endswith(".json")), reverse=True)

    def _load(self, path: str) -> dict:
        return json.loads(self.spark.read.text(path).first()[0])

    def current(self) -> dict | None:
        """The manifest with the highest number; manifests never change, so a reader sees the old batch or the new one."""
        found = self._manifests()
        return self._load(found[0][1]) if found else None

    def read(self) -> DataFrame | None:
        now = self.current()
        return self.spark.read.parquet(f"{self.root}/batch_id={now['batch_id']}") if now else None

    def publish(self, chunks: DataFrame, batch_id: str, expected: int | None = None, keep: int = 2) -> dict:
        """Writes, verifies the count (and that embeddings are there), adds a manifest, drops all but the last `keep` batches.

        Readers of the batch before can finish. Of two that publish at once one fails.

        Returns the manifest with `changed`: whether the contents differ from the batch before.
        """
        path = f"{self.root}/batch_id={batch_id}"
        chunks.write.mode("overwrite").parquet(path)
        staged = self.spark.read.parquet(path)
        n = staged.count()
        bad = staged.where("embedding is null").count() if "embedding" in staged.columns else 0
        if not n or bad or (expected is not None and n != expected):
            self._fs.delete(self._path(path), True)
            raise ValueError(f"batch {batch_id} has {n} rows, {bad} without embedding; expected {expected}: the current batch stays")
        digest = content_hash(staged).first()["content_hash"]
        before = self.current()
        manifest = {"batch_id": batch_id, "content_hash": digest, "n": n, "changed": before is None or before["content_hash"] != digest}
        found = self._manifests()
        number = found[0][0] + 1 if found else 1
        tmp, target = self._path(f"{self.root}/.{batch_id}.tmp"), self._path(f"{self.root}/MANIFEST-{number:012d}.json")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(tmp, target):
            raise RuntimeError(f"manifest {number} exists: another batch was published meanwhile")
        self.vacuum(keep)
        return manifest

    def vacuum(self, keep: int = 2) -> None:
        """Drops the manifests before the last `keep`, and the batches that only they name."""
        found = self._manifests()
        kept = {self._load(p)["batch_id"] for _, p in found[:keep]}
        for _, p in found[keep:]:
            old = self._load(p)["batch_id"]
            if old not in kept:
                self._fs.delete(self._path(f"{self.root}/batch_id={old}"), True)
            self._fs.delete(self._path(p), False)


def dump(chunks: DataFrame) -> DataFrame:
    """(ord, value): a markdown block for each chunk, to be written with write.text in order."""
    nil = lambda c: F.coalesce(c, F.lit("none"))
    lines = [
        F.concat(F.lit("### Chunk "), F.col("ord").cast("string"), F.lit("  —  "), nil("section")), F.concat(F.lit("**Title:** "), nil("title")),
        F.concat(F.lit("**Source:** "), nil("source"), F.lit(" | **Anchor:** "), nil("anchor")), F.concat(F.lit("**URL:** "), nil("url"), F.lit(" | **Project ID:** "), nil("project_id")),
        F.lit(""), F.col("content"), F.lit(""), F.lit("---"),
    ]
    return chunks.select("ord", F.concat_ws("\n", *lines).alias("value"))
