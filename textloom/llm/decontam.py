"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Items are partitioned by their number of shingles into classes 2^(c-1) < n <= 2^c. Every document is
sketched for each class as windows of three half-size blocks, so that an item of the class lies whole
in some window and takes a third of it or more. One of 48 minimum hashes must agree; then the item's
distinct shingles are looked up in the whole document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, texts

HASHES = 48
WORD = re.compile(r"\w+")
PRIME = 0x9E3779B97F4A7C15


def shingles(text: str, words: int = 5) -> np.ndarray:
    """64-bit hashes of the word shingles of lower-cased text, repeats included; none below `words` words."""
    h = xxhash.xxh64_intdigest
    w = np.fromiter((h(x) for x in WORD.findall(text.lower())), np.uint64)
    if len(w) < words:
        return w[:0]
    out = w[: len(w) - words + 1].copy()
    for i in range(1, words):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(PRIME) + w[i : len(w) - words + 1 + i]
    return out ^ (out >> np.uint64(32))


def minhashes(s: np.ndarray) -> np.ndarray:
    """One row for each hash function: multiply-add over the low 32 bits."""
    a = (np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(PRIME) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)).astype(np.uint32)
    x = s.astype(np.uint32)[None, :] * a[:, None] + b[:, None]
    return x ^ (x >> np.uint32(15))


class Index:
    """Items of one size class: for each hash function a bit table of minima, and the minima themselves."""

    def __init__(self, level: int, items: list[tuple[int, np.ndarray]]):
        self.block, self.bits = max(1, 1 << level >> 1), 16
        sig = np.stack([minhashes(s).min(1) for _, s in items]).astype(np.uint64)
        self.members = np.array([i for i, _ in items])
        keys = (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)) | sig
        self.owner = np.argsort(keys.ravel(), kind="stable") // HASHES
        self.keys = np.sort(keys.ravel(), kind="stable")
        self.seen = np.zeros((HASHES, 1 << self.bits), bool)
        self.seen[np.arange(HASHES)[None, :], sig & np.uint64(0xFFFF)] = True

    def candidates(self, minima: np.ndarray) -> set[int]:
        """minima: of each hash function over the document's blocks of this class."""
        n = minima.shape[1]
        m = minima
        for step in (1, 2):
            if n > step:
                m = np.minimum(m[:, : n - step] if m.shape[1] > n - step else m, minima[:, step:])
        if n <= 2:
            m = minima.min(1, keepdims=True)
        f, w = np.nonzero(self.seen[np.arange(HASHES)[:, None], m & np.uint32(0xFFFF)])
        if not len(f):
            return set()
        keys = np.unique((f.astype(np.uint64) << np.uint64(32)) | m[f, w].astype(np.uint64))
        lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        return {int(self.members[self.owner[i]]) for a, b in zip(lo, hi, strict=True) for i in range(a, b)}


def _block_minima(s: np.ndarray, block: int) -> np.ndarray:
    """Minimum hashes of consecutive blocks; long documents are hashed in stretches of whole blocks."""
    stretch = max(block, (1 << 15) // block * block)
    return np.concatenate([np.minimum.reduceat(minhashes(s[i : i + stretch]), np.arange(0, len(s[i : i + stretch]), block), axis=1) for i in range(0, len(s), stretch)], axis=1)


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, containment: float = 0.8, items_a_pass: int = 20_000) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of every row and item it contains.

    containment is the share of the item's distinct word shingles that the document has. Items are read
    to the driver in blocks of `items_a_pass`, one at a time, and each block is held against all
    documents; where there are several, each writes its rows before the next is read. Items and
    texts of fewer than `words` words, nulls and empty texts match nothing; repeated rows match each.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).distinct()
    out, block, n = None, [], 0

    def one_pass(block: list[tuple[int, str]]) -> DataFrame:
        ids = [i for i, _ in block]
        sets = [np.unique(shingles(t, words)) for _, t in block]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by: dict[int, list[tuple[int, np.ndarray]]] = {}
            for k, s in enumerate(sets):
                if len(s):
                    by.setdefault((len(s) - 1).bit_length(), []).append((k, s))
            index = [Index(c, members) for c, members in sorted(by.items())]
            for b in batches:
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    s = shingles(text.as_py(), words)
                    if not len(s) or not index:
                        continue
                    found: set[int] = set()
                    minima, size = _block_minima(s, index[0].block), index[0].block
                    for x in index:
                        while size < x.block:
                            minima, size = np.minimum.reduceat(minima, np.arange(0, minima.shape[1], 2), axis=1), size * 2
                        found |= x.candidates(minima)
                    if found:
                        own = np.unique(s)
                        for k in sorted(found):
                            n = int(np.isin(sets[k], own, assume_unique=True).sum())
                            if n >= containment * len(sets[k]):
                                rows.append((doc, ids[k], n, len(sets[k]), n / len(sets[k])))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "shared", "item_shingles", "containment"])

        return texts(docs).mapInArrow(run, "doc_id long, item_id long, shared long, item_shingles long, containment double")

    scratch = Scratch(docs.sparkSession, "leaks")
    for row in items.toLocalIterator():
        if len(block) == items_a_pass:
            part = scratch.save(one_pass(block), f"pass{n}")
            out, block, n = part if out is None else out.union(part), [], n + 1
        block.append((row[0], row[1]))
    last = one_pass(block)
    return last if out is None else out.union(last)


SQL = """
WITH words AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents
               UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') FROM benchmark),
sh AS (SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM words WHERE len(w) >= 5),
sizes AS (SELECT id AS item_id, count(*) AS n FROM sh WHERE side = 'b' GROUP BY id),
shared AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM sh d JOIN sh b USING (s) WHERE d.side = 'd' AND b.side = 'b' GROUP BY ALL)
SELECT doc_id, item_id, shared::BIGINT AS shared, n::BIGINT AS item_shingles, shared / n AS containment FROM shared JOIN sizes USING (item_id) WHERE shared >= 0.8 * n
"""
