"""Embedding of texts: a model is made once in each task and sees Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], np.ndarray]


def hashing_model(width: int = 384) -> Model:
    """A stand-in where no trained model is at hand: signed counts of hashed tokens; where they all cancel out, plain counts.

    So only a text without tokens has the zero vector.
    """
    import re
    import zlib

    word = re.compile("[a-z0-9]+")

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for i, t in enumerate(texts):
            for w in word.findall(t.lower()):
                h = zlib.crc32(w.encode())
                out[i, (h >> 1) % width] += 1 - 2 * (h & 1)
            if not out[i].any():
                for w in word.findall(t.lower()):
                    out[i, (zlib.crc32(w.encode()) >> 1) % width] += 1
        return out

    return encode


def embed(rows: DataFrame, text: str = "content", out: str = "embedding", make: Callable[[], Model] = hashing_model, batch: int = 256) -> DataFrame:
    """rows and a unit vector of each text (null: empty); a text without any feature has the zero vector. One scan, no shuffle."""
    at = rows.columns.index(text)
    kind = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            parts = [np.asarray(model(texts[i : i + batch]), np.float32) for i in range(0, len(texts), batch)]
            vectors = [v / max(float(np.linalg.norm(v)), 1e-9) for p in parts for v in p]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*b.schema.names, out])

    return rows.mapInArrow(run, f"{kind}, `{out}` array<float>")


def vector_literal(vector: Column) -> Column:
    """A vector as text: [v1,v2,...]."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(literal: Column) -> Column:
    """The vector of such a text; null for anything else."""
    return F.from_json(literal, "array<double>")
