"""Text embedding and vector arithmetic.

An embedder is any function from a text Column to an ``array<float>`` Column
with a ``model_id`` and a ``dim``; a ``pandas_udf`` or ``arrow_udf`` around a
real model fits.  The one shipped here hashes tokens with SHA-256.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.model import EMBED_DIM

# The Unicode white space characters that separate tokens, as a
# regular expression class.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SEPARATORS = re.compile(f"[{WHITE_SPACE}]+")
_RECORD = np.dtype([("digest", np.uint8, 32), ("first", "<u4")])
_GROUP_CHARS = 1_000_000


@dataclass(frozen=True)
class Embedder:
    model_id: str
    dim: int
    embed: Callable[[Column], Column]
    embed_text: Callable[[str], list[float]]


def _tokens(text: str) -> list[str]:
    """Runs of anything but white space.

    Python's own ``split`` differs only in also cutting at four control
    characters, so it serves whenever a text has none of them.
    """
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [t for t in _SEPARATORS.split(text) if t]
    return text.split()


def _groups(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Cut positions into runs of about a million characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= _GROUP_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _hash_vectors(texts: Sequence[str | None], dim: int) -> np.ndarray:
    """One normalised row per text; texts without tokens give zero rows.

    A token's digest bytes go to 32 consecutive positions that start at its byte
    length.  A byte ``b`` counts as the integer ``2b - 255``: the byte mapped to
    [-1, 1] up to a constant that normalising removes.  Integer sums are exact in
    double precision and do not depend on the order of the tokens.  Distinct
    tokens of a text count once, and recent tokens' hashes are remembered.
    """
    @lru_cache(maxsize=1 << 18)
    def record(token: str) -> bytes:
        raw = token.encode()
        return hashlib.sha256(raw).digest() + (len(raw) % dim).to_bytes(4, "little")

    out = np.zeros((len(texts), dim))
    for start, end in _groups(texts):
        counted = [Counter(_tokens(t)) if t else Counter() for t in texts[start:end]]
        records = np.frombuffer(b"".join(record(t) for c in counted for t in c), _RECORD)
        if not len(records):
            continue
        counts = np.array([n for c in counted for n in c.values()], np.float64)
        rows = np.repeat(np.arange(end - start), [len(c) for c in counted])
        at, cells = rows * dim + records["first"], (end - start) * dim
        for i, byte in enumerate(np.ascontiguousarray(records["digest"].T)):
            sums = np.bincount(at, weights=(byte * 2.0 - 255.0) * counts, minlength=cells)
            out[start:end] += np.roll(sums.reshape(-1, dim), i, axis=1)
    norms = np.sqrt((out * out).sum(axis=1))
    norms[norms == 0] = 1.0
    return out / norms[:, None]


def hash_embedder(dim: int = EMBED_DIM) -> Embedder:
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pa.Array) -> pa.Array:
        rows = _hash_vectors(texts.to_pylist(), dim).astype(np.float32)
        ends = np.arange(0, rows.size + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))

    return Embedder(
        model_id=f"hash-sha256-{dim}",
        dim=dim,
        embed=embed,
        embed_text=lambda text: _hash_vectors([text], dim)[0].astype(np.float32).tolist(),
    )


def dot(vector: Column, query: Sequence[float]) -> Column:
    """Dot product with a fixed vector, summed in double precision."""
    weights = F.array(*[F.lit(float(x)) for x in query])
    products = F.zip_with(vector, weights, lambda a, b: a.cast("double") * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )
    scaled = F.transform(vector, lambda x: (x / norm).cast("float"))
    # Fixed value: single-precision epsilon, below which a vector is left alone.
    return F.when(norm > F.lit(1.1920928955078125e-07), scaled).otherwise(vector)
