"""Embedding providers: pandas UDFs from text to vectors, injected where an index is synchronised."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Texts of one request.
REQUEST = 64


def embedding_provider(load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]], size: int, request: int = REQUEST):
    """A column function from text to vectors by a client of a model.

    ``load`` makes the client, once in a task; the client maps a list of texts to as many
    vectors. Each answer is checked before it is used: another number of vectors, another
    dimension than ``size`` or a value that isn't finite fails the task. Null texts are
    empty. No request is made for no texts.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = None
        for texts in batches:
            found: list = []
            for start in range(0, len(texts), request):
                part = ["" if t is None else t for t in texts.iloc[start : start + request]]
                client = client or load()
                vectors = client(part)
                if vectors is None or len(vectors) != len(part):
                    raise ValueError(f"the provider gave {0 if vectors is None else len(vectors)} embeddings for {len(part)} texts")
                for v in vectors:
                    if len(v) != size:
                        raise ValueError(f"an embedding has {len(v)} dimensions, not {size}")
                    if not np.isfinite(np.asarray(v, np.float64)).all():
                        raise ValueError("an embedding has a value that is not finite")
                found += [np.asarray(v, np.float32) for v in vectors]
            yield pd.Series(found, index=texts.index, dtype=object)

    return embed


def hashed_embedding(size: int = 64):
    """A deterministic stand-in for a model: term counts by hash, scaled to length 1."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[float]:
            out = [0.0] * size
            for term in (text or "").lower().split():
                h = hashlib.sha256(term.encode()).digest()
                out[int.from_bytes(h[:4], "little") % size] += 1.0 if h[4] & 1 else -1.0
            length = sum(x * x for x in out) ** 0.5
            return [x / length for x in out] if length else out

        return texts.map(of)

    return embed
