"""Ports for models: a function from a batch of texts to vectors or answers, run in Arrow batches, loaded once per worker.

The default embedder hashes words into a vector, which needs no model and gives the same vectors everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashing_embedder(size: int = 64) -> Callable[[Sequence[str]], np.ndarray]:
    """Words of a text counted into hashed places with hashed signs, to length 1; a text without words is all zeros."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                out[row, h % size] += 1.0 if h >> 63 else -1.0
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


def embed(text: Column, make: Callable[[], Callable] = hashing_embedder, batch: int = 32) -> Column:
    """Vectors of texts; make() loads the model once per task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for series in batches:
            parts = [model(series.iloc[k : k + batch].fillna("").tolist()) for k in range(0, len(series), batch)]
            vectors = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            if len(vectors) != len(series):
                raise ValueError("the model must give one vector for each text")
            yield pd.Series(list(vectors), index=series.index)

    return run(text)


def generate(prompts: DataFrame, make: Callable[[], Callable[[Sequence[str]], Sequence[str]]], prompt_col: str = "prompt", out_col: str = "raw") -> DataFrame:
    """Prompts with the model's answers. Equal prompts are asked once: the caller's distinct rows decide what a call costs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(**{out_col: list(model(b[prompt_col].fillna("").tolist()))})

    asked = prompts.select(prompt_col).distinct()
    answered = asked.mapInPandas(run, f"`{prompt_col}` string, `{out_col}` string")
    return prompts.join(answered, prompt_col)
