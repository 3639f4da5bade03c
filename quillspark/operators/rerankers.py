"""Adapters for models that score (question, text) pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import select

Scorer = Callable[[Sequence[tuple[str, str]]], Sequence]


def float_scores(values: Sequence, pairs: int) -> list[float]:
    """A model's scores as numbers; each may be alone in a list."""
    out = []
    for v in values:
        if isinstance(v, (list, tuple)) or getattr(v, "ndim", 0):
            if len(v) != 1:
                raise ValueError(f"a score must be one number, not {len(v)}")
            v = v[0]
        out.append(float(v))
    if len(out) != pairs:
        raise ValueError(f"{len(out)} scores for {pairs} pairs")
    return out


def resolved_device(wanted: str, available: Callable[[str], bool]) -> str:
    """`auto` takes the first of cuda and mps that a worker has, else cpu."""
    if wanted != "auto":
        return wanted
    return next((d for d in ("cuda", "mps") if available(d)), "cpu")


def model_scores(load: Callable[[], Scorer], batch: int = 64) -> Callable[[Column, Column], Column]:
    """A reranker for `select.reranked`: `load` runs once in each worker, and
    only where pairs are scored; pairs come in Arrow batches."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = None
        for question, text in parts:
            pairs = list(zip(question.fillna(""), text.fillna(""), strict=True))
            if pairs and model is None:
                model = load()
            found = [s for at in range(0, len(pairs), batch) for s in float_scores(model(pairs[at : at + batch]), len(pairs[at : at + batch]))]
            yield pd.Series(found, dtype="float64")

    return score


def chosen_reranker(enabled: bool, load: Callable[[], Scorer] | None = None) -> Callable[[Column, Column], Column] | None:
    """None keeps the order; without a model, the lexical score is used."""
    if not enabled:
        return None
    return model_scores(load) if load else select.lexical_score
