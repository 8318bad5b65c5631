"""Slots for models: a function on a list of texts, loaded once per worker, as an Arrow-batched UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Input given to a model at a time.
MODEL_BYTES = 2 << 20


def model_column(load: Callable[[], Callable[[list], list]], returns: str) -> Callable[[Column], Column]:
    """``load`` builds the model in the worker; the result maps a batch of inputs to outputs.

    Use ``array<string>`` for sentence models, ``array<int>`` for punctuation labels, ``string`` for
    translators. A failing text comes back as the model function decides (``None`` keeps the source). The model gets
    at most ``MODEL_BYTES`` of input at a time (characters, tokens count as 64), one text at least, so that what a worker
    holds of its results does not grow with the texts.
    """

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            part, held = [], 0
            for text in batch:
                size = 64 + (len(text) if isinstance(text, str) else 64 * len(text) if hasattr(text, "__len__") else 0)
                if part and held + size > MODEL_BYTES:
                    yield pd.Series(model(part))
                    part, held = [], 0
                part.append(text)
                held += size
            yield pd.Series(model(part), dtype=None if part else object)

    return run


def checked(value: float, low: float, high: float, name: str) -> float:
    """Reject a parameter outside its bounds before any job starts."""
    if not low <= value <= high:
        raise ValueError(f"{name} must lie within {low}..{high}, got {value}")
    return value


# fixed values: bounds of the parameters
BOUNDS = {"target_db": (-60.0, 0.0), "strength": (0.0, 1.0), "max_chars": (10, 200), "batch_size": (1, 50)}
