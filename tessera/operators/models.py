"""Models that a worker loads once, as Column functions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_loaded: dict[str, Any] = {}


def loaded(name: str, load: Callable[[], Any]) -> Any:
    """What this worker keeps under a name; load() makes it when it is first asked for."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def per_worker(name: str, load: Callable[[], Any], apply: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """A function of Columns that calls apply(model, *batches of their values) in Arrow batches.

    The model is loaded in the worker, never in the driver, before the first batch of the first task that needs it, and kept for
    the tasks that follow there; a worker that is lost leaves its model to be loaded anew. Two models need two names.
    """

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield apply(loaded(name, load), *(columns if isinstance(columns, tuple) else (columns,)))

    return F.pandas_udf(run, returns)


class Hashed:
    """Stand-in for an embedder: a unit vector of how many of a text's terms have each hash."""

    def __init__(self, width: int):
        self.width = width

    def vectors(self, terms: pd.Series) -> pd.Series:
        return pd.Series([self.vector(t) for t in terms], dtype=object)

    def vector(self, terms: np.ndarray | None) -> np.ndarray | None:
        if terms is None or not len(terms):
            return None
        counts = np.bincount([zlib.crc32(t.encode()) % self.width for t in terms], minlength=self.width).astype(float)
        return counts / np.linalg.norm(counts)


def hashed(width: int = 64) -> Callable[[Column], Column]:
    """Vectors of arrays of terms; null without any."""
    return per_worker(f"hashed {width}", lambda: Hashed(width), lambda model, terms: model.vectors(terms), "array<double>")
