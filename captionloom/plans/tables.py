"""Derived tables, written once per session to the shared folder, as an ingest step would leave them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.scan import WIDTH, depth_for
from ..session import file_stamp, materialize
from . import fixtures as fx

_OPEN: dict[tuple, "Tables"] = {}


class Tables:
    """``words``, ``segments``, ``cues`` ... of one data folder."""

    _STORED = ("words", "segments", "sentences_edited", "signal")
    _VIEWS = {
        "cues": ("segments", fx.cues_of), "chunk_timing": ("segments", fx.chunk_timing_of),
        "all_chunk_timing": ("segments", fx.all_chunk_timing_of),
        "chunk_runs": ("segments", fx.chunk_runs_of), "attempts": ("chunk_timing", fx.attempts_of),
    }

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}
        self._depths: dict[tuple[str, str, int], int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in self._STORED:
                self._frames[name] = materialize(getattr(fx, name)(self.spark, self.sf_dir), name)
            elif name in self._VIEWS:
                base, view = self._VIEWS[name]
                self._frames[name] = view(getattr(self, base))
            elif name == "glossary":
                self._frames[name] = fx.glossary(self.spark)
            else:
                self._frames[name] = fx.table(self.spark, self.sf_dir, name)
        return self._frames[name]

    def depth(self, name: str, pos: str, width: int = WIDTH) -> int:
        """Scan levels for a table, from the checked maximum of its positions."""
        key = (name, pos, width)
        if key not in self._depths:
            self._depths[key] = depth_for(getattr(self, name), pos, width)
        return self._depths[key]


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    # names, sizes and times of the input files, so that changed data is derived anew
    key = (spark.sparkContext.applicationId, sf_dir, file_stamp(spark, sf_dir))
    if key not in _OPEN:
        _OPEN[key] = Tables(spark, sf_dir)
    return _OPEN[key]
