"""Quality profiles as stored state per chunk, which adds up to any roll-up without reading the cues again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = ("rec_id", "chunk_id")
#: Accuracy of the sketches: 2 ** LG_K registers for distinct counts (relative error 1.04 / sqrt(2 ** LG_K), one standard
#: deviation), K for quantiles (rank error about 1.33 % at 200, with 99 % confidence).
LG_K, K = 12, 200


def chunk_states(cues: DataFrame, keys: Sequence[str] = CHUNK, order: str = "cue_idx") -> DataFrame:
    """One row per chunk: ``(keys, n_cues, first_start, last_end, max_end_ms, overlaps, starts)``.

    ``overlaps`` counts cues that start before the end of the one before in the chunk, ``starts`` is a sketch of the distinct
    start times. A window runs inside a chunk. Cues without a start count, but neither as start nor as overlap.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = cues.withColumn("_was", F.lag("end_ms").over(w))
    at = F.struct(order, "start_ms", "end_ms")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cues"), F.min(at)["start_ms"].alias("first_start"), F.max(at)["end_ms"].alias("last_end"),
        F.max("end_ms").alias("max_end_ms"), F.count_if(F.col("start_ms") < F.col("_was")).alias("overlaps"),
        F.hll_sketch_agg("start_ms", LG_K).alias("starts"))


def replace_states(states: DataFrame, new: DataFrame, keys: Sequence[str] = CHUNK) -> DataFrame:
    """States with those of some chunks put in place of their old ones; the other chunks are not looked at again."""
    return states.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def merge_states(states: DataFrame, by: Sequence[str] = ("rec_id",), order: str = "chunk_id") -> DataFrame:
    """The report over ``by`` from the chunks' states: ``(by, n_chunks, n_cues, max_end_ms, overlaps, distinct_starts,
    duplicate_starts)``.

    Counts, ends and overlaps are exact: where two chunks meet, the last end of the one is held against the first start of the
    other. Distinct starts are an estimate within the sketch's error, exact for a few hundred. What is read is one row
    a chunk.
    """
    w = Window.partitionBy(*by).orderBy(order)
    rows = states.withColumn("_was", F.lag("last_end").over(w))
    seams = F.count_if(F.col("first_start") < F.col("_was"))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("n_cues").alias("n_cues"), F.max("max_end_ms").alias("max_end_ms"),
        (F.sum("overlaps") + seams).alias("overlaps"), F.hll_sketch_estimate(F.hll_union_agg("starts")).alias("distinct_starts"))
    return out.withColumn("duplicate_starts", F.greatest(F.col("n_cues") - F.col("distinct_starts"), F.lit(0)))


def level_states(signal: DataFrame, block: int = 1 << 20, key: str = "series_id") -> DataFrame:
    """One row per block of ``block`` samples: ``(series_id, block, n, sum_squares, magnitudes)``, the last a quantile sketch."""
    m = F.abs("value").cast("double")
    return signal.groupBy(key, F.expr(f"idx div {int(block)}").alias("block")).agg(
        F.count("value").alias("n"), F.sum(m * m).alias("sum_squares"), F.kll_sketch_agg_double(m, K).alias("magnitudes"))


def merge_levels(states: DataFrame, q: float = 0.05, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """``(by, n, rms, quantile)`` from blocks' states: the level exactly, the quantile of the magnitudes within the
    sketch's rank error. ``signal.soft_gate`` takes the result as ``floors``; store it first, as sketches draw lots when
    they are made and another evaluation may differ within the error."""
    return states.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sqrt(F.sum("sum_squares") / F.sum("n")).alias("rms"),
        F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("magnitudes", K), F.lit(float(q))).alias("quantile"))
