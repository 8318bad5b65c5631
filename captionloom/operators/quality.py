"""Quality profiles of segments, alignments, captions and runs.

Neighbour comparisons use ``ordered_scan``; the rest are plain aggregations with map-side combine.
``by`` may be any prefix of the keys; ``rollup=True`` adds subtotals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .scan import ordered_scan

CHUNK = ("rec_id", "chunk_id")


def _group(df: DataFrame, by: Sequence[str], rollup: bool = False):
    return df.rollup(*by) if rollup else df.groupBy(*by)


def _neighbours(df: DataFrame, keys, order, **kw) -> DataFrame:
    return ordered_scan(df, keys, order, lasts={"_prev": F.struct(
        F.col("_text").alias("text"), F.col("end_ms").alias("end_ms"))}, **kw)


def anomalies(
    segments: DataFrame, by: Sequence[str] = CHUNK, order: Sequence[str] = ("seg_idx",), text: str = "text",
    variant: str = "full", **kw,
) -> DataFrame:
    """Counts of suspicious segments per chunk and the labels they give (``array<string>``).

    ``full``: repeated non-blank neighbours (>1), over 15 s, no length, more than 30 % with at most three
    characters (n > 5), more than two single characters, overlaps. ``plain``: blank repeats count too and
    single characters do not.
    """
    rows = segments.withColumn("_text", strip(F.coalesce(F.col(text), F.lit(""))))
    rows = _neighbours(rows, by, order, **kw)
    same = F.col("_prev").isNotNull() & (F.col("_text") == F.col("_prev.text"))
    if variant == "full":
        same = same & (F.col("_text") != "")
    span, size = F.col("end_ms") - F.col("start_ms"), F.length("_text")
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(same).alias("repeated"),
        F.count_if(span > 15000).alias("long"),
        F.count_if(span <= 0).alias("zero"),
        F.count_if(size <= 3).alias("short"),
        F.count_if(size == 1).alias("single"),
        F.count_if(F.col("_prev").isNotNull() & (F.col("start_ms") < F.col("_prev.end_ms"))).alias("overlaps"),
    )
    flags = [
        F.when(F.col("repeated") > 1, F.format_string("repeated_segments(%d)", "repeated")),
        F.when(F.col("long") > 0, F.format_string("long_segments(%d)", "long")),
        F.when(F.col("zero") > 0, F.format_string("zero_duration(%d)", "zero")),
        F.when((F.col("n") > 5) & (F.col("short") / F.col("n") > 0.3), F.format_string("fragmented(%d/%d)", "short", "n")),
    ]
    if variant == "full":
        flags.append(F.when(F.col("single") > 2, F.format_string("single_chars(%d)", "single")))
    flags.append(F.when(F.col("overlaps") > 0, F.format_string("overlaps(%d)", "overlaps")))
    return out.withColumn("labels", F.filter(F.array(*flags), lambda x: x.isNotNull()))


def match_report(aligned: DataFrame, by: Sequence[str] = CHUNK, rollup: bool = False) -> DataFrame:
    """Matched share and confidence bins of an alignment."""
    c = F.col("confidence")
    return _group(aligned, by, rollup).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("start_word_idx") >= 0).alias("matched"),
        F.count_if(c >= 0.95).alias("ge_095"),
        F.count_if((c >= 0.90) & (c < 0.95)).alias("ge_090"),
        F.count_if((c >= 0.85) & (c < 0.90)).alias("ge_085"),
        F.count_if((c > 0) & (c < 0.85)).alias("lt_085"),
        F.count_if(c == 0).alias("zero"),
    ).withColumn("rate", F.col("matched") / F.col("total"))


def quality_tiers(aligned: DataFrame, by: Sequence[str] = CHUNK, compat: bool = False) -> DataFrame:
    """Perfect (1), good (>= .8), poor and failed (0) counts, success rate and grade.

    ``compat`` counts failures as poor and reports none as failed.
    """
    c = F.col("confidence")
    failed = F.lit(False) if compat else c == 0
    rate = F.col("success_rate")
    return aligned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(c == 1).alias("perfect"),
        F.count_if((c >= 0.8) & (c < 1)).alias("good"),
        F.count_if((c < 0.8) & ~failed).alias("poor"),
        F.count_if(failed).alias("failed"),
    ).withColumn("success_rate", (F.col("perfect") + F.col("good")) / F.col("total")).withColumn(
        "grade", F.when(rate == 1, "perfect").when(rate >= 0.9, "excellent").when(rate >= 0.8, "good").otherwise("poor"))


def merge_report(cues: DataFrame, by: Sequence[str] = ("rec_id",), order: Sequence[str] = ("chunk_id", "cue_idx"), **kw) -> DataFrame:
    """Number of cues, largest end and overlaps with the cue before."""
    rows = ordered_scan(cues, by, order, lasts={"_end": F.col("end_ms")}, **kw)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cues"),
        F.max("end_ms").alias("max_end_ms"),
        F.count_if(F.col("start_ms") < F.coalesce("_end", F.lit(0))).alias("overlaps"),
    ).withColumns({"max_end_min": F.col("max_end_ms") / 60000, "max_end_h": F.col("max_end_ms") / 3600000})


def run_report(runs: DataFrame, cues: DataFrame | None = None, by: Sequence[str] = ("rec_id",)) -> DataFrame:
    """Chunks ok, failed and in total; with ``cues`` also the cues of the ok chunks."""
    if cues is not None:
        counts = cues.groupBy(*by, "chunk_id").agg(F.count(F.lit(1)).alias("n_cues"))
        runs = runs.drop("n_cues").join(counts, [*by, "chunk_id"], "left")
    ok = F.col("status") == "ok"
    aggs = [
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"),
        F.count_if(F.col("status") == "error").alias("failed"),
    ]
    if "n_cues" in runs.columns:
        aggs.append(F.coalesce(F.sum(F.when(ok, F.col("n_cues"))), F.lit(0)).alias("cues"))
    return runs.groupBy(*by).agg(*aggs)


def failed_chunks(runs: DataFrame) -> DataFrame:
    """Ids of the failed chunks, as rows (a list per recording could be of any length)."""
    return runs.filter("status = 'error'").select("rec_id", "chunk_id").distinct()


def span_check(cues: DataFrame, durations: DataFrame, by: Sequence[str] = ("rec_id",), slack_ms: int = 60000, approximate: bool = False) -> DataFrame:
    """Largest end against the known duration (``duration_ms`` per key) and the number of repeated starts."""
    distinct = F.approx_count_distinct("start_ms") if approximate else F.count_distinct("start_ms")
    stats = cues.groupBy(*by).agg(
        F.max("end_ms").alias("max_end_ms"), (F.count(F.lit(1)) - distinct).alias("duplicate_starts"))
    out = stats.join(durations.select(*by, "duration_ms"), list(by), "left")
    off = F.abs(F.col("max_end_ms") - F.coalesce("duration_ms", "max_end_ms"))
    return out.withColumns({"difference_ms": off, "mismatch": off > slack_ms})


def chunk_bounds_check(cues: DataFrame, timing: DataFrame, by: Sequence[str] = CHUNK) -> DataFrame:
    """Relative cue times against the chunk: cues past duration + 10 s, and how far the chunk overruns.

    ``level``: ``error`` over 10 s past the expected end, ``warning`` over 5 s, else ``ok``.
    """
    rows = cues.join(timing.select(*by, F.col("start_ms").alias("c_start"), "duration_ms"), list(by))
    out = rows.groupBy(*by).agg(
        F.count_if(F.col("end_ms") > F.col("duration_ms") + 10000).alias("late_cues"),
        F.max(F.col("c_start") + F.col("end_ms")).alias("max_end_ms"),
        F.max(F.col("c_start") + F.col("duration_ms")).alias("expected_end_ms"))
    over = F.col("max_end_ms") - F.col("expected_end_ms")
    return out.withColumn("level", F.when(over > 10000, "error").when(over > 5000, "warning").otherwise("ok"))


def keep_better(attempts: DataFrame, by: Sequence[str] = CHUNK) -> DataFrame:
    """Attempt to keep: the first one with fewer anomalies than the original (attempt 0), else the original."""
    base = F.min(F.when(F.col("attempt") == 0, F.col("n_anomalies")))
    # two aggregations instead of a window: a group is only ever summed up
    limits = attempts.groupBy(*by).agg(base.alias("_base"))
    better = attempts.filter("attempt > 0").join(limits, list(by)).filter("n_anomalies < _base").groupBy(*by).agg(
        F.min("attempt").alias("_a"), F.min_by("n_anomalies", "attempt").alias("_n"))
    return limits.join(better, list(by), "left").select(
        *by, F.coalesce("_a", F.lit(0)).alias("attempt"), F.coalesce("_n", "_base").alias("n_anomalies"))


def word_overlaps(words: DataFrame, by: Sequence[str] = ("rec_id", "seg_idx"), order: str = "word_idx", **kw) -> DataFrame:
    """Words that start before the end of the word before them in the same segment."""
    rows = ordered_scan(words, by, [order], lasts={"_end": F.col("end_ms")}, **kw)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_words"), F.count_if(F.col("start_ms") < F.col("_end")).alias("overlaps"))


def length_profile(parts: DataFrame, source: DataFrame, max_chars: int = 80, by: Sequence[str] = CHUNK, text: str = "text", part: str = "part") -> DataFrame:
    """Texts in, parts out, texts split, longest part and whether all parts fit."""
    ins = source.groupBy(*by).agg(
        F.count_if(strip(F.col(text)) != "").alias("n_in"), F.count_if(F.length(strip(F.col(text))) > max_chars).alias("n_split"))
    outs = parts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_out"), F.max(F.length(part)).alias("longest"),
        F.bool_and(F.length(part) <= max_chars).alias("all_fit"))
    return ins.join(outs, list(by), "left")


def catalog_report(files: DataFrame, by: Sequence[str] = ("project", "subfolder")) -> DataFrame:
    """Number, bytes and latest change of the chunk files per project and sub-folder."""
    return files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("latest"))
