"""Time assignment for parts, fallbacks for unmatched sentences, and repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .scan import ordered_scan


def time_proportional(
    parts: DataFrame, parent: Sequence[str], order: Sequence[str] | str = "part_idx", text: str = "part",
    start: str = "start_ms", end: str = "end_ms",
) -> DataFrame:
    """Split [start, end] of the parent by character share; the last part ends at ``end``.

    Adds ``part_start_ms`` and ``part_end_ms``. A parent is one text, so the window is small.
    """
    order = [order] if isinstance(order, str) else list(order)
    whole = Window.partitionBy(*parent)
    upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.length(text).cast("bigint")
    rows = parts.withColumns({"_run": F.sum(size).over(upto), "_all": F.sum(size).over(whole)})

    def at(run):
        # floor of the exact share, in whole milliseconds
        return F.col(start) + F.expr(f"({end} - {start}) * ({run}) div _all")

    return rows.withColumns({
        "part_start_ms": at(f"_run - length({text})"),
        "part_end_ms": F.when(F.col("_run") == F.col("_all"), F.col(end)).otherwise(at("_run")),
    }).drop("_run", "_all")


def time_from_words(ranges: DataFrame, words: DataFrame, keys: Sequence[str] = ("rec_id",)) -> DataFrame:
    """Start of the first and end of the last word of [start_word_idx, end_word_idx]; null when unmatched."""
    first = words.select(*keys, F.col("word_idx").alias("start_word_idx"), F.col("start_ms").alias("_ws"))
    last = words.select(*keys, F.col("word_idx").alias("end_word_idx"), F.col("end_ms").alias("_we"))
    out = ranges.drop("start_ms", "end_ms").join(first, [*keys, "start_word_idx"], "left").join(
        last, [*keys, "end_word_idx"], "left")
    return out.withColumnsRenamed({"_ws": "start_ms", "_we": "end_ms"})


def fallback_times(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], mode: str = "a", text: str = "text",
    first_start: str | None = None, first_end: str | None = None, **kw,
) -> DataFrame:
    """Fill null times of unmatched rows after the row before them.

    ``a``: max(0.5 s, 1 s per 8 characters); ``b``: 2 s; ``c``: 0.1 s per character; ``d``: 0..0.
    Rows before any match start at ``first_start`` (column; 0 if absent); under ``c`` the first of
    them ends relative to ``first_end``.
    """
    missing = F.col("start_ms").isNull()
    if mode == "d":
        return rows.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("start_ms", "end_ms")})
    size = F.length(text).cast("bigint")
    est = {"a": F.greatest(F.lit(500).cast("bigint"), size * 125), "b": F.lit(2000).cast("bigint"), "c": size * 100}[mode]
    est = F.when(missing, est).otherwise(F.lit(0).cast("bigint"))
    start0 = F.col(first_start) if first_start else F.lit(0).cast("bigint")
    end0 = F.col(first_end) if first_end else start0
    columns = rows.columns
    rows = ordered_scan(rows.withColumn("_est", est), keys, order, sums={"_sum": F.col("_est")}, **kw)
    anchor = F.when(~missing, F.col("end_ms") - F.col("_sum"))
    rows = ordered_scan(rows, keys, order, lasts={"_base": anchor}, **kw)
    begin = F.coalesce("_base", end0) + F.col("_sum")
    first = F.col("_base").isNull() & (F.col("_sum") == 0)
    rows = rows.withColumns({
        "_s": F.when(~missing, F.col("start_ms")).when(first, start0).otherwise(begin),
        "_e": F.when(~missing, F.col("end_ms")).otherwise(begin + F.col("_est")),
    })
    return rows.drop("start_ms", "end_ms").withColumnsRenamed({"_s": "start_ms", "_e": "end_ms"}).select(*columns)


def repair_times(rows: DataFrame, keys: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    """A row that does not last starts at the (repaired) end before it and lasts one second.

    The first row keeps its start. In a run of such rows the k-th ends k seconds after the last sound one.
    """
    columns = rows.columns
    bad = F.col("start_ms") >= F.col("end_ms")
    step = F.when(bad, 1000).otherwise(0).cast("bigint")
    rows = ordered_scan(rows, keys, order, sums={"_sum": step, "_n": F.lit(1).cast("bigint")}, **kw)
    anchor = F.when(~bad, F.col("end_ms") - F.col("_sum")).when(F.col("_n") == 0, F.col("start_ms"))
    rows = ordered_scan(rows, keys, order, lasts={"_base": anchor}, **kw)
    begin = F.when(bad & F.col("_base").isNotNull(), F.col("_base") + F.col("_sum")).otherwise(F.col("start_ms"))
    rows = rows.withColumns({"_s": begin, "_e": F.when(bad, begin + 1000).otherwise(F.col("end_ms"))})
    return rows.drop("start_ms", "end_ms").withColumnsRenamed({"_s": "start_ms", "_e": "end_ms"}).select(*columns)


def clip_to_end(rows: DataFrame, words: DataFrame, keys: Sequence[str] = ("rec_id", "chunk_id"), slack_ms: int = 1000) -> DataFrame:
    """Ends more than ``slack_ms`` after the last word are set to the last word's end."""
    last = words.groupBy(*keys).agg(F.max("end_ms").alias("_max"))
    out = rows.join(last, list(keys), "left")
    late = F.col("end_ms") > F.col("_max") + slack_ms
    return out.withColumn("end_ms", F.when(late, F.col("_max")).otherwise(F.col("end_ms"))).drop("_max")


def default_fields(rows: DataFrame, has_words: str, text: str = "text") -> DataFrame:
    """Fill ``word_count`` with the token count and ``timing_confidence`` with 1.0 (words known) or 0.5."""
    count, conf = F.size(tokens(F.col(text))), F.when(F.col(has_words), 1.0).otherwise(0.5)
    if "word_count" in rows.columns:
        count = F.coalesce("word_count", count)
    if "timing_confidence" in rows.columns:
        conf = F.coalesce("timing_confidence", conf)
    return rows.withColumns({"word_count": count, "timing_confidence": conf})


def placeholder_cues(
    timing: DataFrame, cues: DataFrame, reason: str = "[No speech detected in this segment]",
    keys: Sequence[str] = ("rec_id", "chunk_id"),
) -> DataFrame:
    """All cues, plus one cue over the whole chunk for every chunk without any."""
    empty = timing.join(cues, list(keys), "left_anti").select(
        *keys, F.lit(0).cast("bigint").alias("cue_idx"), "start_ms",
        (F.col("start_ms") + F.col("duration_ms")).alias("end_ms"), F.lit(reason).alias("content"))
    return cues.select(*empty.columns).unionByName(empty)
