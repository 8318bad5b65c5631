"""Order, numbering, batching and replacement of captions and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.captions import is_valid, select_lang
from .quality import merge_report
from .scan import ordered_scan, with_rank

CUE_ORDER = ("chunk_id", "cue_idx")
TIME_ORDER = ("start_ms", "chunk_id", "cue_idx")


def drop_invalid(cues: DataFrame) -> DataFrame:
    """Keep cues with a positive length and a text."""
    return cues.filter(is_valid(F.col("start_ms"), F.col("end_ms"), F.col("content")))


def absolute_time(cues: DataFrame, offset: str = "offset_ms") -> DataFrame:
    """Add the chunk offset to relative times."""
    return cues.withColumns({c: F.col(c) + F.col(offset) for c in ("start_ms", "end_ms")})


def chunk_filter(spec: str, column: str = "chunk_id") -> Column:
    """Predicate for ``all`` or a list such as ``1,3-5``; it reaches the scan, ids are not listed."""
    if spec.strip().lower() == "all":
        return F.lit(True)
    tests = []
    for part in spec.split(","):
        low, _, high = part.strip().partition("-")
        tests.append(F.col(column).between(int(low), int(high or low)))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def select_chunks(chunks: DataFrame, spec: str, keys: Sequence[str] = ("rec_id",)) -> DataFrame:
    """Existing chunk ids named by ``spec``, each once; unknown ids do not appear."""
    return chunks.filter(chunk_filter(spec)).select(*keys, "chunk_id").distinct()


def merge_chunks(
    cues: DataFrame, lang: str = "all", order: Sequence[str] = CUE_ORDER, keys: Sequence[str] = ("rec_id",), **kw,
) -> DataFrame:
    """All cues of a recording in order, in the chosen language, numbered 1..n as ``merged_idx``."""
    out = cues.withColumn("content", select_lang(F.col("content"), lang))
    return with_rank(out, keys, order, "merged_idx", **kw)


def merge_with_report(cues: DataFrame, lang: str = "all", order: Sequence[str] = CUE_ORDER, **kw):
    return merge_chunks(cues, lang, order, **kw), merge_report(cues, order=order, **kw)


def mark_overlaps(cues: DataFrame, keys: Sequence[str] = ("rec_id",), order: Sequence[str] = CUE_ORDER, **kw) -> DataFrame:
    """Adds ``prev_end_ms`` and ``overlap`` (starts before the end of the cue before)."""
    out = ordered_scan(cues, keys, order, lasts={"prev_end_ms": F.col("end_ms")}, **kw)
    return out.withColumn("overlap", F.coalesce(F.col("start_ms") < F.col("prev_end_ms"), F.lit(False)))


def batch_cues(cues: DataFrame, size: int = 5, keys: Sequence[str] = ("rec_id",), order: Sequence[str] = CUE_ORDER, **kw) -> DataFrame:
    """Adds ``batch_id`` and ``pos``: runs of ``size`` consecutive cues, both from 0."""
    out = with_rank(cues, keys, order, "_k", start=0, **kw)
    return out.withColumns({"batch_id": F.expr(f"_k div {int(size)}"), "pos": F.col("_k") % size}).drop("_k")


def neighbourhood(rows: DataFrame, keys: Sequence[str], pos: str, value: str, before: int = 2, after: int = 2, width: int = 4096) -> DataFrame:
    """Values of the surrounding rows (dense integer positions) as arrays ``left_ctx`` and ``right_ctx``.

    Each block of positions also receives copies of the few rows beside its borders.
    """
    block = f"`{pos}` div {width}"
    low, high = f"(`{pos}` - {after}) div {width}", f"(`{pos}` + {before}) div {width}"
    out = rows.withColumn("_b", F.explode(F.expr(f"array_distinct(array({block}, {high}, greatest({low}, 0L)))")))
    w = Window.partitionBy(*keys, "_b").orderBy(pos)
    out = out.withColumns({
        "left_ctx": F.collect_list(value).over(w.rowsBetween(-before, -1)),
        "right_ctx": F.collect_list(value).over(w.rowsBetween(1, after)),
    })
    return out.filter(f"_b = {block}").drop("_b")


def replace_chunks(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("rec_id", "chunk_id")) -> DataFrame:
    """``new`` cues for the chunks they hold, ``old`` ones for all others."""
    redone = new.select(*keys).distinct()
    return old.join(redone, list(keys), "left_anti").unionByName(new)


def available(ids: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ids.join(present, list(keys), "left_semi")


def unused(items: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    return items.join(used, list(keys), "left_anti")


def best_match(candidates: DataFrame, keys: Sequence[str], score: str, start: str) -> DataFrame:
    """Highest score per key, leftmost start on ties; a map-side combinable aggregate, not a sort."""
    rest = [c for c in candidates.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(start)))
    return candidates.groupBy(*keys).agg(best.alias("_m")).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


def longest_range(ranges: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Longest range per key, the earliest on ties."""
    best = F.max_by(F.struct(start, end), F.struct(F.col(end) - F.col(start), -F.col(start)))
    return ranges.groupBy(*keys).agg(best.alias("_m")).select(*keys, f"_m.{start}", f"_m.{end}")
