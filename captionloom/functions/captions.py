"""Column functions on captions: language choice, composing, time rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank


def select_lang(content: Column, lang: str) -> Column:
    """First line (``en``) or the rest (``zh``) of a multi-line caption; single lines stay."""
    first = F.substring_index(content, "\n", 1)
    part = {"en": first, "zh": F.substr(content, F.length(first) + 2), "all": content}[lang]
    return F.when(F.locate("\n", content) > 0, part).otherwise(content)


def compose_content(source: Column, target: Column, output: str) -> Column:
    """``bilingual``, ``target`` or ``source`` text; without a translation the source stands alone."""
    target = F.coalesce(target, F.lit(""))
    if output == "bilingual":
        return F.when(target != "", F.concat_ws("\n", source, target)).otherwise(source)
    if output == "target":
        return F.when(target != "", target).otherwise(source)
    return source


def is_valid(start_ms: Column, end_ms: Column, content: Column) -> Column:
    return (start_ms < end_ms) & ~is_blank(content)


def _parts(ms: Column):
    return ms.cast("bigint"), F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60


def srt_time(ms: Column) -> Column:
    ms, h, m, s = _parts(ms)
    return F.format_string("%02d:%02d:%02d,%03d", h, m, s, ms % 1000)


def vtt_time(ms: Column) -> Column:
    ms, h, m, s = _parts(ms)
    return F.format_string("%02d:%02d:%02d.%03d", h, m, s, ms % 1000)


def clock_time(ms: Column) -> Column:
    """``H:MM:SS`` with six decimals only where there is a fraction (days as ``N day(s), ``)."""
    ms, h, m, s = _parts(ms)
    days = F.floor(h / 24)
    day = F.when(days == 0, "").when(days == 1, "1 day, ").otherwise(F.format_string("%d days, ", days))
    frac = F.when(ms % 1000 == 0, "").otherwise(F.format_string(".%03d000", ms % 1000))
    return F.concat(day, F.format_string("%d:%02d:%02d", h % 24, m, s), frac)


def ass_time(ms: Column) -> Column:
    """Whole centiseconds (rounded half up), so that 59.996 s becomes the next minute."""
    cs = F.floor((ms + 5) / 10).cast("bigint")
    return F.format_string(
        "%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def srt_stamp_to_ms(text: Column) -> Column:
    """``HH:MM:SS,mmm`` (comma or point, fraction optional) to milliseconds; null when malformed."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d+):(\d+):(\d+)(?:[,.](\d{1,3}))?\s*$", i)
    frac = F.rpad(part(4), 3, "0")
    whole = (part(1).cast("bigint") * 3600 + part(2).cast("bigint") * 60 + part(3).cast("bigint")) * 1000
    return F.when(part(1) != "", whole + F.when(part(4) == "", 0).otherwise(frac.cast("bigint")))
