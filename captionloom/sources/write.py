"""Writers: captions as SRT, VTT, ASS, TXT and JSON.

A caption file is rendered block by block. ``write_blocks`` range-partitions the blocks by recording
and position, so a long recording becomes several part files whose names are in order; no recording is
gathered in one row or one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.captions import ass_time, clock_time, is_valid, srt_time, vtt_time
from ..functions.text import sub
from ..operators.scan import with_rank
from ..session import path_exists

# fixed value: head of an ASS file
ASS_HEAD = """[Script Info]
Title: Generated Subtitles
ScriptType: v4.00+

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,2,2,10,10,10,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""
HEADS = {"vtt": "WEBVTT\n\n", "ass": ASS_HEAD}


def legal_content(content: Column) -> Column:
    """No empty lines inside a cue, none around it."""
    return sub(sub(content, r"^\n+|\n+$", ""), r"\n\n+", "\n")


def srt_cues(cues: DataFrame, keys: Sequence[str] = ("rec_id",), order: Sequence[str] = ("chunk_id", "cue_idx"), **kw) -> DataFrame:
    """Sound cues by start, end and given order, numbered from 1 (``index``): what an SRT file holds."""
    sound = cues.filter(is_valid(F.col("start_ms"), F.col("end_ms"), F.col("content")) & (F.col("start_ms") >= 0))
    return with_rank(sound, keys, ["start_ms", "end_ms", *order], "index", **kw)


def srt_block(index: Column, start: Column, end: Column, content: Column) -> Column:
    return F.concat(index.cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"),
                    legal_content(content), F.lit("\n\n"))


def txt_block(start: Column, end: Column, content: Column) -> Column:
    return F.concat(F.lit("["), clock_time(start), F.lit(" --> "), clock_time(end), F.lit("]\n"), content, F.lit("\n\n"))


def vtt_block(start: Column, end: Column, content: Column, compat: bool = False) -> Column:
    """Valid VTT times; ``compat`` writes the unpadded clock form."""
    t = clock_time if compat else vtt_time
    return F.concat(t(start), F.lit(" --> "), t(end), F.lit("\n"), content, F.lit("\n\n"))


def ass_block(start: Column, end: Column, content: Column) -> Column:
    return F.concat(F.lit("Dialogue: 0,"), ass_time(start), F.lit(","), ass_time(end), F.lit(",Default,,0,0,0,,"),
                    F.replace(content, F.lit("\n"), F.lit("\\N")), F.lit("\n"))


def json_text(value: Column) -> Column:
    packed = F.to_json(F.struct(value.alias("v")))
    return F.substr(packed, F.lit(6), F.length(packed) - 6)


def json_block(index: Column, start: Column, end: Column, content: Column) -> Column:
    """One object of the indented array."""
    return F.concat(
        F.lit('  {\n    "index": '), index.cast("string"), F.lit(',\n    "start": "'), clock_time(start),
        F.lit('",\n    "end": "'), clock_time(end), F.lit('",\n    "content": '), json_text(content), F.lit("\n  }"))


def render(cues: DataFrame, fmt: str, index: str = "cue_idx", compat: bool = False) -> DataFrame:
    """Adds ``block``, the text of each cue in the format."""
    s, e, c = F.col("start_ms"), F.col("end_ms"), F.col("content")
    block = {
        "srt": lambda: srt_block(F.col(index), s, e, c), "txt": lambda: txt_block(s, e, c),
        "vtt": lambda: vtt_block(s, e, c, compat), "ass": lambda: ass_block(s, e, c),
        "json": lambda: json_block(F.col(index), s, e, c),
    }[fmt]()
    return cues.withColumn("block", block)


def write_blocks(
    cues: DataFrame, path: str, fmt: str = "srt", keys: Sequence[str] = ("rec_id",),
    order: Sequence[str] = ("chunk_id", "cue_idx"), mode: str = "errorifexists", dynamic: bool = False, **kw,
) -> None:
    """Write each recording (or each chunk, with ``keys`` to match) as a folder of ordered part files.

    SRT cues are filtered, sorted by start and numbered; the other formats keep the given order. ``dynamic`` with mode
    ``overwrite`` replaces the folders that get rows and leaves the others. ``files.write_files`` writes whole files.
    """
    from .files import can_write_folders, write_folders

    keys, order = list(keys), list(order)
    if fmt == "srt":
        rows, rank = srt_cues(cues, keys, order, **kw), "index"
    else:
        rows, rank = with_rank(cues, keys, order, "_rank", **kw), "_rank"
    rows = render(rows, fmt, rank)
    head = HEADS.get(fmt)
    if fmt == "json":
        from ..operators.scan import join_totals
        size = rows.groupBy(*keys).agg(F.max(rank).alias("_n"))
        rows = join_totals(rows, size, keys, [rank])
        rows = rows.withColumn("block", F.concat(
            F.when(F.col(rank) == 1, "[\n").otherwise(""), F.col("block"),
            F.when(F.col(rank) == F.col("_n"), "\n]").otherwise(",\n")))
    elif head:
        rows = rows.withColumn("block", F.when(F.col(rank) == 1, F.concat(F.lit(head), F.col("block"))).otherwise(F.col("block")))
    # the writer adds the last line end of each block
    value = sub(F.col("block"), r"\n\z", "").alias("value")
    if dynamic and mode == "overwrite" and can_write_folders(rows, path, keys):
        write_folders(rows, path, keys, [rank], value)
        return
    rows = rows.repartitionByRange(*keys, rank).sortWithinPartitions(*keys, rank)
    way = "dynamic" if dynamic else "static"
    rows.select(*keys, value).write.mode(mode).option("partitionOverwriteMode", way).partitionBy(*keys).text(path)


def write_chunks(cues: DataFrame, path: str, fmt: str = "srt", **kw) -> None:
    """One folder per (recording, chunk); rewriting some chunks leaves the others alone."""
    write_blocks(cues, path, fmt, ("rec_id", "chunk_id"), ("cue_idx",), mode="overwrite", dynamic=True, **kw)


def write_chunk_timing(timing: DataFrame, path: str) -> None:
    """Chunk manifest as JSON lines, a folder per recording."""
    from .files import can_write_folders, write_folders

    rows = timing.select(
        "rec_id", F.col("chunk_id").alias("chunk_index"), F.col("start_ms").alias("start_time_ms"),
        F.col("end_ms").alias("end_time_ms"), "duration_ms")
    if can_write_folders(rows, path, ["rec_id"]) and not path_exists(timing.sparkSession, path):
        write_folders(rows, path, ["rec_id"], ["chunk_index"], F.to_json(F.struct(*rows.columns[1:])), ".json")
    else:
        rows.repartition("rec_id").write.partitionBy("rec_id").json(path)


def merged_name(name: Column, subfolder: Column | None = None, lang: str = "all") -> Column:
    """``name[_subfolder]_merged[_lang].srt``."""
    base = name if subfolder is None else F.concat_ws("_", name, subfolder)
    return F.concat(base, F.lit("_merged" + ("" if lang == "all" else f"_{lang}") + ".srt"))
