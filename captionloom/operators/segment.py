"""Word streams to utterances, sentences and packed lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, collapse, split_on, strip
from .scan import WIDTH, gap_blocks, gap_groups, machine_entry, ordered_scan, with_rank

KEYS = ("rec_id",)


# ------------------------------------------------------------------ words and segments

def explode_words(transcripts: DataFrame) -> DataFrame:
    """Nested recognizer results to one row per word; blank words are skipped, a missing end is the start.

    ``word_idx`` numbers the words of a (recording, chunk) from 0.
    """
    segs = transcripts.select("rec_id", "chunk_id", F.posexplode("segments").alias("seg_idx", "seg"))
    rows = segs.select(
        "rec_id", "chunk_id", F.col("seg_idx").cast("bigint").alias("seg_idx"),
        F.posexplode("seg.words").alias("pos", "w"))
    rows = rows.select(
        "rec_id", "chunk_id", "seg_idx", F.col("pos").cast("bigint").alias("pos"),
        strip(F.coalesce("w.word", F.lit(""))).alias("word"),
        F.round(F.coalesce("w.start", F.lit(0.0)) * 1000).cast("bigint").alias("start_ms"),
        F.round(F.coalesce("w.end", "w.start", F.lit(0.0)) * 1000).cast("bigint").alias("end_ms"),
    ).filter("word <> ''")
    ranked = with_rank(rows, ["rec_id", "chunk_id"], ["seg_idx", "pos"], "word_idx", start=0)
    return ranked.select("rec_id", "chunk_id", "seg_idx", "word_idx", "word", "start_ms", "end_ms")


def segment_bounds(words: DataFrame, keys: Sequence[str] = ("rec_id", "chunk_id", "seg_idx")) -> DataFrame:
    """First and last word index and time per recognizer segment."""
    return words.groupBy(*keys).agg(
        F.min("word_idx").alias("start_word_idx"), F.max("word_idx").alias("end_word_idx"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def rebuild_text(words: DataFrame, keys: Sequence[str] = ("rec_id", "chunk_id", "seg_idx")) -> DataFrame:
    """Words of a group joined by blanks; one group is one caption-sized text, not a whole corpus."""
    listed = F.array_sort(F.collect_list(F.struct("word_idx", "word")))
    return words.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["word"]), " ").alias("text"))


def split_by_gap(words: DataFrame, max_gap_ms: int = 3000, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """Add ``utt_id``: a pause longer than ``max_gap_ms`` opens a new utterance."""
    return gap_groups(words, keys, "word_idx", "start_ms", "end_ms", max_gap_ms, **kw)


def utterances(words: DataFrame, max_gap_ms: int = 3000, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    """Bounds of the utterances of ``split_by_gap``."""
    return split_by_gap(words, max_gap_ms, keys, **kw).groupBy(*keys, "utt_id").agg(
        F.min("word_idx").alias("start_word_idx"), F.max("word_idx").alias("end_word_idx"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.count(F.lit(1)).alias("n_words"))


# ------------------------------------------------------------------ greedy packing

def _pack_regex(max_chars: int) -> str:
    # the longest run of up to max_chars that ends with a word; a longer word stands alone
    inner = f"(?:.{{0,{max_chars - 2}}}[^ ])?" if max_chars > 1 else ""
    return rf"(?s)[^ ]{inner}(?![^ ])|[^ ]+"


def pack_words(text: Column, max_chars: int = 80) -> Column:
    """Greedy first-fit packing of a text into lines, as an array; no word is lost."""
    return F.regexp_extract_all(collapse(text), F.lit(_pack_regex(max_chars)), F.lit(0))


def _line_structs(lines: Column) -> Column:
    """Lines with the index of their first token and their token count."""
    start = F.expr("cast(array() as array<struct<line:string,first:int,n:int>>)")
    return F.aggregate(
        lines,
        F.struct(F.lit(0).alias("k"), start.alias("out")),
        lambda acc, line: F.struct(
            (acc["k"] + F.size(F.split(line, " "))).alias("k"),
            F.array_append(acc["out"], F.struct(
                line.alias("line"), acc["k"].alias("first"), F.size(F.split(line, " ")).alias("n"))).alias("out")),
    )["out"]


def pack_utterances(
    words: DataFrame,
    max_gap_ms: int = 3000,
    max_chars: int = 80,
    keys: Sequence[str] = KEYS,
    *,
    width: int = WIDTH,
    depth: int = 2,
) -> DataFrame:
    """Utterances by pause, each packed greedily into lines with the words' times.

    The words are shuffled once, by (key, block of ``width`` word positions); gaps, grouping and
    packing all use that layout. Each block also gets copies of the next block's first words, so
    that it can finish its last line. An utterance that runs over block borders enters the later
    blocks with an open line; its length there comes from ``machine_entry``, whose states are the
    lengths 0..max_chars. So no utterance, however long, is collected as a whole.
    """
    keys = list(keys)
    halo = max_chars // 2 + 1
    width = max(width, 2 * halo)
    slim = words.select(*keys, "word_idx", "word", "start_ms", "end_ms")
    rows, blocks = gap_blocks(
        slim, keys, "word_idx", "start_ms", "end_ms", max_gap_ms, name="utt_id", width=width, depth=depth, halo=halo)
    listed = F.array_sort(F.collect_list(F.struct("word_idx", "word", "start_ms", "end_ms")))
    runs = rows.groupBy(*keys, "_blk", "utt_id").agg(
        listed.alias("ws"), F.count_if("_own").cast("int").alias("n_own")).filter("n_own > 0")

    if depth == 0:
        runs = runs.withColumn("s", F.lit(0))
    else:
        entry = _open_lines(slim, blocks, keys, max_gap_ms, max_chars, width, depth)
        runs = runs.join(entry, [*keys, "_blk", "utt_id"], "left").withColumn("s", F.coalesce("entry_state", F.lit(0)))

    text = F.array_join(F.expr("transform(ws, w -> w.word)"), " ")
    filled = F.when(F.col("s") > 0, F.concat(F.expr("repeat('x', s)"), F.lit(" "), text)).otherwise(text)
    runs = runs.withColumn("lines", F.regexp_extract_all(filled, F.lit(_pack_regex(max_chars)), F.lit(0)))
    runs = runs.withColumn("line", F.explode(_line_structs(F.col("lines"))))
    # an open line at the head belongs to the block before; the filler is one token
    runs = runs.withColumn("first", F.expr("if(s > 0, line.first - 1, line.first)")).filter(
        "first >= 0 and first < n_own")
    return runs.select(
        *keys, "utt_id",
        F.expr("ws[first].word_idx").alias("start_word_idx"),
        F.expr("ws[first + line.n - 1].word_idx").alias("end_word_idx"),
        F.expr("ws[first].start_ms").alias("start_ms"),
        F.expr("ws[first + line.n - 1].end_ms").alias("end_ms"),
        F.expr("line.line").alias("text"))


def _open_lines(words, blocks, keys, max_gap_ms, max_chars, width, depth):
    """Length of the open line with which an utterance enters its second and later blocks."""
    prev = ordered_scan(blocks, keys, ["_blk"], lasts={"_before": F.col("_last")}, width=width, depth=depth - 1)
    open_utts = prev.filter("_before = _first").select(*keys, F.col("_first").alias("utt_id")).distinct()
    # only word lengths matter here, so the words themselves are not shuffled again
    slim = words.select(*keys, "word_idx", F.length("word").alias("size"), "start_ms", "end_ms")
    rows, _ = gap_blocks(
        slim, keys, "word_idx", "start_ms", "end_ms", max_gap_ms, name="utt_id", width=width, depth=depth)
    listed = F.array_sort(F.collect_list(F.struct("word_idx", "size")))
    runs = rows.join(open_utts, [*keys, "utt_id"], "left_semi").groupBy(*keys, "utt_id", "_blk").agg(
        F.array_join(F.transform(listed, lambda x: F.repeat(F.lit("x"), x["size"])), " ").alias("t"))
    pattern = _pack_regex(max_chars).replace("\\", "\\\\")
    step = F.expr(
        f"transform(sequence(0, {max_chars}), s -> least({max_chars}, length(element_at(regexp_extract_all("
        f"if(s > 0, concat(repeat('x', s), ' ', t), t), '{pattern}', 0), -1))))")
    return machine_entry(runs.withColumn("_map", step), [*keys, "utt_id"], "_blk", "_map", depth=depth).filter("entry_state > 0")


def reindex(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "cue_idx", **kw) -> DataFrame:
    """Dense numbers 1..n per key in the given order."""
    return with_rank(df.drop(name), keys, order, name, **kw)


# ------------------------------------------------------------------ sentences

def sentences_by_rule(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` runs followed by white space; the marks stay left."""
    parts = split_on(text, rf"([.!?])[{SPACE}]+", "$1")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences_by_rule_caps(text: Column) -> Column:
    """Split at marks followed by white space and an upper-case Latin letter; add a missing full stop."""
    parts = F.filter(F.transform(split_on(text, rf"[.!?]+[{SPACE}]+(?=[A-Z])"), strip), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.rlike("[.!?]$"), p).otherwise(F.concat(p, F.lit("."))))
