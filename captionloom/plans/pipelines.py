"""Composite pipelines over the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.captions import compose_content
from ..functions.models import BOUNDS, checked
from ..functions.text import (
    clean_case, clean_srt_text, explode_parts, extract_code_block, finalize, is_blank, punct_plausible, punctuate_labels,
    punctuate_rule, strip, tokens,
)
from ..operators import align, lookup, merge, segment, split, timing
from ..operators.scan import with_rank
from ..session import materialize
from ..sources.read import parse_srt_text
from ..sources.write import srt_block

CHUNK = ("rec_id", "chunk_id")


# ------------------------------------------------------------------ sentences

def sentences(
    words: DataFrame, segments: DataFrame, strategy: str = "rule", keys: Sequence[str] = CHUNK,
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``keys, sent_idx, text``: recognizer segments (``segments``), rules (``rule``) or a plugged-in
    model (a column function giving ``array<string>``, such as an iterator pandas UDF)."""
    if strategy == "segments":
        return segments.filter(~is_blank(F.col("text"))).select(*keys, F.col("seg_idx").alias("sent_idx"), strip(F.col("text")).alias("text"))
    cut = model or segment.sentences_by_rule
    texts = segment.rebuild_text(words, keys)
    return explode_parts(texts, cut(F.col("text")), "sent_idx", "text", keys).withColumn("sent_idx", F.col("sent_idx").cast("bigint"))


def with_bounds(sents: DataFrame, words: DataFrame, segments: DataFrame, keys: Sequence[str] = CHUNK) -> DataFrame:
    """Adds ``bounds``: where recognizer segments begin inside a sentence, as token offsets. The sentences must be cuts
    of the chunk's words in order, so their token counts tell which words they hold."""
    keys = list(keys)
    first = words.groupBy(*keys).agg(F.min("word_idx").alias("_lo"))
    begins = segments.join(first, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_set((F.col("start_word_idx") - F.col("_lo")).cast("int"))).alias("_begin"))
    n = F.size(tokens(F.col("text")))
    upto = Window.partitionBy(*keys).orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = sents.withColumn("_n", n).withColumn("_at", F.sum("_n").over(upto).cast("int") - F.col("_n")).join(begins, keys, "left")
    inside = F.filter(F.transform("_begin", lambda b: b - F.col("_at")), lambda b: (b > 0) & (b < F.col("_n")))
    return rows.withColumn("bounds", inside).drop("_n", "_at", "_begin")


def bounded_sentences(
    sents: DataFrame, max_chars: int, profile: str, compat: bool = False, before: Column | None = None, bounds: Column | None = None,
) -> DataFrame:
    """Length-bounded parts as sentences again; ``sent_idx`` keeps their order."""
    max_chars = int(checked(max_chars, *BOUNDS["max_chars"], "max_chars"))
    parts = split.enforce_length(sents, "text", max_chars, profile, compat, before, bounds)
    order = F.struct("sent_idx", "part_idx")
    keys = [c for c in sents.columns if c not in ("sent_idx", "text")]
    # parts of a chunk are as bounded as the chunk itself
    rank = F.row_number().over(Window.partitionBy(*[k for k in CHUNK if k in keys]).orderBy(order)) - 1
    return parts.withColumn("_r", rank.cast("bigint")).select(
        *[k for k in CHUNK if k in keys], F.col("_r").alias("sent_idx"), F.col("part").alias("text"),
        *[k for k in keys if k not in CHUNK])


def _fallback(aligned: DataFrame, words: DataFrame, mode: str, keys: Sequence[str] = CHUNK) -> DataFrame:
    first = words.groupBy(*keys).agg(
        F.min_by("start_ms", "word_idx").alias("_fs"), F.min_by("end_ms", "word_idx").alias("_fe"))
    # the scans below read their input more than once; the kernels must not run again for it
    rows = materialize(aligned, "aligned").join(first, list(keys), "left")
    return timing.fallback_times(rows, keys, ["sent_idx"], mode, "text", "_fs" if mode != "b" else None,
                                 "_fe" if mode == "c" else None, depth=1).drop("_fs", "_fe")


def captions(
    words: DataFrame, segments: DataFrame, strategy: str = "rule", max_chars: int = 80, compat: bool = False,
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Sentences, bounded by the first profile (with the segments' borders where punctuation gives no cut), aligned
    monotonically; unmatched ones placed after the last."""
    sents = sentences(words, segments, strategy, model=model)
    if strategy == "rule" and model is None:
        sents = bounded_sentences(with_bounds(sents, words, segments), max_chars, "a", compat, bounds=F.col("bounds")).drop("bounds")
    else:
        sents = bounded_sentences(sents, max_chars, "a", compat)
    return _fallback(align.align_monotonic(sents, words), words, "a")


def captions_on_ranges(words: DataFrame, segments: DataFrame, max_chars: int = 80, profile: str = "plain", keys: Sequence[str] = CHUNK) -> DataFrame:
    """As ``captions`` for texts made of the words themselves: the parts' word ranges are carried through
    the splitters and give the times, so nothing is searched.

    A part covers the words that hold its first and last non-blank character.
    """
    keys = list(keys)
    texts = segment.rebuild_text(words, keys)
    sents = explode_parts(texts, segment.sentences_by_rule(F.col("text")), "sent_idx", "text", keys)
    parts = split.enforce_length(sents, "text", max_chars, profile)
    size = F.length(F.replace(F.col("part"), F.lit(" "), F.lit(""))).cast("bigint")
    run = Window.partitionBy(*keys).orderBy("sent_idx", "part_idx").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumns({"_to": F.sum(size).over(run), "_n": F.row_number().over(
        Window.partitionBy(*keys).orderBy("sent_idx", "part_idx"))})
    parts = parts.withColumn("_from", F.col("_to") - size)
    upto = Window.partitionBy(*keys).orderBy("word_idx").rowsBetween(Window.unboundedPreceding, 0)
    chars = words.withColumn("_to", F.sum(F.length("word").cast("bigint")).over(upto)).withColumn(
        "_from", F.col("_to") - F.length("word"))
    # both sides share character buckets, so the range test only meets words near the part
    step = 4 * max_chars
    left = parts.withColumn("_b", F.explode(F.expr(f"sequence(_from div {step}, (_to - 1) div {step})")))
    right = chars.select(*keys, "word_idx", "start_ms", "end_ms", F.col("_from").alias("_wf"), F.col("_to").alias("_wt")).withColumn(
        "_b", F.explode(F.expr(f"sequence(_wf div {step}, (_wt - 1) div {step})")))
    hit = left.join(right, [*keys, "_b"]).filter("_wf < _to and _wt > _from")
    return hit.groupBy(*keys, F.col("_n").alias("cue_idx"), F.col("part").alias("text")).agg(
        F.min("word_idx").alias("start_word_idx"), F.max("word_idx").alias("end_word_idx"),
        F.min_by("start_ms", "word_idx").alias("start_ms"), F.max_by("end_ms", "word_idx").alias("end_ms"),
    ).withColumn("cue_idx", F.col("cue_idx").cast("bigint"))


def pause_captions(
    words: DataFrame, max_chars: int = 80, max_gap_ms: int = 3000, compat: bool = False,
    model: Callable[[Column], Column] | None = None, keys: Sequence[str] = CHUNK,
) -> DataFrame:
    """Pause-aware variant: utterances, sentences inside them, cuts at pauses, recognizer boundaries (where ``words`` have a
    ``seg_idx``) and grammar, free-window alignment, two-second fallback, ends clipped to the last word."""
    keys = list(keys)
    utts = segment.split_by_gap(words, max_gap_ms, keys, depth=1)
    known = ["seg_idx"] if "seg_idx" in words.columns else []
    listed = F.array_sort(F.collect_list(F.struct("word_idx", "word", "start_ms", "end_ms", *known)))
    texts = utts.groupBy(*keys, "utt_id").agg(listed.alias("ws")).withColumn(
        "text", F.array_join(F.transform("ws", lambda w: w["word"]), " "))
    cut = model or segment.sentences_by_rule_caps
    sents = explode_parts(texts, cut(F.col("text")), "_i", "text", [*keys, "utt_id", "ws"])
    # words of the sentence, by token count inside the utterance
    upto = Window.partitionBy(*keys, "utt_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    n = F.size(tokens(F.col("text")))
    sents = sents.withColumn("_end", F.sum(n).over(upto)).withColumn(
        "ws", F.slice("ws", (F.col("_end") - n + 1).cast("int"), n))
    sents = sents.withColumn("sent_idx", F.col("utt_id") * F.lit(1 << 32) + F.col("_i")).drop("_i", "_end", "utt_id")
    pauses = split.split_by_pauses(F.col("ws"), 1000, 10, compat)
    bounds = None
    if known:  # a word of another segment than the one before it
        places = F.when(F.size("ws") > 1, F.sequence(F.lit(1), F.size("ws") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        bounds = F.filter(places, lambda i: F.get("ws", i)["seg_idx"] != F.get("ws", i - 1)["seg_idx"])
    parts = bounded_sentences(sents, max_chars, "b", compat, pauses, bounds).drop("ws")
    out = _fallback(align.align_unused_robust(parts, words, keys), words, "b", keys)
    return timing.clip_to_end(out, words, keys)


def simple_captions(words: DataFrame, max_chars: int = 80, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sentences, greedy grammar cuts, exact-then-best alignment; unmatched rows at 0..0."""
    sents = sentences(words, words, "rule", model=model)
    parts = bounded_sentences(sents, max_chars, "c")
    return timing.fallback_times(align.align_unused_simple(parts, words), list(CHUNK), ["sent_idx"], "d")


def captions_fallback(segments: DataFrame, words: DataFrame | None = None, max_chars: int = 80, profile: str = "d", **kw) -> DataFrame:
    """Segments without words: rule punctuation, length rules, proportional times (or word times where the
    segment has words), repair, default fields."""
    rows = segments.filter(~is_blank(F.col("text"))).select(
        *CHUNK, "seg_idx", "start_ms", "end_ms", punctuate_rule(F.col("text")).alias("text"))
    parts = split.enforce_length(rows, "text", max_chars, profile)
    # the whole text would be stored with each of its parts
    parts = timing.time_proportional(materialize(parts.drop("text"), "parts"), [*CHUNK, "seg_idx"], ["part_idx"])
    parts = parts.drop("start_ms", "end_ms", "text").withColumnsRenamed(
        {"part_start_ms": "start_ms", "part_end_ms": "end_ms", "part": "text"})
    if words is not None:
        seg = parts.select(*CHUNK, "seg_idx", F.col("part_idx").alias("sent_idx"), "text")
        inside = lookup.words_in_segment(segments, words).join(segments.select("rec_id", "chunk_id", "seg_idx"), ["rec_id", "seg_idx"])
        exact = align.align_best_sequence(seg, inside, [*CHUNK, "seg_idx"])
        exact = timing.fallback_times(materialize(exact, "exact"), [*CHUNK, "seg_idx"], ["sent_idx"], "c", depth=0)
        exact = exact.select(*CHUNK, "seg_idx", F.col("sent_idx").alias("part_idx"), F.col("start_ms").alias("_s"),
                             F.col("end_ms").alias("_e"), F.col("confidence").alias("timing_confidence"))
        parts = parts.join(exact, [*CHUNK, "seg_idx", "part_idx"], "left").withColumns(
            {"start_ms": F.coalesce("_s", "start_ms"), "end_ms": F.coalesce("_e", "end_ms")}).drop("_s", "_e")
        parts = materialize(parts, "timed")
    parts = timing.repair_times(parts, list(CHUNK), ["seg_idx", "part_idx"], **kw)
    parts = parts.withColumn("_w", F.lit(words is not None))
    return timing.default_fields(parts, "_w").drop("_w")


def char_captions(words: DataFrame, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sentences located in the cleaned chunk text, each at its own place; those without one have -1 and null times."""
    return align.char_places(sentences(words, words, "rule", model=model), words)


def plain_fallback(segments: DataFrame) -> DataFrame:
    """Segment texts with rule punctuation, blank ones dropped."""
    return segments.filter(~is_blank(F.col("text"))).withColumn("text", punctuate_rule(F.col("text")))


def punctuate_segments(segments: DataFrame, labels: Callable[[Column], Column]) -> DataFrame:
    """Per segment: cleaned tokens with predicted marks if their density is plausible, else the source text."""
    toks = tokens(clean_case(F.col("text")))
    rows = segments.withColumn("_t", toks).withColumn("_new", punctuate_labels(F.col("_t"), labels(F.col("_t"))))
    ok = punct_plausible(F.col("_new"), F.size("_t"))
    return rows.withColumn("text", F.when(ok, F.col("_new")).otherwise(F.col("text"))).drop("_t", "_new")


# ------------------------------------------------------------------ finish, translate, reprocess

def finish(
    parts: DataFrame, glossary: DataFrame, timing_table: DataFrame, output: str = "source", translate: bool = False,
    translator: Callable[[Column], Column] | None = None, text: str = "text",
) -> DataFrame:
    """Glossary, translation, trailing marks, composed content, absolute time, validation."""
    rows = parts.withColumn(text, strip(F.col(text))).filter(F.col(text) != "")
    rows = lookup.apply_glossary(rows, glossary.filter("kind = 'exact_replace'"), text)
    if translate:
        rows = lookup.pretranslate(rows, glossary.filter("kind = 'pre_translate'"), text, "translated", translator)
    else:
        rows = rows.withColumn("translated", F.lit(""))
    rows = rows.withColumn("content", compose_content(finalize(F.col(text)), finalize(F.col("translated")), output))
    rows = lookup.chunk_offset(rows.filter("end_ms > start_ms"), timing_table)
    return merge.absolute_time(rows).drop("offset_ms", "translated", text)


# what stands before and after the captions of a batch in a request; a caller's client may want its own
REQUEST = (
    "Translate the captions below. Keep their number, order and times; below each source line put its translation.\n\n",
    "\nAnswer in SRT format and with nothing else.",
)


def batch_prompts(cues: DataFrame, size: int = 5, request: tuple[str, str] = REQUEST, **kw) -> tuple[DataFrame, DataFrame]:
    """``(cues with batch_id and pos, one row per batch with its prompt)``; ``request``: texts around the captions."""
    size = int(checked(size, *BOUNDS["batch_size"], "size"))
    rows = merge.batch_cues(cues, size, **kw)
    block = srt_block(F.col("pos") + 1, F.col("start_ms"), F.col("end_ms"), F.col("content"))
    listed = F.array_sort(F.collect_list(F.struct("pos", block.alias("b"))))
    body = F.array_join(F.transform(listed, lambda x: x["b"]), "")
    return rows, rows.groupBy("rec_id", "batch_id").agg(F.concat(F.lit(request[0]), body, F.lit(request[1])).alias("prompt"))


def translate_batches(
    cues: DataFrame, client: Callable[[str], str | None], size: int = 5, bilingual: bool = True, clean: bool = True,
    request: tuple[str, str] = REQUEST, **kw,
) -> DataFrame:
    """Batches of captions through a text client; answers get the source times, failed batches keep the source.

    ``client`` (prompt to response, ``None`` on failure) runs in the tasks, a batch at a time. Its responses
    are written once, so that a recomputed task never asks again.
    """
    rows, prompts = batch_prompts(cues, size, request, **kw)

    def ask(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"rec_id": pdf["rec_id"], "batch_id": pdf["batch_id"],
                                "response": [client(p) for p in pdf["prompt"]]})

    schema = T.StructType([prompts.schema["rec_id"], prompts.schema["batch_id"], T.StructField("response", T.StringType())])
    replies = materialize(prompts.mapInPandas(ask, schema), "responses")
    body = extract_code_block(F.col("response"))
    body = clean_srt_text(body) if clean else body
    parsed = parse_srt_text(replies.filter("response is not null and response <> ''").withColumn("_srt", body), "_srt")
    # read by the answers and by both uses of the failed batches, each in all levels of the numbering below
    parsed = materialize(parsed.select("rec_id", "batch_id", "pos", "start_ms", "end_ms", "content", "_corrupt"), "parsed")
    # no response or one that is not caption text fails the batch; a response without cues is an empty answer
    failed = replies.filter("response is null or response = ''").select("rec_id", "batch_id").unionByName(
        parsed.filter("_corrupt is not null").select("rec_id", "batch_id")).distinct()
    answers = parsed.select("rec_id", "batch_id", "pos", "start_ms", "end_ms", "content").join(
        failed, ["rec_id", "batch_id"], "left_anti")
    answers = lookup.restore_timing(rows, answers)
    if bilingual:
        source = rows.select("rec_id", "batch_id", "pos", F.col("content").alias("_src"))
        answers = answers.join(source, ["rec_id", "batch_id", "pos"], "left").withColumn(
            "content", lookup.fix_bilingual(F.col("content"), F.col("_src"))).drop("_src")
    out = lookup.keep_failed(rows, answers, failed)
    return with_rank(materialize(out, "answers"), ["rec_id"], ["batch_id", "pos"], "cue_idx", **kw)


def reprocess(old: DataFrame, words: DataFrame, glossary: DataFrame, timing_table: DataFrame, spec: str, max_chars: int = 80, **kw) -> DataFrame:
    """Redo the named chunks with the pause-aware pipeline and merge by start time."""
    chosen = merge.select_chunks(timing_table, spec)
    redo = words.join(chosen, list(CHUNK), "left_semi")
    parts = pause_captions(redo, max_chars)
    # word times are absolute here, the table of starts only validates the chunk
    none = timing_table.withColumn("start_ms", F.lit(0).cast("bigint"))
    new = finish(parts.select(*CHUNK, F.col("sent_idx").alias("cue_idx"), "start_ms", "end_ms", "text"), glossary, none)
    columns = [*CHUNK, "cue_idx", "start_ms", "end_ms", "content"]
    both = merge.replace_chunks(old.select(*columns), new.select(*columns))
    return merge.merge_chunks(both, "all", merge.TIME_ORDER, **kw)


def run_recordings(words: DataFrame, segments: DataFrame, timing_table: DataFrame, max_chars: int = 80) -> tuple[DataFrame, DataFrame]:
    """All recordings in one job: captions, and per chunk a status row. A chunk without captions is an
    error row and gets a placeholder cue, nothing is aborted."""
    cues = captions(words, segments, "segments", max_chars).select(
        *CHUNK, F.col("sent_idx").alias("cue_idx"), "start_ms", "end_ms", F.col("text").alias("content"))
    counts = cues.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("n_cues"))
    runs = timing_table.select(*CHUNK, "duration_ms").join(counts, list(CHUNK), "left").select(
        *CHUNK, F.when(F.col("n_cues") > 0, "ok").otherwise("error").alias("status"),
        F.coalesce("n_cues", F.lit(0).cast("bigint")).alias("n_cues"), "duration_ms")
    return timing.placeholder_cues(timing_table, cues), runs
