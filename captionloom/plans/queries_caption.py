"""Queries on words, segments, captions and chunks: segmentation, timing, quality, merge, sinks, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import captions as cp
from ..operators import lookup, merge, quality, segment, split, timing
from ..operators.scan import with_previous
from ..session import materialize, new_shared_path
from ..sources import files, read, write
from ..streaming import incremental
from . import pipelines
from .fixtures import sql_with
from .queries_text import _SENT_LIST, W, _round, _sql_pack
from .registry import query
from .tables import Tables

CHUNK = ["rec_id", "chunk_id"]
CUE_ORDER = ["chunk_id", "cue_idx"]


def _flat(t: Tables) -> dict:
    """Scan options: one plain window where the checked positions show that a recording fits a block."""
    return {} if t.depth("segments", "seg_idx") else {"depth": 0}


def _word_depth(t: Tables) -> int:
    return t.depth("words", "word_idx")


# ------------------------------------------------------------------ words and segments

query("words", sql_with("words", "select * from words"))(lambda t: t.words)


@query("explode_words", sql_with("words", """select rec_id, chunk_id, seg_idx, row_number() over (partition by rec_id, chunk_id order by word_idx) - 1 word_idx,
 word, start_ms, end_ms from words where word_idx % 11 <> 5"""))
def explode_words(t: Tables) -> DataFrame:
    """Nested transcripts built from the words (some blank), exploded again."""
    w = F.struct(F.when(F.col("word_idx") % 11 == 5, "  ").otherwise(F.concat(F.lit(" "), "word")).alias("word"),
                 (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    segs = t.words.groupBy("rec_id", "chunk_id", "seg_idx").agg(
        F.array_sort(F.collect_list(F.struct("word_idx", w.alias("w")))).alias("ws"))
    seg = F.struct("seg_idx", F.lit("").alias("text"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"),
                   F.transform("ws", lambda x: x["w"]).alias("words"))
    nested = segs.groupBy("rec_id", "chunk_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"))
    out = segment.explode_words(nested)
    ids = segs.select("rec_id", "chunk_id", "seg_idx").groupBy("rec_id", "chunk_id").agg(F.min("seg_idx").alias("s0"))
    return out.join(ids, CHUNK).withColumn("seg_idx", F.col("seg_idx") + F.col("s0")).drop("s0")


@query("segment_bounds", sql_with("segments", "select rec_id, chunk_id, seg_idx, start_word_idx, end_word_idx, start_ms, end_ms from segments"))
def segment_bounds(t: Tables) -> DataFrame:
    return segment.segment_bounds(t.words)


query("rebuild_text", sql_with("segments", "select rec_id, chunk_id, seg_idx, text from segments"))(
    lambda t: segment.rebuild_text(t.words))

_UTT = """utt as (select *, sum(brk) over (partition by rec_id order by word_idx) utt_id from (select *,
 case when start_ms - lag(end_ms) over (partition by rec_id order by word_idx) > 3000 then 1 else 0 end brk from words))"""


@query("split_by_gap", sql_with("words", f"""with {_UTT} select rec_id, cast(utt_id as bigint) utt_id, min(word_idx) start_word_idx,
 max(word_idx) end_word_idx, min(start_ms) start_ms, max(end_ms) end_ms, count(*) n_words from utt group by 1, 2"""))
def split_by_gap(t: Tables) -> DataFrame:
    return segment.utterances(t.words, depth=_word_depth(t))


@query("split_by_gap_blocks", sql_with("words", f"""with {_UTT} select rec_id, cast(utt_id as bigint) utt_id, min(word_idx) start_word_idx,
 max(word_idx) end_word_idx, min(start_ms) start_ms, max(end_ms) end_ms, count(*) n_words from utt group by 1, 2"""))
def split_by_gap_blocks(t: Tables) -> DataFrame:
    """The same through the block plan that long recordings take."""
    return segment.utterances(t.words, width=256, depth=2)


_FLAGSHIP = sql_with("words", f"""with {_UTT},
 listed as (select rec_id, utt_id, list([[word, cast(word_idx as varchar), cast(start_ms as varchar), cast(end_ms as varchar)]] order by word_idx) a
  from utt group by 1, 2),
 packed as (select rec_id, utt_id, list_reduce(a, lambda x, y: case when length(x[-1][1]) + 1 + length(y[1][1]) <= 80
  then x[1:len(x)-1] || [[x[-1][1] || ' ' || y[1][1], x[-1][2], x[-1][3], y[1][4], y[1][2]]]
  else x || [[y[1][1], y[1][2], y[1][3], y[1][4], y[1][2]]] end) p from listed),
 lines as (select rec_id, utt_id, unnest(p) l from packed)
 select rec_id, cast(utt_id as bigint) utt_id, cast(l[2] as bigint) start_word_idx,
  cast(case when len(l) = 5 then l[5] else l[2] end as bigint) end_word_idx, cast(l[3] as bigint) start_ms,
  cast(l[4] as bigint) end_ms, l[1] as text,
  row_number() over (partition by rec_id order by cast(l[2] as bigint)) cue_idx from lines""")


@query("pack_utterances", _FLAGSHIP)
def pack_utterances(t: Tables) -> DataFrame:
    """Flagship: pauses, greedy packing to 80 characters, word times, numbering."""
    depth = _word_depth(t)
    lines = segment.pack_utterances(t.words, depth=depth)
    return segment.reindex(lines, ["rec_id"], ["start_word_idx"], depth=depth)


_ONE_UTT = _FLAGSHIP.replace("> 3000", "> 300000000")


@query("pack_utterances_blocks", _ONE_UTT)
def pack_utterances_blocks(t: Tables) -> DataFrame:
    """A recording as one endless utterance, packed block by block."""
    lines = segment.pack_utterances(t.words, max_gap_ms=300_000_000, width=256, depth=2)
    return segment.reindex(lines, ["rec_id"], ["start_word_idx"], depth=_word_depth(t))


_PAUSES = """with g as (select *, sum(brk) over (partition by rec_id, chunk_id, seg_idx order by word_idx) r from (select *,
 case when start_ms - lag(end_ms) over (partition by rec_id, chunk_id, seg_idx order by word_idx) > 1000 then 1 else 0 end brk from words)),
 p as (select rec_id, chunk_id, seg_idx, r, string_agg(word, ' ' order by word_idx) t from g group by all),
 l as (select rec_id, chunk_id, seg_idx, list_reduce(list([t] order by r), lambda a, b:
  case when length(b[1]) < 10 or length(a[-1]) < 10 then a[1:len(a)-1] || [a[-1] || ' ' || b[1]] else a || b end) a from p group by all)
 select rec_id, chunk_id, seg_idx, generate_subscripts(a, 1) - 1 part_idx, unnest(a) part from l"""


@query("split_by_pauses", sql_with("words", _PAUSES))
def split_by_pauses(t: Tables) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("word_idx", "word", "start_ms", "end_ms")))
    segs = t.words.groupBy(*CHUNK, "seg_idx").agg(listed.alias("ws"))
    return segs.select(*CHUNK, "seg_idx", F.posexplode(split.split_by_pauses(F.col("ws"))).alias("part_idx", "part"))


def _chunk_bounds(t: Tables) -> DataFrame:
    """Chunks as sentences: their tokens, and the token offsets of the segment starts inside."""
    toks = F.array_sort(F.collect_list(F.struct("word_idx", "word")))
    rows = t.words.groupBy(*CHUNK).agg(toks.alias("ws"), F.min("word_idx").alias("w0"), F.collect_set(
        F.struct("seg_idx")).alias("_segs"))
    starts = t.segments.groupBy(*CHUNK).agg(F.array_sort(F.collect_list("start_word_idx")).alias("starts"))
    rows = rows.join(starts, CHUNK)
    return rows.select(*CHUNK, F.transform("ws", lambda x: x["word"]).alias("toks"), F.filter(
        F.transform("starts", lambda s: (s - F.col("w0")).cast("int")), lambda b: b > 0).alias("bounds"))


@query("split_at_bounds", sql_with("segments", """with l as (select rec_id, chunk_id, list(text order by seg_idx) a from segments group by 1, 2)
 select rec_id, chunk_id, generate_subscripts(p, 1) - 1 part_idx, unnest(p) part from (select rec_id, chunk_id,
 case when len(a) > 1 and length(a[1]) between 15 and 400 and length(a[2]) <= 400 then a else [array_to_string(a, ' ')] end p from l)"""))
def split_at_bounds(t: Tables) -> DataFrame:
    return _chunk_bounds(t).select(*CHUNK, F.posexplode(
        split.split_at_bounds(F.col("toks"), F.col("bounds"), 400)).alias("part_idx", "part"))


@query("split_at_bounds_merging", sql_with("segments", """with l as (select rec_id, chunk_id, list(text order by seg_idx) a from segments group by 1, 2)
 select rec_id, chunk_id, generate_subscripts(p, 1) - 1 part_idx, unnest(p) part from (select rec_id, chunk_id,
 case when len(a) > 1 and length(a[1]) between 15 and 400 and length(a[2]) between 15 and 400 then a else [array_to_string(a, ' ')] end p from l)"""))
def split_at_bounds_merging(t: Tables) -> DataFrame:
    return _chunk_bounds(t).select(*CHUNK, F.posexplode(
        split.split_at_bounds_merging(F.col("toks"), F.col("bounds"), 400)).alias("part_idx", "part"))


# ------------------------------------------------------------------ windows

@query("word_gap", sql_with("words", "select rec_id, word_idx, start_ms - lag(end_ms) over (partition by rec_id order by word_idx) gap_ms from words"))
def word_gap(t: Tables) -> DataFrame:
    rows = with_previous(t.words, ["rec_id"], ["word_idx"], {"prev": "end_ms"}, depth=_word_depth(t))
    return rows.select("rec_id", "word_idx", (F.col("start_ms") - F.col("prev")).alias("gap_ms"))


@query("word_gap_blocks", sql_with("words", "select rec_id, word_idx, start_ms - lag(end_ms) over (partition by rec_id order by word_idx) gap_ms from words"))
def word_gap_blocks(t: Tables) -> DataFrame:
    rows = with_previous(t.words, ["rec_id"], ["word_idx"], {"prev": "end_ms"}, width=64, depth=2)
    return rows.select("rec_id", "word_idx", (F.col("start_ms") - F.col("prev")).alias("gap_ms"))


@query("reindex", sql_with("cues", "select rec_id, chunk_id, cue_idx, row_number() over (partition by rec_id order by chunk_id, cue_idx) idx from cues"))
def reindex(t: Tables) -> DataFrame:
    return segment.reindex(t.cues, ["rec_id"], CUE_ORDER, "idx", **_flat(t)).select(*CHUNK, "cue_idx", "idx")


@query("mark_overlaps", sql_with("cues", """select *, coalesce(start_ms < prev_end_ms, false) overlap from (select *,
 lag(end_ms) over (partition by rec_id order by chunk_id, cue_idx) prev_end_ms from cues)"""))
def mark_overlaps(t: Tables) -> DataFrame:
    return merge.mark_overlaps(t.cues, **_flat(t))


@query("repeated_neighbours", sql_with("cues", """select rec_id, chunk_id, cue_idx, coalesce(trim(content) =
 lag(trim(content)) over (partition by rec_id order by chunk_id, cue_idx), false) repeated from cues"""))
def repeated_neighbours(t: Tables) -> DataFrame:
    rows = t.cues.withColumn("c", F.trim("content"))
    rows = with_previous(rows, ["rec_id"], CUE_ORDER, {"prev": "c"}, **_flat(t))
    return rows.select(*CHUNK, "cue_idx", F.coalesce(F.col("c") == F.col("prev"), F.lit(False)).alias("repeated"))


@query("running_offset", sql_with("words", """select rec_id, word_idx, cast(coalesce(sum(length(word) + 1) over (partition by rec_id order by word_idx
 rows between unbounded preceding and 1 preceding), 0) as bigint) char_offset from words"""))
def running_offset(t: Tables) -> DataFrame:
    from ..operators.scan import ordered_scan
    rows = ordered_scan(t.words, ["rec_id"], ["word_idx"], sums={"char_offset": F.length("word").cast("bigint") + 1}, depth=_word_depth(t))
    return rows.select("rec_id", "word_idx", "char_offset")


_BATCH = """b as (select *, (k - 1) // 5 batch_id, (k - 1) % 5 pos from (select *,
 row_number() over (partition by rec_id order by chunk_id, cue_idx) k from cues))"""


@query("batch_cues", sql_with("cues", f"with {_BATCH} select * exclude (k) from b"))
def batch_cues(t: Tables) -> DataFrame:
    return merge.batch_cues(t.cues, 5, **_flat(t))


@query("neighbourhood", sql_with("words", """select rec_id, word_idx,
 coalesce(array_to_string(list(word) over (partition by rec_id order by word_idx rows between 2 preceding and 1 preceding), ' '), '') left_ctx,
 coalesce(array_to_string(list(word) over (partition by rec_id order by word_idx rows between 1 following and 2 following), ' '), '') right_ctx
 from words"""))
def neighbourhood(t: Tables) -> DataFrame:
    rows = merge.neighbourhood(t.words, ["rec_id"], "word_idx", "word", width=256)
    return rows.select("rec_id", "word_idx", F.array_join("left_ctx", " ").alias("left_ctx"), F.array_join("right_ctx", " ").alias("right_ctx"))


# ------------------------------------------------------------------ order, top-k, sets

@query("order_by_chunk", sql_with("cues", "select rec_id, chunk_id, cue_idx, content from cues order by rec_id, chunk_id, cue_idx"))
def order_by_chunk(t: Tables) -> DataFrame:
    return t.cues.select(*CHUNK, "cue_idx", "content").orderBy("rec_id", *CUE_ORDER)


@query("order_by_start", sql_with("cues", "select rec_id, chunk_id, cue_idx, start_ms, row_number() over (partition by rec_id order by start_ms, chunk_id, cue_idx) merged_idx from cues"))
def order_by_start(t: Tables) -> DataFrame:
    return merge.merge_chunks(t.cues, "all", merge.TIME_ORDER, **_flat(t)).select(*CHUNK, "cue_idx", "start_ms", "merged_idx")


@query("best_match", sql_with("words", """select rec_id, chunk_id, length(word) score, word_idx, word from words
 qualify row_number() over (partition by rec_id, chunk_id order by length(word) desc, word_idx) = 1"""))
def best_match(t: Tables) -> DataFrame:
    cand = t.words.select(*CHUNK, F.length("word").alias("score"), "word_idx", "word")
    return merge.best_match(cand, CHUNK, "score", "word_idx")


@query("longest_range", sql_with("segments", """select rec_id, start_ms, end_ms from segments
 qualify row_number() over (partition by rec_id order by end_ms - start_ms desc, start_ms) = 1"""))
def longest_range(t: Tables) -> DataFrame:
    return merge.longest_range(t.segments, ["rec_id"])


for _lang, _expr in {
    "all": "content", "en": "string_split(content, chr(10))[1]",
    "zh": "case when contains(content, chr(10)) then array_to_string(string_split(content, chr(10))[2:], chr(10)) else content end",
}.items():
    query(f"merge_chunks_{_lang}", sql_with("cues", f"""select rec_id, chunk_id, cue_idx, start_ms, end_ms, {_expr} as content,
 row_number() over (partition by rec_id order by chunk_id, cue_idx) merged_idx from cues"""))(
        lambda t, lang=_lang: merge.merge_chunks(t.cues, lang, **_flat(t)))


@query("select_chunks", sql_with("chunk_timing", "select distinct rec_id, chunk_id from chunk_timing where chunk_id = 1 or chunk_id between 2 and 9"))
def select_chunks(t: Tables) -> DataFrame:
    return merge.select_chunks(t.chunk_timing, "1, 2-9")


query("distinct_chunks", sql_with("cues", "select distinct chunk_id from cues"))(lambda t: t.cues.select("chunk_id").distinct())


@query("replace_chunks", sql_with("cues", """with new as (select rec_id, chunk_id, cue_idx, start_ms, end_ms, lower(content) as content from cues where (rec_id + chunk_id) % 4 = 0)
 select * from new union all select rec_id, chunk_id, cue_idx, start_ms, end_ms, content from cues where (rec_id, chunk_id) not in (select (rec_id, chunk_id) from new)"""))
def replace_chunks(t: Tables) -> DataFrame:
    columns = [*CHUNK, "cue_idx", "start_ms", "end_ms", "content"]
    new = t.cues.filter("(rec_id + chunk_id) % 4 = 0").withColumn("content", F.lower("content")).select(*columns)
    return merge.replace_chunks(t.cues.select(*columns), new)


@query("available_chunks", sql_with("cues chunk_timing", "select distinct rec_id, chunk_id from cues where (rec_id, chunk_id) in (select (rec_id, chunk_id) from chunk_timing)"))
def available_chunks(t: Tables) -> DataFrame:
    return merge.available(t.cues.select(*CHUNK).distinct(), t.chunk_timing, CHUNK)


@query("unused_words", sql_with("words sentences_edited", """select w.rec_id, w.word_idx from words w where not exists
 (select 1 from (select rec_id, chunk_id, unnest(string_split(text, ' ')) tok from sentences_edited) s
  where s.rec_id = w.rec_id and s.chunk_id = w.chunk_id and s.tok = w.word)"""))
def unused_words(t: Tables) -> DataFrame:
    toks = t.sentences_edited.select(*CHUNK, F.explode(F.split("text", " ")).alias("word")).distinct()
    return merge.unused(t.words, toks, [*CHUNK, "word"]).select("rec_id", "word_idx")


# ------------------------------------------------------------------ caption text and validity

@query("drop_invalid", sql_with("cues", "select * from cues where start_ms < end_ms and trim(content) <> ''"))
def drop_invalid(t: Tables) -> DataFrame:
    return merge.drop_invalid(t.cues)


for _fmt, _expr in {
    "bilingual": "case when b <> '' then a || chr(10) || b else a end", "target": "case when b <> '' then b else a end", "source": "a",
}.items():
    query(f"compose_{_fmt}", sql_with("cues", f"""select rec_id, cue_idx, {_expr} as content from (select rec_id, cue_idx,
 content a, case when cue_idx % 3 = 0 then '' else lower(content) end b from cues)"""))(
        lambda t, fmt=_fmt: t.cues.select("rec_id", "cue_idx", cp.compose_content(
            F.col("content"), F.when(F.col("cue_idx") % 3 == 0, "").otherwise(F.lower("content")), fmt).alias("content")))


@query("chunk_offset", sql_with("cues chunk_timing", """select c.rec_id, c.chunk_id, c.cue_idx, c.start_ms + coalesce(k.start_ms, 0) start_ms,
 c.end_ms + coalesce(k.start_ms, 0) end_ms from cues c left join chunk_timing k using (rec_id, chunk_id)"""))
def chunk_offset(t: Tables) -> DataFrame:
    return merge.absolute_time(lookup.chunk_offset(t.cues, t.chunk_timing)).select(*CHUNK, "cue_idx", "start_ms", "end_ms")


@query("words_in_segment", sql_with("segments words", """select s.rec_id, s.seg_idx, w.word_idx from segments s join words w on s.rec_id = w.rec_id
 and w.end_ms >= s.start_ms - 100 and w.start_ms <= s.end_ms + 100"""))
def words_in_segment(t: Tables) -> DataFrame:
    return lookup.words_in_segment(t.segments, t.words).select("rec_id", "seg_idx", "word_idx")


@query("pick_source", sql_with("chunk_timing", """select rec_id, chunk_id, case when (rec_id + chunk_id) % 3 = 0 then 'p' || chunk_id
 when (rec_id + chunk_id) % 5 > 0 then 'r' || chunk_id end picked from chunk_timing"""))
def pick_source(t: Tables) -> DataFrame:
    chunks = t.chunk_timing.select(*CHUNK)
    raw = chunks.filter("(rec_id + chunk_id) % 5 > 0").withColumn("path", F.concat(F.lit("r"), "chunk_id"))
    prep = chunks.filter("(rec_id + chunk_id) % 3 = 0").withColumn("path", F.concat(F.lit("p"), "chunk_id"))
    return lookup.pick_source(chunks, raw, prep)


# ------------------------------------------------------------------ answers of batches

def _answers(t: Tables):
    """Source cues in batches, and answers made from them: one missing in some batches, one more in others."""
    src = merge.batch_cues(t.cues, 5, **_flat(t))
    base = src.filter("not (batch_id % 2 = 0 and pos = 1 and rec_id % 3 = 0)").select(
        "rec_id", "batch_id", "pos", F.lit(1).cast("bigint").alias("start_ms"), F.lit(2).cast("bigint").alias("end_ms"),
        F.lower("content").alias("content"))
    more = src.filter("pos = 0 and rec_id % 4 = 0").select(
        "rec_id", "batch_id", F.lit(99).cast("bigint").alias("pos"), F.lit(1).cast("bigint").alias("start_ms"),
        F.lit(2).cast("bigint").alias("end_ms"), F.lit("X").alias("content"))
    return src, base.unionByName(more)


_ANSWERS = f"""with {_BATCH}, ans as (select rec_id, batch_id, pos, 1 start_ms, 2 end_ms, lower(content) as content from b
  where not (batch_id % 2 = 0 and pos = 1 and rec_id % 3 = 0)
 union all select rec_id, batch_id, 99, 1, 2, 'X' from b where pos = 0 and rec_id % 4 = 0)"""


@query("restore_timing", sql_with("cues", f"""{_ANSWERS} select a.rec_id, a.batch_id, a.pos, cast(coalesce(b.start_ms, a.start_ms) as bigint) start_ms,
 cast(coalesce(b.end_ms, a.end_ms) as bigint) end_ms, a.content from ans a left join b using (rec_id, batch_id, pos)"""))
def restore_timing(t: Tables) -> DataFrame:
    src, ans = _answers(t)
    return lookup.restore_timing(src, ans)


@query("count_mismatch", sql_with("cues", f"""{_ANSWERS} select rec_id, batch_id, n_source, coalesce(n_answer, 0) n_answer from
 (select rec_id, batch_id, count(*) n_source from b group by 1, 2) left join (select rec_id, batch_id, count(*) n_answer from ans group by 1, 2)
 using (rec_id, batch_id) where n_source <> coalesce(n_answer, 0)"""))
def count_mismatch(t: Tables) -> DataFrame:
    return lookup.count_mismatch(*_answers(t))


@query("fix_bilingual", sql_with("cues", """select rec_id, cue_idx, case when len(string_split(trim(content), chr(10))) = 1 then trim(content) || chr(10) || 'src' || cue_idx
 else array_to_string(list_filter(list_transform(string_split(trim(content), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:2], chr(10)) end as content from cues"""))
def fix_bilingual(t: Tables) -> DataFrame:
    return t.cues.select("rec_id", "cue_idx", lookup.fix_bilingual(
        F.col("content"), F.concat(F.lit("src"), "cue_idx")).alias("content"))


@query("keep_failed", sql_with("cues", f"""{_ANSWERS} select rec_id, batch_id, pos, content from ans where rec_id % 5 <> 0
 union all select rec_id, batch_id, pos, content from b where rec_id % 5 = 0"""))
def keep_failed(t: Tables) -> DataFrame:
    src, ans = _answers(t)
    failed = src.filter("rec_id % 5 = 0")
    return lookup.keep_failed(src, ans.filter("rec_id % 5 <> 0"), failed).select("rec_id", "batch_id", "pos", "content")


# ------------------------------------------------------------------ timing

@query("time_proportional", sql_with("segments", f"""with l as (select rec_id, chunk_id, seg_idx, start_ms, end_ms, {_sql_pack('text')} p from segments),
 u as (select rec_id, chunk_id, seg_idx, start_ms s, end_ms e, generate_subscripts(p, 1) - 1 part_idx, unnest(p) part from l),
 r as (select *, sum(length(part)) over (partition by rec_id, seg_idx order by part_idx) run, sum(length(part)) over (partition by rec_id, seg_idx) tot from u)
 select rec_id, seg_idx, part_idx, cast(s + (e - s) * (run - length(part)) // tot as bigint) part_start_ms,
 cast(case when run = tot then e else s + (e - s) * run // tot end as bigint) part_end_ms from r"""))
def time_proportional(t: Tables) -> DataFrame:
    parts = t.segments.select(*CHUNK, "seg_idx", "start_ms", "end_ms", F.posexplode(segment.pack_words(F.col("text"))).alias("part_idx", "part"))
    return timing.time_proportional(parts, ["rec_id", "seg_idx"]).select("rec_id", "seg_idx", "part_idx", "part_start_ms", "part_end_ms")


@query("time_from_words", sql_with("segments", "select rec_id, seg_idx, start_word_idx, end_word_idx, start_ms, end_ms from segments"))
def time_from_words(t: Tables) -> DataFrame:
    ranges = t.segments.select("rec_id", "seg_idx", "start_word_idx", "end_word_idx")
    return timing.time_from_words(ranges, t.words)


def _gappy(t: Tables) -> DataFrame:
    hide = F.col("rec_id").bitwiseXOR(F.col("seg_idx")) % 3 != 0
    return t.segments.select(
        *CHUNK, "seg_idx", "text", F.lit(7).cast("bigint").alias("fs"), F.lit(9).cast("bigint").alias("fe"),
        F.when(~hide, F.col("start_ms")).alias("start_ms"), F.when(~hide, F.col("end_ms")).alias("end_ms"))


def _fallback_sql(est: str, s0: str, e0: str) -> str:
    return sql_with("segments", f"""with k as (select rec_id, seg_idx, {est} est, case when xor(rec_id, seg_idx) % 3 = 0 then start_ms end s,
  case when xor(rec_id, seg_idx) % 3 = 0 then end_ms end e, row_number() over (partition by rec_id order by seg_idx) k from segments),
 r as (select rec_id, seg_idx, k, cast(coalesce(s, {s0}) as bigint) start_ms, cast(coalesce(e, {e0} + est) as bigint) end_ms from k where k = 1
  union all select k.rec_id, k.seg_idx, k.k, cast(coalesce(k.s, r.end_ms) as bigint), cast(coalesce(k.e, r.end_ms + k.est) as bigint)
  from r join k on k.rec_id = r.rec_id and k.k = r.k + 1)
 select rec_id, seg_idx, start_ms, end_ms from r""", recursive=True)


for _mode, (_est, _s0, _e0) in {"a": ("greatest(500, length(text) * 125)", "7", "7"), "b": ("2000", "0", "0"), "c": ("length(text) * 100", "7", "9")}.items():
    query(f"fallback_times_{_mode}", _fallback_sql(_est, _s0, _e0))(
        lambda t, m=_mode: timing.fallback_times(
            _gappy(t), ["rec_id"], ["seg_idx"], m, "text", "fs" if m != "b" else None, "fe" if m == "c" else None, **_flat(t)
        ).select("rec_id", "seg_idx", "start_ms", "end_ms"))

query("fallback_times_d", sql_with("segments", """select rec_id, seg_idx, case when xor(rec_id, seg_idx) % 3 = 0 then start_ms else 0 end start_ms,
 case when xor(rec_id, seg_idx) % 3 = 0 then end_ms else 0 end end_ms from segments"""))(
    lambda t: timing.fallback_times(_gappy(t), ["rec_id"], ["seg_idx"], "d").select("rec_id", "seg_idx", "start_ms", "end_ms"))


@query("repair_times", sql_with("cues", """with k as (select rec_id, chunk_id, cue_idx, start_ms s, case when cue_idx % 4 > 1 then start_ms else end_ms end e,
  row_number() over (partition by rec_id order by chunk_id, cue_idx) k from cues),
 r as (select rec_id, chunk_id, cue_idx, k, s start_ms, case when s >= e then s + 1000 else e end end_ms from k where k = 1
  union all select k.rec_id, k.chunk_id, k.cue_idx, k.k, case when k.s >= k.e then r.end_ms else k.s end,
  case when k.s >= k.e then r.end_ms + 1000 else k.e end from r join k on k.rec_id = r.rec_id and k.k = r.k + 1)
 select rec_id, chunk_id, cue_idx, start_ms, end_ms from r""", recursive=True))
def repair_times(t: Tables) -> DataFrame:
    rows = t.cues.withColumn("end_ms", F.when(F.col("cue_idx") % 4 > 1, F.col("start_ms")).otherwise(F.col("end_ms")))
    return timing.repair_times(rows, ["rec_id"], CUE_ORDER, **_flat(t)).drop("content")


@query("clip_to_end", sql_with("cues words", """select c.rec_id, c.chunk_id, c.cue_idx, case when c.end_ms + 1500 * (cue_idx % 3) > m.m + 1000 then m.m
 else c.end_ms + 1500 * (cue_idx % 3) end end_ms from cues c left join (select rec_id, chunk_id, max(end_ms) m from words group by 1, 2) m using (rec_id, chunk_id)"""))
def clip_to_end(t: Tables) -> DataFrame:
    rows = t.cues.withColumn("end_ms", F.expr("end_ms + 1500 * (cue_idx % 3)"))
    return timing.clip_to_end(rows, t.words).select(*CHUNK, "cue_idx", "end_ms")


@query("default_fields", sql_with("segments", """select rec_id, seg_idx, cast(coalesce(case when seg_idx % 2 = 0 then seg_idx end, len(string_split(text, ' '))) as bigint) word_count,
 case when seg_idx % 3 = 0 then 1.0 else 0.5 end::double timing_confidence from segments"""))
def default_fields(t: Tables) -> DataFrame:
    rows = t.segments.withColumns({"word_count": F.when(F.col("seg_idx") % 2 == 0, F.col("seg_idx")), "has": F.col("seg_idx") % 3 == 0})
    return timing.default_fields(rows, "has").select("rec_id", "seg_idx", "word_count", "timing_confidence")


@query("placeholder_cues", sql_with("cues chunk_timing", """with c as (select * from cues where (rec_id + chunk_id) % 5 > 0)
 select rec_id, chunk_id, cue_idx, start_ms, end_ms, content from c union all
 select rec_id, chunk_id, 0, start_ms, start_ms + duration_ms, '[No speech detected in this segment]' from chunk_timing
 where (rec_id, chunk_id) not in (select (rec_id, chunk_id) from c)"""))
def placeholder_cues(t: Tables) -> DataFrame:
    return timing.placeholder_cues(t.chunk_timing, t.cues.filter("(rec_id + chunk_id) % 5 > 0"))


# ------------------------------------------------------------------ quality

def _anomaly_sql(variant: str) -> str:
    same = "t = p and t <> ''" if variant == "full" else "t = p"
    single = "case when single > 2 then 'single_chars(' || single || ')' end, " if variant == "full" else ""
    return sql_with("cues", f"""with k as (select rec_id, start_ms, end_ms, t, lag(t) over w p, lag(end_ms) over w pe from
  (select *, trim(content) t from cues) window w as (partition by rec_id order by chunk_id, cue_idx)),
 a as (select rec_id, count(*) n, count(*) filter (where {same}) repeated, count(*) filter (where end_ms - start_ms > 15000) long,
  count(*) filter (where end_ms <= start_ms) zero, count(*) filter (where length(t) <= 3) short, count(*) filter (where length(t) = 1) single,
  count(*) filter (where start_ms < pe) "overlaps" from k group by 1)
 select *, concat_ws(',', case when repeated > 1 then 'repeated_segments(' || repeated || ')' end, case when long > 0 then 'long_segments(' || long || ')' end,
  case when zero > 0 then 'zero_duration(' || zero || ')' end, case when n > 5 and short / n > 0.3 then 'fragmented(' || short || '/' || n || ')' end,
  {single}case when "overlaps" > 0 then 'overlaps(' || "overlaps" || ')' end) labels from a""")


for _variant in ("full", "plain"):
    query(f"anomalies_{_variant}", _anomaly_sql(_variant))(
        lambda t, v=_variant: quality.anomalies(
            t.cues, ["rec_id"], CUE_ORDER, "content", v, **_flat(t)
        ).withColumn("labels", F.array_join("labels", ",")))


def _scored(t: Tables) -> DataFrame:
    """Confidences spread over all bins, from the positions."""
    c = F.expr("element_at(array(1.0D, 0.97D, 0.92D, 0.87D, 0.8D, 0.5D, 0.0D), cast((rec_id + seg_idx * 3) % 7 as int) + 1)")
    return t.segments.select(*CHUNK, "seg_idx", c.alias("confidence"), F.when(c > 0, F.col("start_word_idx")).otherwise(-1).alias("start_word_idx"))


_SCORED = "s as (select rec_id, chunk_id, seg_idx, [1.0, 0.97, 0.92, 0.87, 0.8, 0.5, 0.0][(rec_id + seg_idx * 3) % 7 + 1]::double c from segments)"


@query("match_report", sql_with("segments", f"""with {_SCORED} select rec_id, chunk_id, count(*) total, count(*) filter (where c > 0) matched,
 count(*) filter (where c >= 0.95) ge_095, count(*) filter (where c >= 0.9 and c < 0.95) ge_090, count(*) filter (where c >= 0.85 and c < 0.9) ge_085,
 count(*) filter (where c > 0 and c < 0.85) lt_085, count(*) filter (where c = 0) zero, count(*) filter (where c > 0) / count(*) rate
 from s group by rollup (rec_id, chunk_id)"""))
def match_report(t: Tables) -> DataFrame:
    return quality.match_report(_scored(t), rollup=True)


@query("quality_tiers", sql_with("segments", f"""with {_SCORED}, q as (select rec_id, count(*) total, count(*) filter (where c = 1) perfect,
 count(*) filter (where c >= 0.8 and c < 1) good, count(*) filter (where c < 0.8 and c > 0) poor, count(*) filter (where c = 0) failed from s group by 1)
 select *, (perfect + good) / total success_rate, case when perfect + good = total then 'perfect' when (perfect + good) / total >= 0.9 then 'excellent'
 when (perfect + good) / total >= 0.8 then 'good' else 'poor' end grade from q"""))
def quality_tiers(t: Tables) -> DataFrame:
    return quality.quality_tiers(_scored(t), ["rec_id"])


@query("merge_report", sql_with("cues", """with k as (select *, lag(end_ms, 1, 0) over (partition by rec_id order by chunk_id, cue_idx) pe from cues)
 select rec_id, count(*) n_cues, max(end_ms) max_end_ms, count(*) filter (where start_ms < pe) "overlaps", max(end_ms) / 60000 max_end_min,
 max(end_ms) / 3600000 max_end_h from k group by 1"""))
def merge_report(t: Tables) -> DataFrame:
    return quality.merge_report(t.cues, **_flat(t))


@query("run_report", sql_with("chunk_runs cues", """with c as (select rec_id, chunk_id, count(*) n from cues group by 1, 2)
 select rec_id, count(*) total, count(*) filter (where status = 'ok') ok, count(*) filter (where status = 'error') failed,
 cast(coalesce(sum(n) filter (where status = 'ok'), 0) as bigint) cues from chunk_runs left join c using (rec_id, chunk_id) group by 1"""))
def run_report(t: Tables) -> DataFrame:
    return quality.run_report(t.chunk_runs, t.cues)


query("failed_chunks", sql_with("chunk_runs", "select rec_id, chunk_id from chunk_runs where status = 'error'"))(
    lambda t: quality.failed_chunks(t.chunk_runs))


@query("span_check", sql_with("cues", """with c as (select rec_id, max(end_ms) max_end_ms, count(*) - count(distinct start_ms) duplicate_starts from
 (select rec_id, end_ms, start_ms // 20000 start_ms from cues) group by 1)
 select rec_id, max_end_ms, duplicate_starts, (rec_id % 5) * 40000 duration_ms, abs(max_end_ms - (rec_id % 5) * 40000) difference_ms,
 abs(max_end_ms - (rec_id % 5) * 40000) > 60000 mismatch from c"""))
def span_check(t: Tables) -> DataFrame:
    rows = t.cues.withColumn("start_ms", F.expr("start_ms div 20000"))
    known = t.cues.select("rec_id").distinct().withColumn("duration_ms", F.col("rec_id") % 5 * 40000)
    return quality.span_check(rows, known)


@query("chunk_bounds_check", sql_with("cues chunk_timing", """with j as (select c.rec_id, c.chunk_id, c.end_ms - k.start_ms + (c.rec_id % 4) * 4000 e, k.start_ms s, k.duration_ms d
  from cues c join chunk_timing k using (rec_id, chunk_id)),
 a as (select rec_id, chunk_id, count(*) filter (where e > d + 10000) late_cues, max(s + e) max_end_ms, max(s + d) expected_end_ms from j group by 1, 2)
 select *, case when max_end_ms - expected_end_ms > 10000 then 'error' when max_end_ms - expected_end_ms > 5000 then 'warning' else 'ok' end "level" from a"""))
def chunk_bounds_check(t: Tables) -> DataFrame:
    rel = t.cues.join(t.chunk_timing.select(*CHUNK, F.col("start_ms").alias("s")), CHUNK).withColumn(
        "end_ms", F.expr("end_ms - s + (rec_id % 4) * 4000"))
    return quality.chunk_bounds_check(rel, t.chunk_timing)


@query("keep_better", sql_with("attempts", """with b as (select rec_id, chunk_id, n_anomalies base from attempts where attempt = 0),
 w as (select a.rec_id, a.chunk_id, min(a.attempt) attempt, arg_min(a.n_anomalies, a.attempt) n from attempts a join b using (rec_id, chunk_id)
  where a.attempt > 0 and a.n_anomalies < b.base group by 1, 2)
 select b.rec_id, b.chunk_id, coalesce(w.attempt, 0) attempt, coalesce(w.n, b.base) n_anomalies from b left join w using (rec_id, chunk_id)"""))
def keep_better(t: Tables) -> DataFrame:
    return quality.keep_better(t.attempts)


@query("word_overlaps", sql_with("words", """with k as (select rec_id, seg_idx, start_ms - case when word_idx % 7 = 3 then 500 else 0 end s,
 lag(end_ms) over (partition by rec_id, seg_idx order by word_idx) pe from words)
 select rec_id, seg_idx, count(*) n_words, count(*) filter (where s < pe) "overlaps" from k group by 1, 2"""))
def word_overlaps(t: Tables) -> DataFrame:
    rows = t.words.withColumn("start_ms", F.expr("start_ms - if(word_idx % 7 = 3, 500, 0)"))
    return quality.word_overlaps(rows, depth=_word_depth(t))


# ------------------------------------------------------------------ sinks

_HMS = "{ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000"


def _t(fmt: str, ms: str) -> str:
    return f"printf('{fmt}', {_HMS.format(ms=ms)})"


def _clock(ms: str) -> str:
    return (f"printf('%d:%02d:%02d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60) || "
            f"case when {ms} % 1000 = 0 then '' else printf('.%03d000', {ms} % 1000) end")


def _ass(ms: str) -> str:
    cs = f"(({ms} + 5) // 10)"
    return f"printf('%d:%02d:%02d.%02d', {cs} // 360000, {cs} // 6000 % 60, {cs} // 100 % 60, {cs} % 100)"


# times are shifted so that none is negative
_SHOWN = "shown as (select rec_id, chunk_id, cue_idx, start_ms + 1000 start_ms, end_ms + 1000 end_ms, content from cues)"


def _shown(t: Tables) -> DataFrame:
    return merge.absolute_time(t.cues.withColumn("o", F.lit(1000).cast("bigint")), "o").drop("o")


@query("to_srt", sql_with("cues", f"""with {_SHOWN}, k as (select *, row_number() over (partition by rec_id order by start_ms, end_ms, chunk_id, cue_idx) i
 from shown where start_ms < end_ms and trim(content) <> '')
 select rec_id, i as "index", i || chr(10) || {_t('%02d:%02d:%02d,%03d', 'start_ms')} || ' --> ' || {_t('%02d:%02d:%02d,%03d', 'end_ms')} || chr(10) || content || chr(10) || chr(10) as block from k"""))
def to_srt(t: Tables) -> DataFrame:
    rows = write.srt_cues(_shown(t), **_flat(t))
    return write.render(rows, "srt", "index").select("rec_id", "index", "block")


BLOCK_SQL = {
    "txt": f"'[' || {_clock('start_ms')} || ' --> ' || {_clock('end_ms')} || ']' || chr(10) || content || chr(10) || chr(10)",
    "vtt": f"{_t('%02d:%02d:%02d.%03d', 'start_ms')} || ' --> ' || {_t('%02d:%02d:%02d.%03d', 'end_ms')} || chr(10) || content || chr(10) || chr(10)",
    "ass": f"'Dialogue: 0,' || {_ass('start_ms')} || ',' || {_ass('end_ms')} || ',Default,,0,0,0,,' || replace(content, chr(10), '\\N') || chr(10)",
    "json": "'  {' || chr(10) || '    \"index\": ' || cue_idx || ',' || chr(10) || '    \"start\": \"' || " + _clock("start_ms")
            + " || '\",' || chr(10) || '    \"end\": \"' || " + _clock("end_ms")
            + " || '\",' || chr(10) || '    \"content\": ' || cast(to_json(content) as varchar) || chr(10) || '  }'",
}
for _f, _sql in BLOCK_SQL.items():
    query(f"to_{_f}", sql_with("cues", f"with {_SHOWN} select rec_id, cue_idx, {_sql} as block from shown"))(
        lambda t, f=_f: write.render(_shown(t), f).select("rec_id", "cue_idx", "block"))


@query("merged_name", sql_with("cues", "select distinct rec_id, 'rec' || rec_id || '_' || 'api_llm' || '_merged_zh.srt' as file from cues"))
def merged_name(t: Tables) -> DataFrame:
    ids = t.cues.select("rec_id").distinct()
    return ids.select("rec_id", write.merged_name(F.concat(F.lit("rec"), "rec_id"), F.lit("api_llm"), "zh").alias("file"))


# ------------------------------------------------------------------ files: written to the shared folder, then read

_SOUND = "select rec_id, chunk_id, start_ms, end_ms, content from shown where start_ms < end_ms and trim(content) <> ''"


@query("read_srt", sql_with("cues", f"with {_SHOWN} {_SOUND}"))
def read_srt(t: Tables) -> DataFrame:
    """All captions written as SRT chunk folders and read back."""
    path = new_shared_path(t.spark, "srt")
    write.write_chunks(_shown(t), path)
    cues = read.read_srt(t.spark, path)
    part = lambda k: F.regexp_extract("path", rf"{k}=(\d+)", 1)
    return cues.select(part("rec_id").cast("bigint").alias("rec_id"), part("chunk_id").cast("int").alias("chunk_id"),
                       "start_ms", "end_ms", "content")


def _chunk_files(t: Tables) -> str:
    """Files ``rec<id>/chunk_<n>.srt`` (some in a sub-folder, some merged ones), as a translator leaves them."""
    path = new_shared_path(t.spark, "projects")
    blocks = write.render(write.srt_cues(_shown(t), CHUNK, ["cue_idx"], depth=1), "srt", "index")
    # one text file per chunk: a chunk is a bounded piece
    files = blocks.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(F.struct("index", "block"))).alias("b")).select(
        *CHUNK, F.array_join(F.transform("b", lambda x: x["block"]), "").alias("text"))

    def save(batches):
        from pyarrow import fs

        # any file system the tasks share: local, HDFS, object stores
        store, base = fs.FileSystem.from_uri(path.removeprefix("file:").replace("///", "/", 1) if path.startswith("file:") else path)
        for pdf in batches:
            for rec, chunk, text in zip(pdf["rec_id"], pdf["chunk_id"], pdf["text"]):
                names = [f"rec{rec}/chunk_{chunk}.srt"]
                names += [f"rec{rec}/api_llm/chunk_{chunk}.srt"] if rec % 2 else []
                names += [f"rec{rec}/rec{rec}_merged.srt"] if chunk == 0 and rec % 3 == 0 else []
                for name in names:
                    store.create_dir(f"{base}/{name}".rsplit("/", 1)[0])
                    with store.open_output_stream(f"{base}/{name}") as f:
                        f.write(text.encode("utf-8"))
            yield pdf[["rec_id"]]

    files.mapInPandas(save, "rec_id bigint").count()
    return path


# a file's size: its blocks of number, times, content and the line ends between
_SND = f"""with {_SHOWN}, snd as ({_SOUND}),
 f as (select rec_id, chunk_id, cast(sum(strlen(content) + length(cast(i as varchar)) + 33) as bigint) size from
  (select *, row_number() over (partition by rec_id, chunk_id order by start_ms, end_ms) i from snd) group by 1, 2),
 files as (select 'rec' || rec_id project, 'original' subfolder, 'chunk_' || chunk_id || '.srt' file, chunk_id, size from f
  union all select 'rec' || rec_id, 'api_llm', 'chunk_' || chunk_id || '.srt', chunk_id, size from f where rec_id % 2 = 1
  union all select 'rec' || rec_id, 'original', 'rec' || rec_id || '_merged.srt', null, size from f where chunk_id = 0 and rec_id % 3 = 0)"""
# when a file was written differs from run to run; that it is known does not
def _timed(column: str):
    return (F.col(column) > F.lit("2001-01-01").cast("timestamp")).alias("timed")


@query("discover_chunks", sql_with("cues", f"{_SND} select project, subfolder, chunk_id, size, true timed from files where chunk_id is not null"))
def discover_chunks(t: Tables) -> DataFrame:
    return read.discover_chunks(t.spark, _chunk_files(t)).select("project", "subfolder", "chunk_id", F.col("length").alias("size"), _timed("modificationTime"))


@query("catalog", sql_with("cues", f"{_SND} select project, subfolder, file, size, true timed from files"))
def catalog(t: Tables) -> DataFrame:
    return read.catalog(t.spark, _chunk_files(t)).select("project", "subfolder", "file", F.col("length").alias("size"), _timed("modificationTime"))


@query("subfolders", sql_with("cues", f"{_SND} select distinct project, subfolder from files where chunk_id is not null"))
def subfolders(t: Tables) -> DataFrame:
    return read.subfolders(read.catalog(t.spark, _chunk_files(t)))


@query("catalog_report", sql_with("cues", f"""{_SND} select project, subfolder, count(*) n_chunks, cast(sum(size) as bigint) bytes, true timed
 from files where chunk_id is not null group by 1, 2"""))
def catalog_report(t: Tables) -> DataFrame:
    files = read.discover_chunks(t.spark, _chunk_files(t))
    return quality.catalog_report(files).select("project", "subfolder", "n_chunks", "bytes", _timed("latest"))


for _mode, _cond in {"api": "(chunk_id is null or project not in (select project from files where chunk_id is null))", "local": "true"}.items():
    query(f"choose_sources_{_mode}", sql_with("cues", f"{_SND} select project, file from files where subfolder = 'original' and {_cond}"))(
        lambda t, m=_mode: read.choose_sources(read.catalog(t.spark, _chunk_files(t)), m).select("project", "file"))


@query("read_chunks", sql_with("cues", f"{_SND} select 'rec' || rec_id project, chunk_id, start_ms, content from snd union all "
                               "select 'rec' || rec_id, chunk_id, start_ms, content from snd where rec_id % 2 = 1"))
def read_chunks(t: Tables) -> DataFrame:
    cues = read.read_chunks(t.spark, _chunk_files(t))
    return cues.select(F.regexp_extract("path", r"/(rec\d+)/", 1).alias("project"), "chunk_id", "start_ms", "content")


@query("read_transcripts", sql_with("segments", """select rec_id, chunk_id, string_agg(text, chr(10) order by seg_idx) as text,
 cast(sum(end_word_idx - start_word_idx + 1) as bigint) n_words from segments group by 1, 2"""))
def read_transcripts(t: Tables) -> DataFrame:
    w = F.struct("word", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", w.alias("w")))), lambda x: x["w"])
    segs = t.words.groupBy(*CHUNK, "seg_idx").agg(said.alias("words"))
    text = F.array_join(F.transform("words", lambda x: x["word"]), " ")
    listed = F.array_sort(F.collect_list(F.struct("seg_idx", text.alias("text"), "words")))
    nested = segs.groupBy(*CHUNK).agg(F.transform(listed, lambda x: F.struct(x["text"].alias("text"), x["words"].alias("words"))).alias("segments"))
    path = new_shared_path(t.spark, "transcripts")
    nested.write.json(path)
    df = read.read_transcripts(t.spark, path)
    return df.select(*CHUNK, F.array_join(F.transform("segments", lambda s: s["text"]), "\n").alias("text"), F.expr(
        "aggregate(segments, 0L, (a, s) -> a + size(s.words))").alias("n_words"))


@query("read_chunk_timing", sql_with("all_chunk_timing", "select 'rec_id=' || rec_id recording, chunk_id, start_ms, end_ms, duration_ms from all_chunk_timing"))
def read_chunk_timing(t: Tables) -> DataFrame:
    path = new_shared_path(t.spark, "timing")
    # JSON arrays, as the planner of the chunks writes them: a file each, as of several in a file only the first is read
    rows = t.all_chunk_timing.groupBy("rec_id", F.expr("chunk_id div 10000").alias("page")).agg(F.to_json(F.collect_list(F.struct(
        F.col("chunk_id").alias("chunk_index"), F.col("start_ms").alias("start_time_ms"),
        F.col("end_ms").alias("end_time_ms"), "duration_ms"))).alias("value"))
    files.write_folders(rows, path, ["rec_id"], ["page"], F.col("value"), part=F.col("page"))
    return read.read_chunk_timing(t.spark, path)


@query("write_chunk_timing", sql_with("chunk_timing", "select 'rec_id=' || rec_id recording, chunk_id, start_ms, end_ms, duration_ms from chunk_timing"))
def write_chunk_timing(t: Tables) -> DataFrame:
    """The manifest as the writer leaves it, read again."""
    path = new_shared_path(t.spark, "manifest")
    write.write_chunk_timing(t.chunk_timing, path)
    return read.read_chunk_timing(t.spark, path, lines=True)


@query("stream_chunks", sql_with("cues", f"{_SND} select 'rec' || rec_id project, chunk_id, start_ms, content from snd union all "
                                 "select 'rec' || rec_id, chunk_id, start_ms, content from snd where rec_id % 2 = 1"))
def stream_chunks(t: Tables) -> DataFrame:
    """The chunk files taken as a file stream, once; the same rows as the batch reader."""
    out, check, known = (new_shared_path(t.spark, n) for n in ("out", "check", "known"))
    incremental.run_available(incremental.stream_chunks(t.spark, _chunk_files(t), known=known), out, check)
    cues = t.spark.read.parquet(out)
    return cues.select(F.regexp_extract("path", r"/(rec\d+)/", 1).alias("project"), "chunk_id", "start_ms", "content")


_STREAM_UTT = sql_with("words", f"""with {_UTT} select rec_id, min(start_ms) start_ms, max(end_ms) end_ms, count(*) n_words from utt group by rec_id, utt_id""")


@query("stream_utterances", _STREAM_UTT)
def stream_utterances(t: Tables) -> DataFrame:
    """Session windows with the pause rule, over the words with event time."""
    ts = F.expr("timestamp_millis(start_ms)")
    return incremental.stream_utterances(t.words.withColumn("ts", ts)).select("rec_id", "start_ms", "end_ms", "n_words")


@query("stream_cached", sql_with("words", "select distinct word, false hit from words"))
def stream_cached(t: Tables) -> DataFrame:
    """Distinct words as a stream of items through an empty result cache: every one is computed."""
    items = materialize(t.words.select(F.col("word").alias("key")).distinct(), "items")
    path = items.inputFiles()[0].rsplit("/", 1)[0]
    stream = t.spark.readStream.schema(items.schema).parquet(path)
    cache, out, check = (new_shared_path(t.spark, n) for n in ("cache", "out", "check"))
    incremental.stream_cached(stream, cache, lambda d: d.withColumn("value", F.upper("key")), out, check)
    return t.spark.read.option("basePath", out).parquet(f"{out}/*").select(F.col("key").alias("word"), "hit")


# ------------------------------------------------------------------ pipelines without a search

def _plain_rounds(source: str, keys: str) -> str:
    """The ``plain`` length cascade on ``source(keys, text)`` as CTEs; ``r3(keys, j, k, m, part)`` is the result."""
    return (_round(source, "text", keys, "r1") + ", " + _round(f"(select {keys}, i j, q from r1)", "q", f"{keys}, j", "r2")
            + f", r3 as (select {keys}, j, i k, generate_subscripts(p, 1) m, unnest(p) part from "
            + f"(select {keys}, j, i, case when length(q) <= 80 then [q] else {_sql_pack('q')} end p from r2))")


_ON_RANGES = sql_with("words", f"""with ct as (select rec_id, chunk_id, string_agg(word, ' ' order by word_idx) as text from words group by 1, 2),
 sents as (select rec_id, chunk_id, generate_subscripts(a, 1) - 1 sent_idx, unnest(a) as text from (select rec_id, chunk_id, {_SENT_LIST} a from ct)),
 {_plain_rounds('sents', 'rec_id, chunk_id, sent_idx')},
 p as (select rec_id, chunk_id, part, row_number() over w cue_idx, sum(length(replace(part, ' ', ''))) over w t, length(replace(part, ' ', '')) n from r3
  window w as (partition by rec_id, chunk_id order by sent_idx, j, k, m)),
 c as (select *, sum(length(word)) over (partition by rec_id, chunk_id order by word_idx) t from words)
 select p.rec_id, p.chunk_id, p.cue_idx, p.part as text, min(c.word_idx) start_word_idx, max(c.word_idx) end_word_idx,
  arg_min(c.start_ms, c.word_idx) start_ms, arg_max(c.end_ms, c.word_idx) end_ms
 from p join c on c.rec_id = p.rec_id and c.chunk_id = p.chunk_id and c.t > p.t - p.n and c.t - length(c.word) < p.t group by 1, 2, 3, 4""")


@query("captions_on_ranges", _ON_RANGES)
def captions_on_ranges(t: Tables) -> DataFrame:
    return pipelines.captions_on_ranges(t.words, t.segments)


_FALLBACK = sql_with("segments", f"""with src as (select rec_id, chunk_id, seg_idx, start_ms, end_ms,
  case when right(text, 1) in ('.', '!', '?') then upper(left(text, 1)) || substr(text, 2) else upper(left(text, 1)) || substr(text, 2) || '.' end as text
  from segments where trim(text) <> ''),
 {_plain_rounds('src', 'rec_id, chunk_id, seg_idx, start_ms, end_ms')},
 pr as (select *, sum(length(part)) over (partition by rec_id, chunk_id, seg_idx order by j, k, m) run, sum(length(part)) over (partition by rec_id, chunk_id, seg_idx) tot,
  row_number() over (partition by rec_id, chunk_id order by seg_idx, j, k, m) pos from r3),
 tm as (select rec_id, chunk_id, seg_idx, pos, part, cast(start_ms + (end_ms - start_ms) * (run - length(part)) // tot as bigint) s,
  cast(case when run = tot then end_ms else start_ms + (end_ms - start_ms) * run // tot end as bigint) e from pr),
 fix as (select rec_id, chunk_id, seg_idx, pos, part, s, case when s >= e then s + 1000 else e end e from tm where pos = 1
  union all select tm.rec_id, tm.chunk_id, tm.seg_idx, tm.pos, tm.part, case when tm.s >= tm.e then fix.e else tm.s end,
  case when tm.s >= tm.e then fix.e + 1000 else tm.e end from fix join tm on tm.rec_id = fix.rec_id and tm.chunk_id = fix.chunk_id and tm.pos = fix.pos + 1)
 select rec_id, chunk_id, seg_idx, pos, part as text, s start_ms, e end_ms, len(string_split(part, ' ')) word_count, 0.5::double timing_confidence from fix""", recursive=True)


@query("captions_fallback", _FALLBACK)
def captions_fallback(t: Tables) -> DataFrame:
    from pyspark.sql import Window
    out = pipelines.captions_fallback(t.segments, None, profile="plain", depth=1)
    pos = F.row_number().over(Window.partitionBy(*CHUNK).orderBy("seg_idx", "part_idx"))
    return out.withColumn("pos", pos).drop("part_idx")


@query("punctuate_segments", sql_with("segments", rf"""with tk as (select rec_id, seg_idx, text,
  list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[^{W}\s''\-]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') a from segments),
 jn as (select *, array_to_string(list_transform(a, lambda x, i: x || (case ((i - 1) * 7 + length(x) * (rec_id % 3)) % 15
  when 1 then ' .' when 2 then ' ,' when 3 then ' ?' when 4 then ' !' when 5 then ' ;' when 6 then ' :' when 7 then ' ''' when 8 then ' "'
  when 9 then ' -' when 10 then ' ...' else '' end)), ' ') s from tk),
 sp as (select *, trim(regexp_replace(s, '\s+([,.!?;:])', '\1', 'g')) u from jn),
 nw as (select *, upper(left(u, 1)) || substr(u, 2) v from sp)
 select rec_id, seg_idx, case when length(v) - length(translate(v, ',.?!', '')) <= greatest(len(a) // 3, 1)
  and length(v) - length(replace(v, ',', '')) <= greatest(len(a) // 4, 1) then v else text end as text from nw"""))
def punctuate_segments(t: Tables) -> DataFrame:
    labels = lambda toks: F.transform(toks, lambda x, i: (i * 7 + F.length(x) * (F.col("rec_id") % 3)) % 15)
    return pipelines.punctuate_segments(t.segments, labels).select("rec_id", "seg_idx", "text")


@query("plain_fallback", sql_with("segments", """select rec_id, seg_idx, case when right(x, 1) in ('.', '!', '?') then x else x || '.' end as text from
 (select rec_id, seg_idx, 'A' || rtrim(text, '.') x from segments)"""))
def plain_fallback(t: Tables) -> DataFrame:
    rows = t.segments.withColumn("text", F.expr("'a' || rtrim('.', text)"))
    return pipelines.plain_fallback(rows).select("rec_id", "seg_idx", "text")


_FINISH = """select c.rec_id, c.chunk_id, c.seg_idx, c.start_ms + coalesce(k.start_ms, 0) start_ms, c.end_ms + coalesce(k.start_ms, 0) end_ms, c.x || chr(10) || c.y as content
 from (select *, regexp_replace(g, '[,.，。]$', '') x, regexp_replace(case when g = 'In die' then 'EN DIE' else g end, '[,.，。]$', '') y
  from (select *, {g} g from segments where end_ms > start_ms)) c left join chunk_timing k using (rec_id, chunk_id)"""


def _finish_sql() -> str:
    from .queries_text import _sql_glossary
    return sql_with("segments chunk_timing", _FINISH.format(g=_sql_glossary("text")))


@query("finish", _finish_sql())
def finish(t: Tables) -> DataFrame:
    parts = t.segments.select(*CHUNK, "seg_idx", "start_ms", "end_ms", "text")
    return pipelines.finish(parts, t.glossary, t.chunk_timing, "bilingual", translate=True)
