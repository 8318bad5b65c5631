"""Queries on what grows beyond one task: large glossaries, stateful streams, files read in ranges and written whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import merge, rewrite, sketches
from ..session import materialize, new_shared_path
from ..sources import files, ranges
from ..streaming import cache as result_cache
from ..streaming import sessions
from .fixtures import sql_with
from .queries_caption import _SHOWN, _SOUND, BLOCK_SQL, _flat, _shown, _t
from .queries_text import _docs, _marked
from .registry import query
from .tables import Tables

# ------------------------------------------------------------------ a glossary of all words of the benchmark

# chains of up to three rules: a word becomes the next one, that a form with "-x", that a number
_RULES = """voc as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) w from benchmark),
 rk as (select row_number() over (order by w) - 1 k, w, lead(w) over (order by w) nx, lag(w) over (order by w) pv from voc),
 rules as (select k, case when k % 3 = 2 and k % 2 = 1 then pv || '-x' else w end term,
  case k % 3 when 0 then coalesce(nx, w) when 1 then upper(w) || '-x' else 'zz' || k end replacement from rk)"""

_SQL_RULES = f"""with {_RULES},
 l as (select list({{'t': term, 'p': '(?i)' || regexp_replace(term, '([a-z]+)', chr(1) || '\\1' || chr(1), 'g'), 'r': replacement}} order by k) a from rules)
 select doc_id, list_reduce(list_prepend({{'t': '', 'p': '', 'r': text}}, a), lambda s, x: {{'t': '', 'p': '', 'r':
  case when contains(lower(s.r), x.t) then replace(regexp_replace({_marked('s.r')}, x.p, x.r, 'g'), chr(1), '') else s.r end}}).r as text
 from documents, l"""


def _rules(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("w")).distinct()
    order = Window.orderBy("w")
    rk = words.select("w", (F.row_number().over(order) - 1).alias("k"), F.lead("w").over(order).alias("nx"), F.lag("w").over(order).alias("pv"))
    return rk.select(
        F.col("k").alias("ord"), F.expr("case when k % 3 = 2 and k % 2 = 1 then pv || '-x' else w end").alias("term"),
        F.expr("case k % 3 when 0 then coalesce(nx, w) when 1 then upper(w) || '-x' else 'zz' || k end").alias("replacement"))


@query("apply_rules", _SQL_RULES)
def apply_rules(t: Tables) -> DataFrame:
    """Every word of the benchmark as a rule, many of them chained, over all documents."""
    return rewrite.apply_rules(_docs(t).select("doc_id", "text"), _rules(t))


# ------------------------------------------------------------------ utterances of words that arrive in files

_ARRIVALS = 4
# a word arrives with its quarter of the time; some one quarter later, some far too late
_ARRIVAL = f"""least({_ARRIVALS - 1}, start_ms * {_ARRIVALS} {{div}} (top + 1) + case when word_idx % 7 = 3 then 1 when word_idx % 97 = 50 then 3 else 0 end)"""

_SQL_STREAM = sql_with("words", f"""with s as (select max(start_ms) top from words),
 a as (select words.*, {_ARRIVAL.format(div='//')} arrival, top // {_ARRIVALS} + 1 lateness from words, s),
 b as (select arrival, max(start_ms) latest from a group by arrival),
 m as (select x.arrival, max(y.latest) seen from b x left join b y on y.arrival < x.arrival group by 1),
 k as (select a.* from a join m using (arrival) where seen is null or start_ms > seen - lateness),
 g as (select *, case when start_ms - lag(end_ms) over (partition by rec_id order by start_ms) > 3000 then 1 else 0 end brk from k),
 u as (select *, sum(brk) over (partition by rec_id order by start_ms rows unbounded preceding) utt from g)
 select rec_id, min(start_ms) start_ms, max(end_ms) end_ms, count(*) n_words from u group by rec_id, utt""")


@query("stream_gap_utterances", _SQL_STREAM)
def stream_gap_utterances(t: Tables) -> DataFrame:
    """Words arrive as files, some out of order, some too late; after each arrival the stream is started again from its
    checkpoint. A last word far ahead moves the watermark past all others."""
    top = t.words.agg(F.max("start_ms")).first()[0] or 0
    lateness = top // _ARRIVALS + 1
    source, out, check = (new_shared_path(t.spark, n) for n in ("words-in", "utterances", "check"))
    arrival = F.expr(_ARRIVAL.format(div="div").replace("top", f"{top}L"))
    words = t.words.withColumn("arrival", arrival).select("arrival", "rec_id", "start_ms", "end_ms")
    for n in range(_ARRIVALS):
        words.where(F.col("arrival") == n).drop("arrival").write.parquet(f"{source}/{n}")
        if n < _ARRIVALS - 1:
            sessions.run_utterances(t.spark, source, out, check, lateness_ms=lateness)
    ahead = top + lateness + 10**9
    sessions.run_utterances(t.spark, source, out, check, lateness_ms=lateness)
    t.spark.range(1).select(F.lit(-1).cast("bigint").alias("rec_id"), F.lit(ahead).cast("bigint").alias("start_ms"),
                            F.lit(ahead).cast("bigint").alias("end_ms")).write.parquet(f"{source}/end")
    sessions.run_utterances(t.spark, source, out, check, lateness_ms=lateness)
    return t.spark.read.parquet(out).select("rec_id", "start_ms", "end_ms", "n_words")


# ------------------------------------------------------------------ whole files, and files read in ranges

_NAME = {f: f"rec%d/rec%d_merged.{f}" for f in ("srt", "txt", "vtt", "ass", "json")}


@query("read_srt_ranges", sql_with("cues", f"with {_SHOWN} {_SOUND.replace('chunk_id, ', '')}"))
def read_srt_ranges(t: Tables) -> DataFrame:
    """One SRT file per recording, read back in ranges of 4 KB, so that most files are several ranges."""
    path = new_shared_path(t.spark, "whole-srt")
    files.write_files(_shown(t), path, F.format_string(_NAME["srt"], "rec_id", "rec_id"), **_flat(t))
    cues = ranges.read_srt_ranges(t.spark, path, range_bytes=4096).where("error is null")
    return cues.select(F.regexp_extract("path", r"/rec(\d+)/", 1).cast("bigint").alias("rec_id"), "start_ms", "end_ms", "content")


def _files_sql() -> str:
    text = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    kept = "where start_ms < end_ms and trim(content) <> ''"
    srt = f"k || chr(10) || {_t('%02d:%02d:%02d,%03d', 'start_ms')} || ' --> ' || {_t('%02d:%02d:%02d,%03d', 'end_ms')} || chr(10) || content || chr(10) || chr(10)"
    parts = [f"""select 'srt' fmt, rec_id, string_agg({srt}, '' order by k) body from
     (select *, row_number() over (partition by rec_id order by start_ms, end_ms, chunk_id, cue_idx) k from shown {kept}) group by rec_id"""]
    for fmt, block in BLOCK_SQL.items():
        head, between, tail = files.FRAMES[fmt]
        block = block.replace("cue_idx", "k")
        parts.append(f"""select '{fmt}', rec_id, {text(head)} || string_agg({block}, {text(between)} order by k) || {text(tail)} from
     (select *, row_number() over (partition by rec_id order by chunk_id, cue_idx) k from shown) group by rec_id""")
    return sql_with("cues", f"""with {_SHOWN}, f as ({" union all ".join(parts)})
 select fmt, rec_id, 'rec' || rec_id || '/rec' || rec_id || '_merged.' || fmt as file, cast(strlen(body) as bigint) n_bytes, sha256(body) sha from f""")


@query("write_files", _files_sql())
def write_files(t: Tables) -> DataFrame:
    """All recordings in all formats, one file each; every file as its digest."""
    path = new_shared_path(t.spark, "whole-files")
    for fmt, name in _NAME.items():
        files.write_files(_shown(t), f"{path}/{fmt}", F.format_string(name, "rec_id", "rec_id"), fmt, **_flat(t))
    got = files.read_whole(files.list_files(t.spark, [f"{path}/{fmt}" for fmt in _NAME]))
    part = lambda k: F.regexp_extract("path", r"/(\w+)/(rec(\d+)/[^/]+)$", k)
    return got.select(part(1).alias("fmt"), part(3).cast("bigint").alias("rec_id"), part(2).alias("file"),
                      F.octet_length("content").cast("bigint").alias("n_bytes"), F.sha2("content", 256).alias("sha"))


@query("write_files_json", sql_with("cues", f"""with {_SHOWN} select rec_id, cast(row_number() over (partition by rec_id order by chunk_id, cue_idx) as bigint) "index", content
 from shown"""))
def write_files_json(t: Tables) -> DataFrame:
    """Each written JSON file parsed on its own."""
    path = new_shared_path(t.spark, "whole-json")
    files.write_files(_shown(t), path, F.format_string(_NAME["json"], "rec_id", "rec_id"), "json", **_flat(t))
    rows = t.spark.read.schema("index bigint, start string, end string, content string").option("multiLine", "true").option(
        "recursiveFileLookup", "true").option("mode", "FAILFAST").json(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"/rec(\d+)/", 1).cast("bigint").alias("rec_id"), "index", "content")


# ------------------------------------------------------------------ profiles from stored states

@query("report_rollup", sql_with("cues", """with k as (select rec_id, chunk_id, cue_idx, start_ms, end_ms, lag(end_ms) over (partition by rec_id order by chunk_id, cue_idx) pe
  from cues where chunk_id % 3 <> 1 union all select rec_id, chunk_id, cue_idx, start_ms + 700, end_ms + 700, null from cues where chunk_id % 3 = 1),
 o as (select *, lag(end_ms) over (partition by rec_id order by chunk_id, cue_idx) was from k)
 select rec_id, count(distinct chunk_id) n_chunks, count(*) n_cues, max(end_ms) max_end_ms, count(*) filter (where start_ms < was) "overlaps", true near from o group by 1"""))
def report_rollup(t: Tables) -> DataFrame:
    """The states of all chunks, a third of them replaced by those of new cues, added up per recording."""
    states = materialize(sketches.chunk_states(t.cues), "states")
    new = t.cues.where("chunk_id % 3 = 1").withColumns({"start_ms": F.expr("start_ms + 700"), "end_ms": F.expr("end_ms + 700")})
    states = materialize(sketches.replace_states(states, sketches.chunk_states(new)), "states")
    both = merge.replace_chunks(t.cues.select(*new.columns), new)
    exact = both.groupBy("rec_id").agg(F.count_distinct("start_ms").alias("exact"))
    out = sketches.merge_states(states).join(exact, "rec_id")
    near = F.abs(F.col("distinct_starts") - F.col("exact")) <= 0.07 * F.col("exact")  # four standard deviations
    return out.select("rec_id", "n_chunks", "n_cues", "max_end_ms", "overlaps", near.alias("near"))


@query("level_rollup", sql_with("signal", "select series_id, count(*) n, round(sqrt(avg(value * value)), 6) rms, true near from signal group by 1"))
def level_rollup(t: Tables) -> DataFrame:
    """Levels and the noise floor per series from the states of blocks of 256 samples."""
    states = materialize(sketches.level_states(t.signal, 256), "levels")
    floors = sketches.merge_levels(states)
    m = F.abs("value")
    rank = t.signal.join(floors.select("series_id", "quantile"), "series_id").groupBy("series_id").agg(
        (F.count_if(m < F.col("quantile")) / F.count(F.lit(1))).alias("low"), (F.count_if(m <= F.col("quantile")) / F.count(F.lit(1))).alias("high"))
    near = (F.col("low") <= 0.05 + 0.02) & (F.col("high") >= 0.05 - 0.02)
    return floors.join(rank, "series_id").select("series_id", "n", F.round("rms", 6).alias("rms"), near.alias("near"))


# ------------------------------------------------------------------ a result cache that hits, expires and is compacted

@query("stream_cache", sql_with("words", """with a as (select distinct word k from words where rec_id % 2 = 0), b as (select distinct word k from words where rec_id % 3 = 0)
 select 0 as batch, k as word, k like 't%' as hit, case when k like 't%' then 'old' else k || '!' end as value from a
 union all select 1, k, k like 't%' or k in (select k from a), case when k like 't%' then 'old' else k || '!' end from b"""))
def stream_cache(t: Tables) -> DataFrame:
    """Two batches of words, the stream started anew for the second, through a cache that holds fresh results for words
    with t and expired ones for words with a; then the second batch once more, as after a failure."""
    spark, path, source, out, check = t.spark, *(new_shared_path(t.spark, n) for n in ("cache", "items", "out", "check"))
    cache = result_cache.ResultCache(spark, path, max_parts=1)
    words = materialize(t.words.select(F.col("word").alias("key")).distinct(), "vocabulary")
    for letter, age in (("t", 1), ("a", 8)):
        day = str(spark.sql(f"select date_sub(current_date(), {age})").first()[0])
        when = F.expr(f"current_timestamp() - interval {age} days")
        cache.add(words.where(F.col("key").startswith(letter)).select(
            "key", F.lit("old").alias("value"), when.alias("modified"), F.lit(-age).cast("bigint").alias("batch")), 0, f"0-{age}", day)
    mark = lambda d: d.withColumn("value", F.concat("key", F.lit("!")))
    for n, every in enumerate((2, 3)):
        t.words.where(F.col("rec_id") % every == 0).select(F.col("word").alias("key")).distinct().write.parquet(f"{source}/{n}")
        stream = spark.readStream.schema("key string").option("recursiveFileLookup", "true").parquet(source)
        result_cache.run_cached(stream, cache, mark, out, check)
    result_cache.cached_step(cache, mark, out)(spark.read.parquet(f"{source}/1"), 1)
    return spark.read.option("basePath", out).parquet(out).select(F.col("batch").cast("int").alias("batch"), F.col("key").alias("word"), "hit", "value")
