"""Timed-text tables derived from the given ``conversations`` and ``events`` tables.

Word times are made up from the word lengths (see FIXTURES.md); everything grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.scan import depth_for, ordered_scan, with_rank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn: its words as an array, the index and the time before its first word."""
    raw = table(spark, sf_dir, "conversations")
    rows = raw.select(
        F.col("conv_id").alias("rec_id"),
        F.floor(F.col("turn") / 2).cast("int").alias("chunk_id"),
        F.col("turn").alias("seg_idx"),
        tokens(F.col("text")).alias("ws"),
    )
    pause = "if((rec_id * 31 + seg_idx * 17 + i) % 23 = 0, 3500, 80)"
    rows = rows.withColumns({
        "n": F.size("ws").cast("bigint"),
        "span": F.expr(
            f"aggregate(transform(ws, (w, i) -> 40 + 60 * length(w) + {pause}), 0L, (a, b) -> a + b)"),
    })
    rows = ordered_scan(
        rows, ["rec_id"], ["seg_idx"], sums={"word0": F.col("n"), "ms0": F.col("span")}, width=256,
        depth=depth_for(raw, "turn", 256))
    return rows.filter("n > 0")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec_id, chunk_id, seg_idx, word_idx, word, start_ms, end_ms``."""
    pause = "if((rec_id * 31 + seg_idx * 17 + i) % 23 = 0, 3500, 80)"
    rows = turns(spark, sf_dir).repartition("rec_id", "seg_idx").select(
        "rec_id", "chunk_id", "seg_idx", "word0", "ms0", F.posexplode("ws").alias("i", "word"))
    rows = rows.withColumns({"dur": F.expr("40L + 60L * length(word)"), "gap": F.expr(pause)})
    upto = Window.partitionBy("rec_id", "seg_idx").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("ms0") + F.sum(F.col("dur") + F.col("gap")).over(upto)
    return rows.withColumn("end_ms", end).select(
        "rec_id", "chunk_id", "seg_idx", (F.col("word0") + F.col("i")).alias("word_idx"), "word",
        (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec_id, chunk_id, seg_idx, start_word_idx, end_word_idx, start_ms, end_ms, text``."""
    first_pause = F.expr("if((rec_id * 31 + seg_idx * 17) % 23 = 0, 3500L, 80L)")
    return turns(spark, sf_dir).select(
        "rec_id", "chunk_id", "seg_idx",
        F.col("word0").alias("start_word_idx"),
        (F.col("word0") + F.col("n") - 1).alias("end_word_idx"),
        (F.col("ms0") + first_pause).alias("start_ms"),
        (F.col("ms0") + F.col("span")).alias("end_ms"),
        F.array_join("ws", " ").alias("text"))


def chunk_timing_of(segs: DataFrame) -> DataFrame:
    """``rec_id, chunk_id, start_ms, end_ms, duration_ms``; one chunk in 17 is left out."""
    return all_chunk_timing_of(segs.filter("(rec_id + chunk_id) % 17 <> 0"))


def all_chunk_timing_of(segs: DataFrame) -> DataFrame:
    """As ``chunk_timing``, of every chunk that has a recording and a number."""
    return segs.filter("rec_id is not null and chunk_id is not null").groupBy("rec_id", "chunk_id").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"))


def cues_of(segs: DataFrame) -> DataFrame:
    """Captions with overlaps, zero lengths, blanks and two-line contents."""
    return segs.select(
        "rec_id", "chunk_id", F.col("seg_idx").alias("cue_idx"),
        F.expr("if((rec_id + seg_idx) % 7 = 3, start_ms - 500, start_ms)").alias("start_ms"),
        F.expr("if(seg_idx % 11 = 5, start_ms, end_ms)").alias("end_ms"),
        F.expr(
            "case when (rec_id + seg_idx) % 13 = 0 then ' ' "
            "when seg_idx % 2 = 0 then text || chr(10) || 'T:' || text else text end").alias("content"))


def sentences_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment texts with every ninth word changed and one segment in ten replaced."""
    edit = "case when (rec_id + seg_idx) % 10 = 0 then 'qqq' when (word0 + i) % 9 = 4 then 'zzz' else w end"
    return turns(spark, sf_dir).select(
        "rec_id", "chunk_id", F.col("seg_idx").alias("sent_idx"),
        F.array_join(F.expr(f"transform(ws, (w, i) -> {edit})"), " ").alias("text"))


# fixed values: a multi-word rule, a chain (the third rule sees the second rule's output), a whole-text rule
GLOSSARY_RULES = [
    ("exact_replace", 0, "that", "THAT"),
    ("exact_replace", 1, "and the", "AND-THE"),
    ("exact_replace", 2, "the", "le"),
    ("pre_translate", 3, "In die", "EN DIE"),
]


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GLOSSARY_RULES, "kind string, ord int, term string, replacement string")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, idx, value``: event values in time order, ten series."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 10).alias("series_id"), "value")
    # event ids are spread over the series, so a block of them is a block of every series
    depth = depth_for(rows, "event_id")
    return with_rank(rows, ["series_id"], ["event_id"], "idx", start=0, depth=depth).select("series_id", "idx", "value")


def chunk_runs_of(segs: DataFrame) -> DataFrame:
    n = F.sum(F.col("end_word_idx") - F.col("start_word_idx") + 1)
    return segs.groupBy("rec_id", "chunk_id").agg(n.alias("n_words")).withColumn(
        "status", F.expr("if((rec_id + chunk_id) % 9 = 0, 'error', 'ok')"))


def attempts_of(timing: DataFrame) -> DataFrame:
    return timing.select(
        "rec_id", "chunk_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("attempt")).withColumn(
        "n_anomalies", F.expr("(rec_id * 7 + chunk_id * 3 + attempt * 5) % 6"))


# ---------------------------------------------------------------- the same tables for the SQL check

_SQL = {
    "tok": r"""select conv_id, turn, u.i i, u.w w
from (select conv_id, turn, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') a from conversations) t,
     lateral (select unnest(a) w, generate_subscripts(a, 1) - 1 i) u where u.w <> ''""",
    "words": """select conv_id rec_id, cast(floor(turn/2) as int) chunk_id, turn seg_idx,
 row_number() over (partition by conv_id order by turn,i)-1 word_idx, w word,
 cast(sum(dur+gap) over (partition by conv_id order by turn,i rows unbounded preceding)-dur as bigint) start_ms,
 cast(sum(dur+gap) over (partition by conv_id order by turn,i rows unbounded preceding) as bigint) end_ms
from (select conv_id,turn,i,w, 40+60*length(w) dur,
 case when (conv_id*31+turn*17+i)%23=0 then 3500 else 80 end gap from tok)""",
    "segments": """select rec_id,chunk_id,seg_idx,min(word_idx) start_word_idx,max(word_idx) end_word_idx,
 min(start_ms) start_ms,max(end_ms) end_ms,string_agg(word,' ' order by word_idx) as text
from words group by rec_id,chunk_id,seg_idx""",
    "chunk_timing": """select rec_id,chunk_id,min(start_ms) start_ms,max(end_ms) end_ms,max(end_ms)-min(start_ms) duration_ms
from words group by rec_id,chunk_id having (rec_id+chunk_id)%17<>0""",
    "all_chunk_timing": """select rec_id,chunk_id,min(start_ms) start_ms,max(end_ms) end_ms,max(end_ms)-min(start_ms) duration_ms
from words group by rec_id,chunk_id having rec_id is not null and chunk_id is not null""",
    "cues": """select rec_id,chunk_id,seg_idx cue_idx,
 case when (rec_id+seg_idx)%7=3 then start_ms-500 else start_ms end start_ms,
 case when seg_idx%11=5 then start_ms else end_ms end end_ms,
 case when (rec_id+seg_idx)%13=0 then ' '
  when seg_idx%2=0 then text||chr(10)||'T:'||text else text end as content
from segments""",
    "sentences_edited": """select rec_id,chunk_id,seg_idx sent_idx,
 string_agg(case when (rec_id+seg_idx)%10=0 then 'qqq' when word_idx%9=4 then 'zzz' else word end,' ' order by word_idx) as text
from words group by rec_id,chunk_id,seg_idx""",
    "signal": """select user_id%10 series_id, row_number() over (partition by user_id%10 order by ts,event_id)-1 idx, value
from events""",
    "chunk_runs": """select rec_id,chunk_id,case when (rec_id+chunk_id)%9=0 then 'error' else 'ok' end status,count(*) n_words
from words group by rec_id,chunk_id""",
    "attempts": """select rec_id,chunk_id,a.attempt,(rec_id*7+chunk_id*3+a.attempt*5)%6 n_anomalies
from chunk_timing cross join (values (0),(1),(2)) as a(attempt)""",
}
_NEEDS = {
    "tok": [], "words": ["tok"], "segments": ["words"], "chunk_timing": ["words"], "all_chunk_timing": ["words"], "cues": ["segments"],
    "sentences_edited": ["words"], "signal": [], "chunk_runs": ["words"], "attempts": ["chunk_timing"],
}


def sql_with(names: str, body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the CTEs of the named derived tables (blank-separated) and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS[n]:
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    ctes = ",\n".join(f"{n} as ({_SQL[n]})" for n in order)
    body = body.strip()
    head = "with recursive " if recursive else "with "
    if body.lower().startswith("with "):
        rest = body[5:]
        return f"{head}{ctes},\n{rest}" if ctes else f"{head}{rest}"
    return f"{head}{ctes}\n{body}" if ctes else body
