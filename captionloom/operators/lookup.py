"""Joins with chunk tables, glossaries, dictionaries, responses and caches."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, is_blank, strip, sub, translatable
from ..session import is_small, materialize

CHUNK = ("rec_id", "chunk_id")


def beside(df: DataFrame, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (checked); otherwise as it is."""
    return F.broadcast(df) if is_small(df, limit) else df


def chunk_offset(cues: DataFrame, timing: DataFrame, keys: Sequence[str] = CHUNK) -> DataFrame:
    """Adds ``offset_ms``, the start of the cue's chunk; 0 when the chunk is unknown."""
    starts = timing.select(*keys, F.col("start_ms").alias("offset_ms"))
    return cues.join(starts, list(keys), "left").withColumn("offset_ms", F.coalesce("offset_ms", F.lit(0).cast("bigint")))


def words_in_segment(
    segments: DataFrame, words: DataFrame, tol_ms: int = 100, keys: Sequence[str] = ("rec_id",), finest_ms: int = 10_000,
) -> DataFrame:
    """Words whose time meets a segment's time, with tolerance.

    Time is laid out in grids of doubling width, from ``finest_ms`` on. A segment goes to the grid whose cells are as
    long as itself, so it is one row or two, be it seconds or hours long; a word goes to the cells it touches in each grid
    that holds segments at all, a few dozen at most. Segments and words meet by an equi-join on (key, grid,
    cell). A pair is reported in the first cell both touch.
    """
    grid = lambda at, level: F.floor(at / (F.lit(finest_ms) * F.pow(F.lit(2.0), level))).cast("bigint")
    segs = segments.select(*keys, "seg_idx", F.greatest(F.col("start_ms") - tol_ms, F.lit(0)).alias("_lo"), (F.col("end_ms") + tol_ms).alias("_hi"))
    size = (F.col("_hi") - F.col("_lo") + 1) / F.lit(finest_ms)
    segs = segs.filter("_hi >= _lo").withColumn("_g", F.greatest(F.lit(0), F.ceil(F.log2(size))).cast("int"))
    levels = sorted(r[0] for r in segs.select("_g").distinct().collect())  # at most 50: doublings of the finest cell
    if not levels:
        levels = [0]

    def laid(df: DataFrame, low: str, high: str) -> DataFrame:
        return df.withColumn("_b", F.explode(F.sequence(grid(F.col(low), F.col("_g")), grid(F.col(high), F.col("_g")))))

    ws = words.filter("end_ms >= start_ms").select(*keys, "word_idx", "word", "start_ms", "end_ms")
    ws = laid(ws.withColumn("_g", F.explode(F.array(*map(F.lit, levels)))), "start_ms", "end_ms")
    hit = (F.col("end_ms") >= F.col("_lo")) & (F.col("start_ms") <= F.col("_hi"))
    first = F.col("_b") == F.greatest(grid(F.col("_lo"), F.col("_g")), grid(F.col("start_ms"), F.col("_g")))
    return laid(segs, "_lo", "_hi").join(ws, [*keys, "_g", "_b"]).filter(hit & first).drop("_g", "_b", "_lo", "_hi")


# ------------------------------------------------------------------ glossary

def _rule_pattern(term: str) -> str:
    """Whole-word pattern of a term: a word boundary on both sides."""
    left = rf"(?<![{WORD}])" if re.match(r"\w", term) else rf"(?<=[{WORD}])"
    right = rf"(?![{WORD}])" if re.search(r"\w\Z", term) else rf"(?=[{WORD}])"
    return rf"{left}\Q{term}\E{right}"


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def _fold(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply rules in order, each on the result of those before it. The rules are data of the expression, so the
    plan does not grow with them, and any number of them takes the same way."""
    table = F.array(*[F.struct(F.lit("(?iu)" + _rule_pattern(t)).alias("p"), F.lit(_literal(r)).alias("r")) for t, r in rules])
    return F.aggregate(table, text, lambda acc, r: F.regexp_replace(acc, r["p"], r["r"]))


def apply_glossary(df: DataFrame, rules: DataFrame, text: str = "text", slice_size: int = 1000) -> DataFrame:
    """Replace whole words, ignoring case, rule after rule in ``ord`` order (later rules see earlier results).

    ``rules``: ``ord, term, replacement``; a rule that is given twice counts once. Texts without any term are passed
    over by one combined test. Glossaries beyond ``slice_size`` rules are applied slice by slice, with a stored table in between,
    so that neither the driver nor the plan ever holds more than one slice.
    """
    place = F.struct("ord", "term", "replacement")
    ordered = rules.select("ord", "term", "replacement").distinct().orderBy("ord", "term", "replacement")
    last, sliced = None, 0
    while True:
        part = ordered if last is None else ordered.filter(place > F.struct(*[F.lit(x) for x in last]))
        got = part.limit(slice_size).collect()
        if not got:
            return df
        if sliced:
            df = materialize(df, "glossary")
        pairs = [(r["term"], r["replacement"]) for r in got]
        any_term = "(?iu)" + "|".join(_rule_pattern(t) for t, _ in pairs)
        df = df.withColumn(text, F.when(F.col(text).rlike(any_term), _fold(F.col(text), pairs)).otherwise(F.col(text)))
        if len(got) < slice_size:
            return df
        last, sliced = tuple(got[-1]), sliced + 1


def pretranslate(
    df: DataFrame, dictionary: DataFrame, text: str = "text", into: str = "translated",
    translator: Callable[[Column], Column] | None = None, broadcast_rows: int = 20_000,
) -> DataFrame:
    """Whole-text dictionary hit, else the translator for texts with word characters, else the text itself.

    Only distinct texts that miss the dictionary are given to the translator, so a caption repeated a
    million times is translated once. Of entries for the same term the last by ``ord`` counts (without that
    column, the largest).
    """
    last = F.max_by("replacement", F.struct("ord", "replacement")) if "ord" in dictionary.columns else F.max("replacement")
    known = dictionary.groupBy(F.col("term").alias(text)).agg(last.alias("_hit"))
    out = df.join(beside(known, broadcast_rows), text, "left")
    if translator is None:
        return out.withColumn(into, F.coalesce("_hit", text)).drop("_hit")
    todo = out.filter(F.col("_hit").isNull() & translatable(F.col(text)) & ~is_blank(F.col(text))).select(text).distinct()
    done = materialize(todo.withColumn("_new", translator(F.col(text))), "translated")
    out = out.join(done, text, "left")
    return out.withColumn(into, F.coalesce("_hit", "_new", text)).drop("_hit", "_new")


# ------------------------------------------------------------------ batch responses

def restore_timing(source: DataFrame, answers: DataFrame, keys: Sequence[str] = ("rec_id", "batch_id")) -> DataFrame:
    """The i-th answer takes the i-th source time; further answers keep their own; missing ones vanish."""
    times = source.select(*keys, "pos", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    out = answers.join(times, [*keys, "pos"], "left")
    return out.withColumns({"start_ms": F.coalesce("_s", "start_ms"), "end_ms": F.coalesce("_e", "end_ms")}).drop("_s", "_e")


def count_mismatch(source: DataFrame, answers: DataFrame, keys: Sequence[str] = ("rec_id", "batch_id")) -> DataFrame:
    """Batches whose answer has another number of cues than the source."""
    a = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_source"))
    b = answers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_answer"))
    return a.join(b, list(keys), "left").withColumn("n_answer", F.coalesce("n_answer", F.lit(0).cast("bigint"))).filter("n_source <> n_answer")


def fix_bilingual(content: Column, source: Column) -> Column:
    """One line: the source goes below it. More lines: the first two that are not blank."""
    lines = F.split(strip(content), "\n", -1)
    kept = F.filter(F.transform(lines, strip), lambda x: x != "")
    below = F.coalesce(source, F.lit(""))
    return F.when(F.size(lines) == 1, F.concat_ws("\n", F.get(lines, F.lit(0)), below)).when(
        F.size(kept) >= 2, F.array_join(F.slice(kept, 1, 2), "\n")).otherwise(F.concat_ws("\n", F.get(kept, F.lit(0)), below))


def keep_failed(source: DataFrame, answers: DataFrame, failed: DataFrame, keys: Sequence[str] = ("rec_id", "batch_id")) -> DataFrame:
    """Answers, and the source cues of the failed batches."""
    kept = source.join(failed.select(*keys).distinct(), list(keys), "left_semi")
    return answers.unionByName(kept.select(*answers.columns))


# ------------------------------------------------------------------ cache

def cache_key(content: Column, model: Column, params: Sequence[Column]) -> Column:
    """sha256 of the content, model name and the first eight digits of the md5 of the parameters."""
    return F.concat_ws("_", F.sha2(content, 256), model, F.substring(F.md5(F.concat_ws("_", *params).cast("binary")), 1, 8))


def cached_lookup(todo: DataFrame, cache: DataFrame, now: Column, key: str = "key", days: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)`` against cache rows (``key, value, modified``) younger than ``days``; of rows with the same
    key the youngest counts. Only cache rows of keys that are asked for are compared by age."""
    fresh = cache.filter(F.floor((F.unix_timestamp(now) - F.unix_timestamp("modified")) / 86400) < days)
    fresh = fresh.join(todo.select(key).distinct(), key, "left_semi")
    fresh = fresh.groupBy(key).agg(F.max_by("value", F.struct("modified", "value")).alias("value"))
    return todo.join(fresh.select(key, "value"), key), todo.join(fresh, key, "left_anti")


def pick_source(chunks: DataFrame, raw: DataFrame, prepared: DataFrame, keys: Sequence[str] = CHUNK, use_prepared: bool = True) -> DataFrame:
    """Prepared file if wanted and present, else the raw one, else null (``picked``)."""
    out = chunks.join(raw.select(*keys, F.col("path").alias("_raw")), list(keys), "left").join(
        prepared.select(*keys, F.col("path").alias("_prep")), list(keys), "left")
    picked = F.coalesce("_prep", "_raw") if use_prepared else F.col("_raw")
    return out.withColumn("picked", picked).drop("_raw", "_prep")
