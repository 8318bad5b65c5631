"""Interval joins of long segments, result caches, and profiles from stored states."""

import datetime as dt
import os
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from captionloom.operators import lookup, merge, signal, sketches
from captionloom.streaming import cache as rc

# ---- interval join --------------------------------------------------------------------------------------------------------


def test_segments_of_any_length_meet_their_words(spark):
    r = random.Random(3)
    segs = [(k % 3, k, at, at + n) for k in range(60) for at in [r.randrange(0, 10**7)] for n in [r.choice([0, 50, 9000, 70_000, 3_600_000, 10**8, -5000])]]
    words = [(k % 3, k, "w", at, at + r.choice([0, 100, 15_000, -1])) for k in range(400) for at in [r.randrange(0, 10**7)]]
    got = lookup.words_in_segment(spark.createDataFrame(segs, "rec_id bigint, seg_idx bigint, start_ms bigint, end_ms bigint"),
                                  spark.createDataFrame(words, "rec_id bigint, word_idx bigint, word string, start_ms bigint, end_ms bigint"))
    want = sorted((s[0], s[1], w[1]) for s in segs for w in words
                  if s[0] == w[0] and w[4] >= w[3] and s[3] + 100 >= max(s[2] - 100, 0) and w[4] >= max(s[2] - 100, 0) and w[3] <= s[3] + 100)
    assert sorted(rows(got.select("rec_id", "seg_idx", "word_idx"))) == want and len(want) > 500


def test_long_segments_are_few_rows(spark):
    segs = spark.createDataFrame([(1, k, 0, 10**k) for k in range(1, 11)], "rec_id bigint, seg_idx bigint, start_ms bigint, end_ms bigint")
    words = spark.createDataFrame([(1, 0, "w", 5, 9)], "rec_id bigint, word_idx bigint, word string, start_ms bigint, end_ms bigint")
    assert lookup.words_in_segment(segs, words).count() == 10
    assert lookup.words_in_segment(segs.where("false"), words).count() == 0 == lookup.words_in_segment(segs, words.where("false")).count()


# ---- result cache ---------------------------------------------------------------------------------------------------------


def n_files(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)


def entries(spark, rows_):
    return spark.createDataFrame(rows_, "key string, value string, modified timestamp, batch bigint")


def upper(d):
    return d.withColumn("value", F.upper("key"))


def test_a_hundred_batches_leave_few_files(spark, tmp_path):
    cache = rc.ResultCache(spark, f"{tmp_path}/cache", max_parts=5)
    now = dt.datetime.now()
    most = 0
    for b in range(100):
        cache.add(entries(spark, [(f"k{b % 40}", f"v{b}", now + dt.timedelta(milliseconds=b), b)]).coalesce(1), b)
        cache.compact()
        most = max(most, n_files(f"{tmp_path}/cache"))
    assert most <= 7
    held = dict(rows(cache.read().groupBy("key").agg(F.max_by("value", "modified"))))
    assert held == {f"k{k}": f"v{max(b for b in range(100) if b % 40 == k)}" for k in range(40)}


def test_compaction_that_is_cut_off_loses_and_doubles_nothing(spark, tmp_path):
    cache = rc.ResultCache(spark, f"{tmp_path}/cache", max_parts=2)
    now = dt.datetime.now()
    for b in range(3):
        cache.add(entries(spark, [(f"k{b}", "v", now, b)]), b)
    day = cache.days_held()[0]
    # cut off before the new folder was finished: it does not count
    cache.add(entries(spark, [("k0", "v", now, 0)]), 2, "0-2", day)
    os.remove(f"{tmp_path}/cache/day={day}/0-2/_SUCCESS")
    assert cache.read().count() == 3 and cache.parts(day) == ["0-0", "1-1", "2-2"]
    # cut off after it: the old folders count no more, though they are still there
    cache.add(entries(spark, [(f"k{b}", "v", now, b) for b in range(3)]), 2, "0-2", day)
    assert cache.parts(day) == ["0-2"] and cache.read().count() == 3
    cache.compact()
    assert sorted(os.listdir(f"{tmp_path}/cache/day={day}")) == ["0-2"]


def test_days_out_of_date_go(spark, tmp_path):
    cache = rc.ResultCache(spark, f"{tmp_path}/cache", days=7)
    today = spark.sql("select current_date()").first()[0]
    now = dt.datetime.now()
    for age in (0, 6, 7, 8, 9, 30):
        day = str(today - dt.timedelta(days=age))
        cache.add(entries(spark, [(f"k{age}", "v", now - dt.timedelta(days=age, seconds=5), age)]), age, day=day)
    asked = spark.createDataFrame([(f"k{a}",) for a in (0, 6, 7, 8, 9, 30)], "key string")
    hits, misses = cache.lookup(asked)
    assert sorted(r.key for r in hits.collect()) == ["k0", "k6"] and misses.count() == 4
    cache.compact()
    assert len(cache.days_held()) == 4  # a day counts until its last row is too old


def test_streams_hit_miss_and_repeat(spark, tmp_path):
    cache = rc.ResultCache(spark, f"{tmp_path}/cache", max_parts=1)
    calls = []

    def compute(d):
        calls.append(sorted(r.key for r in d.collect()))
        return upper(d)

    def run(n, keys):
        spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema("key string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        rc.run_cached(stream, cache, compute, f"{tmp_path}/out", f"{tmp_path}/check")
        return sorted((r.key, r.value, r.hit) for r in spark.read.parquet(f"{tmp_path}/out/batch={n}").collect())

    assert run(0, ["a", "a", "b"]) == [("a", "A", False), ("a", "A", False), ("b", "B", False)]
    assert run(1, ["b", "c"]) == [("b", "B", True), ("c", "C", False)]
    assert run(2, ["a", "b", "c"]) == [("a", "A", True), ("b", "B", True), ("c", "C", True)]
    assert calls == [["a", "b"], ["c"], []]
    step = rc.cached_step(cache, compute, f"{tmp_path}/out")
    step(spark.read.parquet(f"{tmp_path}/in/1"), 1)  # as after a failure: what it had cached itself is not read
    assert sorted((r.key, r.hit) for r in spark.read.parquet(f"{tmp_path}/out/batch=1").collect()) == [("b", True), ("c", False)]
    assert calls[-1] == ["c"]


def test_large_batches_meet_the_cache_by_a_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rc, "ASKED", 2)
    cache = rc.ResultCache(spark, f"{tmp_path}/cache")
    cache.add(entries(spark, [("a", "1", dt.datetime.now(), 0), ("z", "1", dt.datetime.now(), 0)]), 0)
    hits, misses = cache.lookup(spark.createDataFrame([(k,) for k in "abcd"], "key string"))
    assert [r.key for r in hits.collect()] == ["a"] and misses.count() == 3


# ---- stored states --------------------------------------------------------------------------------------------------------

CUES = "rec_id bigint, chunk_id int, cue_idx bigint, start_ms bigint, end_ms bigint"


def made_cues(n, seed=1):
    r = random.Random(seed)
    return [(k % 2, k // 200, k, at, at + r.randrange(1, 9000)) for k in range(n) for at in [r.randrange(0, 10**6)]]


def test_merged_states_equal_a_scan(spark):
    data = made_cues(6000)
    states = sketches.chunk_states(spark.createDataFrame(data, CUES))
    got = {r.rec_id: r for r in sketches.merge_states(states).collect()}
    for rec in (0, 1):
        mine = [d for d in data if d[0] == rec]
        distinct = len({d[3] for d in mine})
        want = (30, len(mine), max(d[4] for d in mine), sum(b[3] < a[4] for a, b in zip(mine, mine[1:])))
        assert (got[rec].n_chunks, got[rec].n_cues, got[rec].max_end_ms, got[rec].overlaps) == want
        assert abs(got[rec].distinct_starts - distinct) <= 0.07 * distinct
        assert got[rec].duplicate_starts == max(0, len(mine) - got[rec].distinct_starts)


def test_replaced_chunks_equal_a_rebuild(spark):
    old, new = spark.createDataFrame(made_cues(4000), CUES), spark.createDataFrame(made_cues(4000, 2), CUES).where("chunk_id % 4 = 1")
    swapped = sketches.replace_states(sketches.chunk_states(old), sketches.chunk_states(new))
    rebuilt = sketches.chunk_states(merge.replace_chunks(old, new))
    assert sorted(rows(sketches.merge_states(swapped))) == sorted(rows(sketches.merge_states(rebuilt)))
    assert sketches.merge_states(swapped.where("false")).count() == 0


def test_states_of_null_times(spark):
    data = [(1, 0, 0, None, None), (1, 0, 1, 5, 9), (1, 0, 2, 8, None), (1, 1, 0, 1, 3), (1, 2, 0, 2, 4)]
    got = sketches.merge_states(sketches.chunk_states(spark.createDataFrame(data, CUES))).first()
    assert (got.n_chunks, got.n_cues, got.max_end_ms, got.overlaps, got.distinct_starts) == (3, 5, 9, 2, 4)


def test_quantiles_of_states_keep_their_rank_error(spark):
    r = random.Random(4)
    data = [(s, i, r.gauss(0, 100) if s else float(i % 7)) for s in (0, 1) for i in range(30_000)]
    df = spark.createDataFrame(data, "series_id bigint, idx bigint, value double")
    states = sketches.level_states(df, 1000)
    assert states.count() == 60
    for q in (0.05, 0.5, 0.99):
        for row in sketches.merge_levels(states, q).collect():
            mine = [abs(v) for s, _, v in data if s == row.series_id]
            assert row.n == 30_000 and row.rms == pytest.approx((sum(v * v for v in mine) / len(mine)) ** 0.5)
            assert sum(v < row.quantile for v in mine) / 30_000 <= q + 0.02 and sum(v <= row.quantile for v in mine) / 30_000 >= q - 0.02
    floors = spark.createDataFrame(sketches.merge_levels(states).collect())  # sketches draw lots: one evaluation
    gated = signal.soft_gate(df, floors=floors)
    th = {r.series_id: r.quantile * 1.25 for r in floors.collect()}
    assert all(g == pytest.approx(v * 0.3 if abs(v) < th[s] else v) for (s, _, v), (_, _, g) in zip(sorted(data), sorted(rows(gated.select("series_id", "idx", "value"))), strict=True))
