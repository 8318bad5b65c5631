"""Signal operators against loops, and the composite pipelines."""

import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from captionloom.operators import signal as sg
from captionloom.plans import pipelines

CHUNK = ["rec_id", "chunk_id"]


def _signal(spark, n=900, seed=8):
    rnd = random.Random(seed)
    out, level = [], 1.0
    for s in (1, 2):
        for i in range(n):
            if i % 30 == 0:
                level = rnd.choice([0.0, 0.001, 1.0, 1.0, 3.0])
            out.append((s, i, level * rnd.choice([-1000.0, 1000.0, 700.0])))
    return out, spark.createDataFrame(out, "series_id bigint, idx bigint, value double")


def test_exact_quantile_at_any_scale(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    series = {
        1: rng.uniform(-1, 1, 400), 2: rng.standard_normal(300) * 1e-9, 3: np.append(rng.standard_normal(500), 1e15), 4: np.full(50, 3.25),
        5: np.round(rng.uniform(0, 4, 200)), 6: np.array([7.0]), 7: np.append(np.full(300, 0.5), np.arange(5.0)),
    }
    data = [(k, float(v)) for k, vs in series.items() for v in vs] + [(1, None), (1, float("nan"))]
    df = spark.createDataFrame(data, "series_id bigint, v double")
    for q in (0.0, 0.05, 0.5, 0.731, 1.0):
        for cells, sortable in ((16, 1), (4, 20), (1 << 16, 1 << 16)):
            got = dict(rows(sg.exact_quantile(df, "v", q, cells=cells, sortable=sortable)))
            assert got.keys() == series.keys()
            for k, vs in series.items():
                assert got[k] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-24), (k, q)


def test_exact_quantile_and_gate(spark):
    data, df = _signal(spark)
    got = dict(rows(sg.exact_quantile(df.withColumn("m", F.abs("value")), "m", 0.3)))
    for s in (1, 2):
        vals = np.abs([v for k, _, v in data if k == s])
        assert abs(got[s] - np.percentile(vals, 30)) < 1e-9
    gated = {(r.series_id, r.idx): r.value for r in sg.soft_gate(df).collect()}
    for s in (1, 2):
        floor = np.percentile(np.abs([v for k, _, v in data if k == s]), 5) * 1.25
        for k, i, v in data:
            if k == s:
                assert abs(gated[k, i] - (v * 0.3 if abs(v) < floor else v)) < 1e-9


def test_silence_keeps_its_level(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, 3.0), (2, 1, -3.0)], "series_id bigint, idx bigint, value double")
    got = {(r.series_id, r.idx): r.value for r in sg.level_normalize(df, -20.0).collect()}
    assert got[1, 0] == 0 and abs(got[2, 0] - 3276.8) < 1e-6


def test_change_points(spark):
    data, df = _signal(spark)
    for depth in (0, 2):
        got = rows(sg.change_points(df, 10, 10.0, 0.5, 4.0, depth=depth).select("series_id", "win", "at_sec"), "series_id", "win")
        want = []
        for s in (1, 2):
            x = np.array([v for k, _, v in data if k == s])
            rms = [np.sqrt(np.mean(x[i:i + 10] ** 2)) for i in range(0, len(x) - 10, 10)]
            last = None
            for i in range(1, len(rms)):
                if rms[i - 1] > 0 and abs(rms[i] - rms[i - 1]) / (rms[i - 1] + 1e-6) > 0.5 and (last is None or i - last >= 4):
                    want.append((s, i, float(i)))
                    last = i
        assert got == want and want


def _ranges(x, width, loud, quiet):
    out = []
    for w in range(0, len(x), width):
        part = x[w:w + width]
        if np.sqrt(np.mean(part ** 2)) > loud:
            if out and w - out[-1][1] < quiet:
                out[-1][1] = w + len(part)
            else:
                out.append([w, w + len(part)])
    return [tuple(r) for r in out]


def _cut(ranges, target, window, length):
    lo, hi = max(0, target - window // 2), min(length, target + window // 2)
    near = [(max(a, lo), min(b, hi)) for a, b in ranges if a < hi and b > lo]
    if lo >= hi or not near:
        return target
    gaps = [(b[0] - a[1], -a[1]) for a, b in zip(near, near[1:]) if b[0] > a[1]]
    if gaps:
        g, p = max(gaps)
        return -p + g // 2
    n, p = max((b - a, -a) for a, b in near)
    return -p + n // 2


def test_plan_chunks(spark):
    data, df = _signal(spark)
    ranges = sg.active_ranges(df, 10, -40.0, 30)
    plans = [rows(sg.plan_chunks(df, ranges, 200, 90, 100, n).select("series_id", "chunk_index", "start", "end", "duration"), "series_id", "chunk_index") for n in (1, 2, 64)]
    want = []
    for s in (1, 2):
        x = np.array([v for k, _, v in data if k == s])
        spans = _ranges(x, 10, 327.68, 30)
        assert spans == [r[2:] for r in rows(ranges.filter(F.col("series_id") == s), "start")]
        start, k = 0, 1
        while start < len(x):
            end = len(x) if start + 200 >= len(x) else _cut(spans, start + 200, 90, len(x))
            want.append((s, k, start, end, end - start))
            start, k = end, k + 1
    assert plans == [want] * 3
    one = rows(sg.plan_chunks(df, ranges, 200, 90, 901).select("series_id", "chunk_index", "end"), "series_id")
    assert one == [(1, 1, 900), (2, 1, 900)]


def test_searched_and_carried_times_agree(t):
    """Captions of unedited text: the alignment finds what the carried word ranges say."""
    searched = pipelines.captions(t.words, t.segments, "rule")
    carried = pipelines.captions_on_ranges(t.words, t.segments, profile="a")
    cols = [*CHUNK, "text", "start_ms", "end_ms", "start_word_idx", "end_word_idx"]
    assert searched.filter("confidence < 1").count() == 0
    assert searched.select(*cols).exceptAll(carried.select(*cols)).count() == 0
    assert searched.count() == carried.count()


def test_all_caption_pipelines_keep_the_words(t):
    source = t.words.groupBy(*CHUNK).agg(F.sum(F.length("word")).alias("n"))
    chars = F.sum(F.length(F.regexp_replace("text", " ", ""))).alias("n")
    for out in (pipelines.captions(t.words, t.segments, "segments"), pipelines.captions_on_ranges(t.words, t.segments),
                pipelines.simple_captions(t.words)):
        assert out.groupBy(*CHUNK).agg(chars).exceptAll(source).count() == 0
        assert out.filter("length(text) > 80 and text like '% %'").count() == 0


def test_pause_captions(t):
    out = pipelines.pause_captions(t.words)
    assert out.filter("length(text) > 80 and text like '% %'").count() == 0
    late = out.join(t.words.groupBy(*CHUNK).agg(F.max("end_ms").alias("m")), CHUNK).filter("end_ms > m + 1000").count()
    assert late == 0


def test_fallback_captions_are_repaired(t):
    for words in (None, t.words):
        out = pipelines.captions_fallback(t.segments, words, depth=0)
        assert out.filter("start_ms >= end_ms or word_count < 1 or timing_confidence is null").count() == 0


def test_translate_batches(spark):
    cues = spark.createDataFrame([(1, 0, i, 1000 * i, 1000 * i + 500, f"line{i}") for i in range(7)],
                                 "rec_id bigint, chunk_id int, cue_idx bigint, start_ms bigint, end_ms bigint, content string")

    def client(prompt):
        body = prompt.removeprefix(pipelines.REQUEST[0]).removesuffix(pipelines.REQUEST[1])
        if "line4" in body:
            return None
        if "line6" in body:
            return "Sorry, no captions here."
        if "line2" in body:
            return "1\n00:00:09,000 --> 00:00:10,000\nZWEI\n\nand more"
        return "Sure:\n```srt\n" + body.replace("line", "LINE") + "```"

    got = rows(pipelines.translate_batches(cues, client, 2).select("cue_idx", "start_ms", "end_ms", "content"), "cue_idx")
    assert got == [(1, 0, 500, "LINE0\nline0"), (2, 1000, 1500, "LINE1\nline1"), (3, 2000, 2500, "ZWEI\nand more"),
                   (4, 4000, 4500, "line4"), (5, 5000, 5500, "line5")]


def test_reprocess_replaces_only_the_named_chunks(t):
    out = pipelines.reprocess(t.cues, t.words, t.glossary, t.chunk_timing, "1")
    kept = t.cues.join(t.chunk_timing.filter("chunk_id = 1"), CHUNK, "left_anti")
    assert kept.select(*CHUNK, "content").exceptAll(out.select(*CHUNK, "content")).count() == 0
    nums = out.groupBy("rec_id").agg(F.count("*").alias("n"), F.max("merged_idx").alias("m")).filter("n <> m").count()
    assert nums == 0


def test_run_recordings_reports_empty_chunks(t):
    cues, runs = pipelines.run_recordings(t.words.filter("chunk_id <> 1"), t.segments.filter("chunk_id <> 1"), t.chunk_timing)
    states = dict(rows(runs.groupBy("chunk_id", "status").count().select("chunk_id", "status")))
    assert states[1] == "error" and states[0] == "ok"
    assert cues.filter("chunk_id = 1").select("content").distinct().first()[0] == "[No speech detected in this segment]"
