"""Readers, writers and streams on small files."""

import datetime as dt
import json
import math
import os
import struct
import wave

import pytest
from helpers import rows
from pyspark.sql import functions as F

from captionloom.operators import segment
from captionloom.sources import read, write
from captionloom.streaming import incremental

SRT = "1\n00:00:01,000 --> 00:00:02,500\nHello\nBonjour\n\n2\n00:00:02,000 --> 00:00:03,000\nTwo \n\n"


def put(path, text, **kw):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", **kw) as f:
        f.write(text)


def test_read_srt_with_odd_files(spark, tmp_path):
    put(f"{tmp_path}/p/chunk_1.srt", SRT)
    put(f"{tmp_path}/p/chunk_2.srt", "﻿" + SRT.replace("\n", "\r\n"), newline="")
    put(f"{tmp_path}/p/chunk_10.srt", "junk without times\n\n\n\n7\n0:00:05.5 --> 0:00:06\nlast")
    put(f"{tmp_path}/p/chunk_3.srt.bak", SRT)
    put(f"{tmp_path}/p/chunk_x.srt", SRT)
    cues = read.read_chunks(spark, str(tmp_path))
    good = rows(cues.filter("_corrupt is null").select("chunk_id", "cue_idx", "start_ms", "end_ms", "content"), "chunk_id", "cue_idx")
    two = [(1, 1000, 2500, "Hello\nBonjour"), (2, 2000, 3000, "Two ")]
    assert [g[1:] for g in good if g[0] in (1, 3)] == two + two
    assert [g[1:4] for g in good if g[0] == 2] == [x[:3] for x in two]
    assert [g for g in good if g[0] == 10] == [(10, 7, 5500, 6000, "last")]
    assert [r._corrupt for r in cues.filter("_corrupt is not null").collect()] == ["junk without times"]
    assert sorted(r.chunk_id for r in read.discover_chunks(spark, str(tmp_path)).collect()) == [1, 2, 3, 10]


def test_srt_round_trip_with_one_recording_in_many_files(spark, tmp_path):
    data = [(1, 0, i, 1000 * (50 - i), 1000 * (50 - i) + 900, f"line {i}\nzwei {i}") for i in range(50)]
    data += [(1, 0, 60, 5, 5, "none"), (1, 0, 61, 5, 9, "  "), (2, 0, 0, 7, 8, "x\n\ny")]
    cues = spark.createDataFrame(data, "rec_id bigint, chunk_id int, cue_idx bigint, start_ms bigint, end_ms bigint, content string")
    out = f"{tmp_path}/srt"
    write.write_blocks(cues, out, width=7)
    parts = sorted(f for f in os.listdir(f"{out}/rec_id=1") if f.startswith("part"))
    text = "".join(open(f"{out}/rec_id=1/{p}", encoding="utf-8").read() for p in parts)
    assert [int(b.split("\n")[0]) for b in text.strip().split("\n\n")] == list(range(1, 51))
    assert text.startswith("1\n00:00:01,000 --> 00:00:01,900\nline 49\nzwei 49\n\n2\n")
    back = rows(read.read_srt(spark, out).filter("path like '%rec_id=1%'").select("cue_idx", "start_ms", "content"), "cue_idx")
    assert [b[1:] for b in back] == [(1000 * k, f"line {50 - k}\nzwei {50 - k}") for k in range(1, 51)]
    assert "\n\ny" not in open(f"{out}/rec_id=2/" + next(f for f in os.listdir(f"{out}/rec_id=2") if f.startswith("part"))).read()


def test_other_formats(spark, tmp_path):
    cues = spark.createDataFrame([(1, 0, 0, 1000, 2500, "a\nb"), (1, 0, 1, 59996, 61000, 'q"')],
                                 "rec_id bigint, chunk_id int, cue_idx bigint, start_ms bigint, end_ms bigint, content string")

    def text(fmt):
        out = f"{tmp_path}/{fmt}"
        write.write_blocks(cues, out, fmt)
        files = sorted(f for f in os.listdir(f"{out}/rec_id=1") if f.startswith("part"))
        return "".join(open(f"{out}/rec_id=1/{f}", encoding="utf-8").read() for f in files)

    assert text("vtt") == "WEBVTT\n\n00:00:01.000 --> 00:00:02.500\na\nb\n\n00:00:59.996 --> 00:01:01.000\nq\"\n\n"
    assert text("txt").startswith("[0:00:01 --> 0:00:02.500000]\na\nb\n\n[0:00:59.996000 --> ")
    assert text("ass").endswith("Dialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,a\\Nb\nDialogue: 0,0:01:00.00,0:01:01.00,Default,,0,0,0,,q\"\n")
    assert json.loads(text("json")) == [
        {"index": 1, "start": "0:00:01", "end": "0:00:02.500000", "content": "a\nb"},
        {"index": 2, "start": "0:00:59.996000", "end": "0:01:01", "content": 'q"'}]


def test_rewriting_one_chunk_leaves_the_others(spark, tmp_path):
    make = lambda c, x: spark.createDataFrame([(1, c, 0, 0, 10, x)], "rec_id bigint, chunk_id int, cue_idx bigint, start_ms bigint, end_ms bigint, content string")
    out = f"{tmp_path}/chunks"
    write.write_chunks(make(0, "old0").unionByName(make(1, "old1")), out)
    write.write_chunks(make(1, "new1"), out)
    assert sorted(r.content for r in read.read_srt(spark, out).collect()) == ["new1", "old0"]


def test_small_chunks_are_one_plain_file_each(spark, tmp_path):
    """No checksum file beside it, and folders of any earlier parts replaced as a whole."""
    kinds = "rec_id bigint, chunk_id int, cue_idx bigint, start_ms bigint, end_ms bigint, content string"
    cues = spark.createDataFrame([(r, c, k, 10 * k, 10 * k + 9, f"{r} {c} {k}") for r in range(3) for c in range(4) for k in range(5)], kinds).repartition(5)
    out = f"{tmp_path}/chunks"
    put(f"{out}/rec_id=1/chunk_id=2/part-old-7.txt", "1\n00:00:00,000 --> 00:00:00,010\nstale\n")
    write.write_chunks(cues, out)
    found = sorted(os.path.relpath(os.path.join(d, f), out) for d, _, names in os.walk(out) for f in names)
    assert found == [f"rec_id={r}/chunk_id={c}/part-00000.txt" for r in range(3) for c in range(4)]
    assert open(f"{out}/rec_id=1/chunk_id=2/part-00000.txt").read().startswith("1\n00:00:00,000 --> 00:00:00,009\n1 2 0\n\n2\n")
    assert sorted(r.content for r in read.read_srt(spark, out).collect()) == sorted(r.content for r in cues.collect())
    timing = cues.select("rec_id", F.expr("chunk_id * 10 + cue_idx").alias("chunk_id"), "start_ms", "end_ms", F.lit(9).alias("duration_ms"))
    write.write_chunk_timing(timing, f"{tmp_path}/w")
    assert sorted(f for _, _, names in os.walk(f"{tmp_path}/w") for f in names) == ["part-00000.json"] * 3
    assert read.read_chunk_timing(spark, f"{tmp_path}/w", lines=True).count() == 60
    with pytest.raises(Exception):
        write.write_chunk_timing(timing, f"{tmp_path}/w")


def test_readers_of_small_files_leave_the_session_alone(spark):
    from captionloom.session import small_files_session

    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    small = small_files_session(spark)
    assert spark.conf.get(key) == before and int(small.conf.get(key)) < 1 << 20
    assert small.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")


def test_manifest_glossary_transcripts(spark, tmp_path):
    put(f"{tmp_path}/m/recA/chunk_timing.json", json.dumps([dict(chunk_index=1, start_time_ms=0, end_time_ms=5, duration_ms=5)], indent=4))
    assert rows(read.read_chunk_timing(spark, f"{tmp_path}/m")) == [("recA", 1, 0, 5, 5)]
    timing = spark.createDataFrame([(7, 1, 0, 5, 5), (7, 2, 5, 9, 4), (8, 1, 0, 3, 3)], "rec_id bigint, chunk_id int, start_ms bigint, end_ms bigint, duration_ms bigint")
    write.write_chunk_timing(timing, f"{tmp_path}/w")
    assert rows(read.read_chunk_timing(spark, f"{tmp_path}/w", lines=True), "recording", "chunk_id") == [
        ("rec_id=7", 1, 0, 5, 5), ("rec_id=7", 2, 5, 9, 4), ("rec_id=8", 1, 0, 3, 3)]
    put(f"{tmp_path}/g/a.json", json.dumps({"exact_replace": {"Old Town": "Oldtown"}, "pre_translate": {"Hi You": "x"}}))
    put(f"{tmp_path}/g/b.json", "{broken")
    assert sorted(map(tuple, read.read_glossary(spark, f"{tmp_path}/g").collect())) == [("exact_replace", 0, "old town", "Oldtown"), ("pre_translate", 0, "Hi You", "x")]
    put(f"{tmp_path}/t/a.json", json.dumps({"rec_id": 1, "chunk_id": 2, "segments": [
        {"text": "x", "words": [{"word": " a ", "start": 0.5, "end": 0.75}, {"word": " "}, {"word": "b", "start": 1.0}]}, {"text": "no words"}]})
        + "\n" + json.dumps({"rec_id": 2, "chunk_id": 0}))
    nested = read.read_transcripts(spark, f"{tmp_path}/t")
    assert nested.filter("size(segments) = 0").count() == 1
    assert rows(segment.explode_words(nested), "word_idx") == [(1, 2, 0, 0, "a", 500, 750), (1, 2, 0, 1, "b", 1000, 1000)]


def test_cues_keep_their_empty_lines(spark, tmp_path):
    text = "1\n00:00:01,000 --> 00:00:02,500\nHello\n\nsecond\n\n\nthird\n\n2\n00:00:02,000 --> 00:00:03,000\nTwo\n\n00:00:04,000 --> 00:00:05,000\nno number\n"
    put(f"{tmp_path}/p/chunk_1.srt", text)
    put(f"{tmp_path}/p/chunk_2.srt", "")
    cues = read.read_srt(spark, str(tmp_path))
    want = [(1000, "Hello\n\nsecond\n\n\nthird"), (2000, "Two"), (4000, "no number")]
    assert rows(cues.select("start_ms", "content"), "start_ms") == want and cues.filter("_corrupt is not null").count() == 0
    parsed = read.parse_srt_text(spark.createDataFrame([(text,)], "t string"), "t")
    assert rows(parsed.select("pos", "start_ms", "content"), "pos") == [(i, *w) for i, w in enumerate(want)]
    assert read.skipped_files(spark, str(tmp_path)).count() == 0


def test_unreadable_files_are_listed(spark, tmp_path):
    import gzip

    put(f"{tmp_path}/p/chunk_1.srt", SRT)
    whole = gzip.compress(SRT.encode() * 50)
    with open(f"{tmp_path}/p/chunk_2.srt.gz", "wb") as f:
        f.write(whole[: len(whole) // 2])
    assert read.read_srt(spark, str(tmp_path)).count() == 2
    assert [r.path.rsplit("/", 1)[1] for r in read.skipped_files(spark, str(tmp_path)).collect()] == ["chunk_2.srt.gz"]


def test_wav_forms(spark, tmp_path):
    import numpy as np

    def wav(name, kind, bits, data, extra=b""):
        fmt = struct.pack("<HHIIHH", kind, 1, 8000, 8000 * bits // 8, bits // 8, bits) + extra
        body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
        with open(f"{tmp_path}/{name}.wav", "wb") as f:
            f.write(b"RIFF" + struct.pack("<I", len(body)) + body)

    x = np.array([0, 1, -1, 100, -20000, 32767, -32768])
    wav("a8", 1, 8, ((x // 256) + 128).astype("u1").tobytes())
    wav("b16", 1, 16, x.astype("<i2").tobytes())
    wav("c24", 1, 24, b"".join(int(v * 256).to_bytes(3, "little", signed=True) for v in x))
    wav("d32", 1, 32, (x * 65536).astype("<i4").tobytes())
    wav("e32f", 3, 32, (x / 32768).astype("<f4").tobytes())
    wav("f64f", 3, 64, (x / 32768).astype("<f8").tobytes())
    wav("g24x", 0xFFFE, 24, b"".join(int(v * 256).to_bytes(3, "little", signed=True) for v in x), struct.pack("<HHI", 22, 24, 0) + b"\x01\x00" + b"\0" * 14)
    wav("h4", 17, 4, b"\0" * 8)
    put(f"{tmp_path}/i.wav", "no sound")
    got = read.read_signal(spark, str(tmp_path))
    per = {}
    for r in got.orderBy("path", "idx").collect():
        per.setdefault(r.path.rsplit("/", 1)[1][:-4], []).append(None if r.idx is None else r.value)
    assert per.pop("a8") == [256.0 * v for v in x // 256]
    assert per.pop("h4") == [None] and per.pop("i") == [None]
    assert sorted(per) == ["b16", "c24", "d32", "e32f", "f64f", "g24x"] and all(v == [float(k) for k in x] for v in per.values())


def test_wav(spark, tmp_path):
    wavs = [[round(9000 * math.sin(i / 5)) for i in range(50)], [-i for i in range(50)]]
    with wave.open(f"{tmp_path}/s.wav", "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(b"".join(struct.pack("<hh", a, b) for a, b in zip(*wavs)))
    got = read.read_signal(spark, str(tmp_path))
    for ch in (0, 1):
        assert [r[0] for r in got.filter(F.col("channel") == ch).orderBy("idx").select("value").collect()] == wavs[ch]
    assert got.first().rate == 8000


def test_catalog(spark, tmp_path):
    for name in ("a/chunk_2.srt", "a/chunk_10.srt", "a/api_llm/chunk_1.srt", "b/b_merged.srt", "b/chunk_1.srt", "c/zz/chunk_4.srt"):
        put(f"{tmp_path}/{name}", SRT)
    files = read.catalog(spark, str(tmp_path))
    assert [tuple(r) for r in read.subfolders(files).collect()] == [("a", "original"), ("a", "api_llm"), ("b", "original"), ("c", "zz")]
    pick = lambda m: sorted(f"{r.project}/{r.file}" for r in read.choose_sources(files, m).collect())
    assert pick("api") == ["a/chunk_10.srt", "a/chunk_2.srt", "b/b_merged.srt"]
    assert pick("local") == ["a/chunk_10.srt", "a/chunk_2.srt", "b/b_merged.srt", "b/chunk_1.srt"]


def test_chunk_stream_takes_only_new_files(spark, tmp_path):
    src, out, check = (f"{tmp_path}/{n}" for n in ("src", "out", "check"))
    put(f"{src}/chunk_1.srt", SRT)
    run = lambda: incremental.run_available(incremental.stream_chunks(spark, src), out, check)
    run()
    assert spark.read.parquet(out).count() == 2
    put(f"{src}/chunk_2.srt", SRT)
    run()
    run()
    assert rows(spark.read.parquet(out).groupBy("chunk_id").count(), "chunk_id") == [(1, 2), (2, 2)]


def test_cached_stream(spark, tmp_path):
    src, cache, out, check = (f"{tmp_path}/{n}" for n in ("src", "cache", "out", "check"))
    asked = spark.sparkContext.accumulator(0)

    def compute(df):
        asked.add(df.count())
        return df.withColumn("value", F.upper("key"))

    for batch in (["a", "b", "b"], ["b", "c"]):
        spark.createDataFrame([(x,) for x in batch], "key string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("key string").parquet(src)
        incremental.stream_cached(stream, cache, compute, out, check)
    got = rows(spark.read.option("basePath", out).parquet(f"{out}/*").select("batch", "key", "value", "hit"), "batch", "key")
    assert got == [(0, "a", "A", False), (0, "b", "B", False), (0, "b", "B", False), (1, "b", "B", True), (1, "c", "C", False)]
    assert asked.value == 3


def test_a_repeated_batch_replaces_its_own_output(spark, tmp_path):
    src, cache, out, check = (f"{tmp_path}/{n}" for n in ("src", "cache", "out", "check"))
    spark.createDataFrame([("a",), ("b",)], "key string").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("key string").parquet(src)
    upper = lambda d: d.withColumn("value", F.upper("key"))
    incremental.stream_cached(stream(), cache, upper, out, check)
    want = rows(spark.read.parquet(f"{out}/batch=0"), "key")
    os.remove(f"{check}/commits/0")  # the commit was lost: the batch runs again
    os.remove(f"{check}/commits/.0.crc")
    incremental.stream_cached(stream(), cache, upper, out, check)
    assert rows(spark.read.parquet(f"{out}/batch=0"), "key") == want
    assert spark.read.parquet(cache).count() == 2


def test_old_cache_rows_are_not_used(spark, tmp_path):
    src, cache, out, check = (f"{tmp_path}/{n}" for n in ("src", "cache", "out", "check"))
    spark.createDataFrame([("old",), ("young",), ("none",)], "key string").coalesce(1).write.parquet(src)
    kept = spark.sql("select 'old' key, 'x' value, current_timestamp() - interval 30 day modified, current_date() - 30 day, 7L batch union all "
                     "select 'young', 'y', current_timestamp() - interval 1 day, current_date() - 1, 7L")
    kept.write.partitionBy("day", "batch").parquet(cache)
    incremental.stream_cached(spark.readStream.schema("key string").parquet(src), cache, lambda d: d.withColumn("value", F.upper("key")), out, check)
    got = rows(spark.read.parquet(f"{out}/batch=0").select("key", "value", "hit"), "key")
    assert got == [("none", "NONE", False), ("old", "OLD", False), ("young", "y", True)]


def test_the_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    import pytest

    from captionloom import session

    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)
    cluster.conf.get = lambda k, d: "hdfs://x/y/"
    assert session.shared_dir(cluster) == "hdfs://x/y"


def test_streamed_pauses_equal_the_batch(spark, tmp_path, t):
    ts = F.expr("timestamp_millis(start_ms)")
    words = t.words.withColumn("ts", ts)
    last = F.lit(dt.datetime(2030, 1, 1))
    # a far word moves the watermark past everything else
    end = words.limit(1).withColumns({"rec_id": F.lit(-1).cast("bigint"), "ts": last.cast("timestamp")})
    src, out, check = (f"{tmp_path}/{n}" for n in ("src", "out", "check"))
    words.coalesce(2).write.parquet(src)
    stream = lambda: incremental.stream_utterances(spark.readStream.schema(words.schema).parquet(src))
    incremental.run_available(stream(), out, check)
    end.write.mode("append").parquet(src)
    incremental.run_available(stream(), out, check)
    got = rows(spark.read.parquet(out).filter("rec_id >= 0").select("rec_id", "start_ms", "end_ms", "n_words"), "rec_id", "start_ms")
    want = rows(segment.utterances(t.words).select("rec_id", "start_ms", "end_ms", "n_words"), "rec_id", "start_ms")
    assert got == want and want


def test_gap_of_exactly_three_seconds_joins(spark):
    data = [(1, 0, 0, 100), (1, 1, 3100, 3200), (1, 2, 6201, 6300)]
    df = spark.createDataFrame(data, "rec_id bigint, word_idx bigint, start_ms bigint, end_ms bigint").withColumn("ts", F.expr("timestamp_millis(start_ms)"))
    assert sorted(r.n_words for r in incremental.stream_utterances(df).collect()) == [1, 2]
    assert sorted(r.n_words for r in segment.utterances(df).collect()) == [1, 2]


def test_the_manifest_holds_every_chunk(spark, tmp_path):
    from captionloom.plans import registry

    # 10,003 chunks of a recording are two arrays; (1 + 16) % 17 = 0 is left out of ``chunk_timing`` alone
    spark.range(20006).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("a b").alias("text")).coalesce(
        1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.all_queries()["read_chunk_timing"](spark, str(tmp_path))
    assert rows(got.select("chunk_id"), "chunk_id") == [(k,) for k in range(10003)]
    assert got.select("recording").distinct().collect() == [("rec_id=1",)]


def test_chunk_stream_by_lists(spark, tmp_path, monkeypatch):
    src, out, check, known = (f"{tmp_path}/{n}" for n in ("s r#c", "out", "check", "known"))
    monkeypatch.setattr(incremental, "LISTED", 2)
    for name in ("chunk_1.srt", "a/chunk_2.srt", "a/b/chunk_3.srt", "a b%/chunk_4.srt.x", "é/chunk_5.srt", "a/x_chunk_6.srt", ".a/chunk_7.srt", "a/_b/chunk_8.srt", "a/chunk_x.srt"):
        put(f"{src}/{name}", SRT)
    put(f"{src}/a/chunk_9.srt", "")
    run = lambda **kw: incremental.run_available(incremental.stream_chunks(spark, src, **kw), out, check)
    run(max_files=4, known=known)
    assert rows(spark.read.parquet(out).groupBy("chunk_id").count(), "chunk_id") == [(k, 2) for k in range(1, 6)]
    put(f"{src}/a/chunk_10.srt", SRT)
    run(known=known)
    run(known=f"file://{known}")
    got = spark.read.parquet(out)
    assert rows(got.groupBy("chunk_id").count(), "chunk_id") == [(k, 2) for k in (1, 2, 3, 4, 5, 10)]
    incremental.run_available(incremental.stream_chunks(spark, src), f"{out}2", f"{check}2")  # Spark's own file stream
    want = spark.read.parquet(f"{out}2")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert rows(got, "path", "start_ms") == rows(want, "path", "start_ms")


def test_no_file_names_come_to_the_driver(spark, tmp_path):
    import pickle

    import pyarrow as pa

    from captionloom.sources import files

    writer = files.FileWriter(f"{tmp_path}/x", "lines", folders=True)
    write = lambda names, block: writer.write(iter([pa.RecordBatch.from_pylist([{"file": f, "block": block} for f in names])]))
    names = [f"k={k}/part.txt" for k in range(3000)]
    told = write(names, "old")
    assert len(pickle.dumps(told)) < 1000
    writer.commit([told])
    # folders that get files are replaced, others stay, and two tasks may write to one folder
    writer.commit([write(names[:10], "new"), None, write(["k=1/more.txt"], "more")])
    text = lambda f: open(f"{tmp_path}/x/{f}").read()
    assert [text(f) for f in names] == ["new"] * 10 + ["old"] * 2990 and text("k=1/more.txt") == "more"
    found = files.list_files(spark, [f"{tmp_path}/x", f"{tmp_path}/none"], "more")
    assert [tuple(r) for r in files.read_whole(found).collect()] == [(f"file:{tmp_path}/x/k=1/more.txt", bytearray(b"more"))]
