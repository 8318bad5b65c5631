"""Large glossaries, stateful streams, files read in ranges and written whole."""

import gzip
import io
import json
import os
import random
import struct

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from captionloom.operators import lookup, rewrite, segment
from captionloom.sources import files, ranges, read
from captionloom.streaming import sessions

RULES = "ord int, term string, replacement string"


# ---- glossary -----------------------------------------------------------------------------------------------------------


def both_ways(spark, texts, rules, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], RULES)
    want = dict(rows(lookup.apply_glossary(df, table)))
    got = dict(rows(rewrite.apply_rules(df, table, **kw)))
    assert got == want
    return got


def test_chained_rules_equal_the_fold(spark):
    r = random.Random(4)
    words = ["ab", "cd", "Ef", "é", "ÇA", "x1", "_u", "c++", ".net", "-", "straße", "ſ", "K"]
    term = lambda: " ".join(r.choice(words) for _ in range(r.choice([1, 1, 1, 2, 3])))
    rules = [(term(), r.choice([term(), term() + "-x", "", "$1\\2", term().upper()])) for _ in range(300)]
    texts = ["".join(r.choice([*words, " ", " ", ", ", "\n", "-"]) + r.choice(["", " "]) for _ in range(r.randrange(60))) for _ in range(150)]
    got = both_ways(spark, [*texts, None, ""], rules)
    assert sum(got[i] != t for i, t in enumerate(texts)) > 100


def test_rules_that_arise_from_rules(spark):
    rules = [("man hunt", "Minecraft Manhunt"), ("manhunt", "MANHUNT"), ("minecraft manhunt", "done"), ("b", "c"), ("a", "b"), ("ac", "no"),
             ("x", ""), ("yz", "joined"), ("q.", "q"), ("qr", "late border")]
    got = both_ways(spark, ["a man hunt", "a b a", "yxz y x z", "q.r", "xx x"], rules)
    assert got[0] == "b done" and got[1] == "b c b"


def test_rules_in_several_passes(spark):
    r = random.Random(8)
    rules = [(f"w{r.randrange(40)}", f"w{r.randrange(40)}") for _ in range(200)]
    texts = [" ".join(f"W{r.randrange(40)}" for _ in range(30)) for _ in range(40)]
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(rules)], RULES)
    parts = list(rewrite.rule_parts(table, 3000))
    assert len(parts) > 5 and [x for p in parts for x in p] == rules
    both_ways(spark, texts, rules, max_bytes=3000)
    assert list(rewrite.rule_parts(table.where("false"), 3000)) == []


def test_a_hundred_thousand_rules(spark):
    rules = spark.range(100_000).selectExpr("cast(id as int) as ord", "concat('t', id) as term", "concat('t', id + 50000, ' r') as replacement")
    df = spark.createDataFrame([(0, "t7 and T49999"), (1, "t60000"), (2, "nothing")], "id int, text string")
    assert dict(rows(rewrite.apply_rules(df, rules))) == {0: "t100007 r r and t149999 r r", 1: "t110000 r", 2: "nothing"}


# ---- utterances of a stream ---------------------------------------------------------------------------------------------


def word_rows(seed, n=400):
    r = random.Random(seed)
    out = []
    for rec in range(3):
        at = 0
        for _ in range(n):
            at += r.choice([50, 80, 3000, 3001, 9000] if r.random() < 0.1 else [50, 80])
            end = at + r.randrange(20, 400)
            out.append((rec, at, end))
            at = end
    return out


def batch_utterances(spark, words):
    df = spark.createDataFrame(words, "rec_id bigint, start_ms bigint, end_ms bigint")
    from pyspark.sql import Window

    df = df.withColumn("word_idx", F.row_number().over(Window.partitionBy("rec_id").orderBy("start_ms")) - 1)
    df = segment.split_by_gap(df.withColumn("word", F.lit("w")))
    name = next(c for c in df.columns if "utt" in c)
    return sorted(rows(df.groupBy("rec_id", name).agg(F.min("start_ms"), F.max("end_ms"), F.count("*")).drop(name)))


def put_words(spark, words, path):
    spark.createDataFrame(words, "rec_id bigint, start_ms bigint, end_ms bigint").coalesce(1).write.parquet(path)


def test_stream_equals_batch_over_restarts_and_disorder(spark, tmp_path):
    words = word_rows(1)
    top = max(w[1] for w in words)
    lateness = top // 5
    r = random.Random(2)
    arrival = [min(4, w[1] * 5 // (top + 1) + (r.random() < 0.2)) for w in words]
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    seen = []
    for k in range(5):
        mine = [w for w, a in zip(words, arrival, strict=True) if a == k]
        r.shuffle(mine)
        put_words(spark, mine, f"{source}/{k}")
        got = sessions.run_utterances(spark, source, out, check, lateness_ms=lateness)
        assert got == {"rows": len(mine), "late": 0}
        seen.append(len(spark.read.parquet(out).collect()))
    put_words(spark, [(-1, top + lateness + 10**8, top + lateness + 10**8)], f"{source}/end")
    sessions.run_utterances(spark, source, out, check, lateness_ms=lateness)
    want = batch_utterances(spark, words)
    assert sorted(rows(spark.read.parquet(out))) == want
    assert 0 < seen[2] < seen[4] < len(want)  # utterances come out as the watermark passes them
    assert sessions.run_utterances(spark, source, out, check, lateness_ms=lateness) == {"rows": 0, "late": 0}
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_late_words_are_dropped_and_counted(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    put_words(spark, [(1, 0, 100), (1, 50_000, 50_100), (2, 49_000, 49_500)], f"{source}/0")
    sessions.run_utterances(spark, source, out, check, lateness_ms=10_000)
    put_words(spark, [(1, 40_000, 40_200), (1, 40_001, 40_300), (1, 150, 200), (1, 46_000, 46_100), (2, 52_500, 52_600)], f"{source}/1")
    got = sessions.run_utterances(spark, source, out, check, lateness_ms=10_000)
    assert got == {"rows": 5, "late": 2}  # the watermark stands at 40,000
    put_words(spark, [(-1, 10**9, 10**9)], f"{source}/2")
    sessions.run_utterances(spark, source, out, check, lateness_ms=10_000)
    assert sorted(rows(spark.read.parquet(out))) == [
        (1, 0, 100, 1), (1, 40_001, 40_300, 1), (1, 46_000, 46_100, 1), (1, 50_000, 50_100, 1), (2, 49_000, 52_600, 2)]


def test_merged_spans():
    assert sessions.merge_spans([], 5) == []
    assert sessions.merge_spans([(10, 12, 1), (0, 5, 1), (17, 18, 1), (24, 25, 2)], 5) == [(0, 18, 3), (24, 25, 2)]


# ---- readers in ranges ----------------------------------------------------------------------------------------------------

SRT = (
    "﻿1\n00:00:01,000 --> 00:00:02,500\nHello\nBonjour é 日本\n\n2\n00:00:02,000 --> 00:00:03,000\nTwo\n\nsecond part\n\n\nthird\n\n"
    "00:00:04,000 --> 00:00:05,000\nno number\n \t\n\n\n7\n0:00:05.5 --> 0:00:06\r\ncrlf\r\nlines\r\n\r\n8\r\n00:00:07,000 --> 00:00:08,000\r\n"
    "more\r\n\r\njunk without times\n\n12\n13\n00:00:09,000 --> 00:00:10,000\nafter two numbers\n\n\n"
)


def whole(spark, text):
    from captionloom.sources.read import srt_pieces

    df = spark.createDataFrame([(text,)], "t string")
    return [r[0] for r in df.select(F.explode(srt_pieces(F.col("t")))).collect()]


def tidy(data: bytes) -> str:
    return data.decode().replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n")


@pytest.mark.parametrize("text", [SRT, "\n\n" + SRT, SRT.rstrip(), SRT * 3, "no cues at all\n\n\n", "", "\n", "1\r00:00:01,000 --> 00:00:02,000\rold\r\r2\r00:00:03,000 --> 00:00:04,000\rmac\r"])
def test_every_cut_position_gives_the_same_cues(spark, text):
    want = [w for w in whole(spark, text) if w.strip(" \t\n\x0b\x0c\r")]
    data = text.encode()
    for step in (1, 7, 64, 1 << 20):
        for cut in range(0, len(data) + 1, 1 if len(data) < 700 and step > 1 else 13):
            edges = [0, cut, len(data)] if cut else [0, len(data)]
            got = [x for lo, hi in zip(edges, edges[1:]) for x in ranges.cues_of_range(io.BytesIO(data), lo, max(hi, lo), step)]
            texts = [t for t in (tidy(b) for _, b in got) if t.strip(" \t\n\x0b\x0c\r")]
            assert texts == want, (step, cut)
            assert all(data[p : p + len(b)] == b for p, b in got)
    for width in (1, 3, 10, 50):
        got = [x for lo in range(0, len(data), width) for x in ranges.cues_of_range(io.BytesIO(data), lo, min(lo + width, len(data)), 16)]
        assert [t for t in (tidy(b) for _, b in got) if t.strip(" \t\n\x0b\x0c\r")] == want, width


def test_srt_files_in_ranges_equal_whole_files(spark, tmp_path):
    for k in range(4):
        with open(f"{tmp_path}/f{k}.srt", "w", encoding="utf-8", newline="") as f:
            f.write(SRT * (k * 5))
    with gzip.open(f"{tmp_path}/z.srt.gz", "wb") as f:
        f.write(SRT.encode() * 3)
    columns = ["cue_idx", "start_ms", "end_ms", "content", "_corrupt"]
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    want = sorted(map(repr, rows(read.read_srt(spark, str(tmp_path), "f*.srt").select(name, *columns))))
    for width in (100, 1000, 1 << 20):
        got = ranges.read_srt_ranges(spark, str(tmp_path), range_bytes=width, step=64)
        assert got.where("error is not null").count() == 0
        assert sorted(map(repr, rows(got.select(name, *columns)))) == want
        if width == 100:
            assert got.rdd.getNumPartitions() > 50
    packed = ranges.read_srt_ranges(spark, str(tmp_path), suffix=".gz", range_bytes=100)
    assert packed.count() == 3 * len(whole(spark, SRT))


def test_many_ranges_share_tasks():
    runs = [(f"f{k}", 0, k % 20000, 4096) for k in range(30000)] + [("long", 0, 1 << 30, 64 << 20), ("whole.gz", 0, 9 << 30, 9 << 30)]
    parts = ranges.dealt(runs)
    got = [(s.file, s.low, s.high) for part in parts for s in part]
    assert got == [(file, lo, min(lo + step, high)) for file, _, high, step in runs for lo in range(0, max(1, high), step)]
    assert len(parts) < 500  # 76,763 ranges
    assert [len(list(p)) for p in ranges.dealt(runs[:100])] == [1] * 100 and ranges.dealt([]) == []


def test_files_that_cannot_be_read_are_rows(spark, tmp_path):
    data = gzip.compress(SRT.encode() * 50)
    with open(f"{tmp_path}/cut.srt.gz", "wb") as f:
        f.write(data[: len(data) // 2])
    got = ranges.read_srt_ranges(spark, f"{tmp_path}", suffix=".gz")
    bad = got.where("error is not null").collect()
    assert len(bad) == 1 and bad[0].path.endswith("cut.srt.gz") and bad[0].start_ms is None
    os.makedirs(f"{tmp_path}/empty")
    assert ranges.read_srt_ranges(spark, f"{tmp_path}/empty").count() == 0


def wav(kind, bits, channels, data, extra=b"", riff=b"RIFF", size=None, before=b""):
    fmt = struct.pack("<HHIIHH", kind, channels, 8000, 8000 * bits // 8 * channels, bits // 8 * channels, bits) + extra
    body = b"WAVE" + before + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0"
    body += b"data" + struct.pack("<I", len(data) if size is None else size) + data + b"\0" * (len(data) % 2)
    return riff + struct.pack("<I", min(len(body), 0xFFFFFFFF)) + body


def test_wav_in_ranges_equals_whole_files(spark, tmp_path):
    x = np.random.default_rng(1).integers(-32768, 32767, 501)
    made = {
        "a8": wav(1, 8, 1, ((x // 256) + 128).astype("u1").tobytes()), "b16": wav(1, 16, 2, x.astype("<i2").tobytes()),
        "c24": wav(1, 24, 3, b"".join(int(v * 256).to_bytes(3, "little", signed=True) for v in x)), "d32": wav(1, 32, 1, (x * 65536).astype("<i4").tobytes()),
        "e32f": wav(3, 32, 2, (x / 32768).astype("<f4").tobytes()), "f64f": wav(3, 64, 1, (x / 32768).astype("<f8").tobytes()),
        "g16x": wav(0xFFFE, 16, 1, x.astype("<i2").tobytes(), struct.pack("<HHI", 22, 16, 0) + b"\x01\x00" + b"\0" * 14),
        "h4": wav(17, 4, 1, b"\0" * 8), "i": b"no sound", "j": b"", "k16": wav(1, 16, 1, x.astype("<i2").tobytes())[:-7],
    }
    for name, data in made.items():
        with open(f"{tmp_path}/{name}.wav", "wb") as f:
            f.write(data)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    columns = [name, "channel", "rate", "idx", F.when(F.col("idx").isNotNull(), F.col("value")).alias("value")]
    want = {}
    for r in read.read_signal(spark, str(tmp_path)).select(*columns).collect():
        want.setdefault(r.file, []).append(repr(tuple(r)))
    for width in (1, 7, 100, 1 << 20):
        if width == 1:
            some = [f for f in made if f in ("b16", "c24", "h4")]
            got = [r for f in some for r in ranges.read_signal_ranges(spark, f"{tmp_path}/{f}.wav", range_bytes=5, step=9).select(*columns).collect()]
        else:
            got = ranges.read_signal_ranges(spark, str(tmp_path), range_bytes=width, step=33).select(*columns).collect()
        have = {}
        for r in got:
            have.setdefault(r.file, []).append(repr(tuple(r)))
        have.pop("j.wav", None)  # a file without a byte: the other reader gives it no row
        for f, each in have.items():
            assert sorted(each) == sorted(want[f]), (width, f)
        assert width == 1 or set(have) == set(want)
    part = ranges.read_signal_ranges(spark, f"{tmp_path}/b16.wav", 10, 20, range_bytes=64)
    assert sorted({r.idx for r in part.collect()}) == list(range(10, 20)) and part.count() == 20


def test_wav_beyond_four_gigabytes(tmp_path):
    """The 64-bit form, with data that is never written: a hole in the file."""
    n = 5 << 30
    ds = b"ds64" + struct.pack("<I", 28) + struct.pack("<QQQI", n + 100, n, n // 2, 0)
    head = wav(1, 16, 1, b"", riff=b"RF64", size=0xFFFFFFFF, before=ds)
    with open(f"{tmp_path}/big.wav", "wb") as f:
        f.write(head)
        f.truncate(len(head) + n)
        f.seek(len(head) + n - 6)
        f.write(struct.pack("<3h", 1, -2, 3))
    reader = ranges.SignalReader({"path": f"{tmp_path}/big.wav", "rangebytes": str(64 << 20)})
    parts = reader.partitions()
    assert len(parts) == 81
    last = [b for b in reader.read(parts[-1])]
    got = [x for b in last for x in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
    assert got[-3:] == [(n // 2 - 3, 1.0), (n // 2 - 2, -2.0), (n // 2 - 1, 3.0)]


# ---- whole files ------------------------------------------------------------------------------------------------------------

CUES = "rec_id bigint, chunk_id int, cue_idx bigint, start_ms bigint, end_ms bigint, content string"


def listed(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_one_valid_file_per_recording(spark, tmp_path):
    data = [(r, k // 10, k % 10, 1000 * k, 1000 * k + 900, f'li"ne {r} {k}\nzwei') for r in range(5) for k in range(40)]
    cues = spark.createDataFrame(data, CUES).repartition(7)
    for fmt in ("srt", "txt", "vtt", "ass", "json"):
        files.write_files(cues, f"{tmp_path}/{fmt}", F.format_string("p%d/rec%d." + fmt, F.col("rec_id") % 2, "rec_id"), fmt)
        assert listed(f"{tmp_path}/{fmt}") == sorted(f"p{r % 2}/rec{r}.{fmt}" for r in range(5))
    for r in range(5):
        texts = {fmt: open(f"{tmp_path}/{fmt}/p{r % 2}/rec{r}.{fmt}", encoding="utf-8").read() for fmt in ("srt", "txt", "vtt", "ass", "json")}
        got = json.loads(texts["json"])
        assert [g["index"] for g in got] == list(range(1, 41)) and got[3]["content"] == f'li"ne {r} 3\nzwei'
        blocks = texts["srt"].strip().split("\n\n")
        assert [int(b.split("\n")[0]) for b in blocks] == list(range(1, 41))
        assert texts["vtt"].startswith("WEBVTT\n\n00:00:00.000 --> ") and texts["vtt"].count("-->") == 40
        assert texts["ass"].startswith("[Script Info]") and texts["ass"].count("\nDialogue:") == 40
        assert texts["txt"].count("[0:00:") == 40
    back = ranges.read_srt_ranges(spark, f"{tmp_path}/srt", range_bytes=200)
    assert back.count() == 200 and back.where("_corrupt is not null").count() == 0


def test_files_are_replaced_only_as_a_whole(spark, tmp_path):
    one = spark.createDataFrame([(1, 0, 0, 0, 10, "old"), (2, 0, 0, 0, 10, "other")], CUES)
    name = F.concat(F.lit("rec"), "rec_id", F.lit(".srt"))
    out = f"{tmp_path}/out"
    files.write_files(one, out, name)
    files.write_files(one.where("rec_id = 1").withColumn("content", F.lit("new")), out, name)
    assert listed(out) == ["rec1.srt", "rec2.srt"] and "new" in open(f"{out}/rec1.srt").read()
    # a task that fails half-way leaves every file as it was and nothing beside them
    broken = F.pandas_udf(lambda s: s.map(lambda x: 1 // (x - 700) and "x"), "string")
    many = spark.range(1000).select(F.col("id").alias("rec_id"), F.lit(0).alias("chunk_id"), F.lit(0).cast("bigint").alias("cue_idx"),
                                    F.lit(0).cast("bigint").alias("start_ms"), F.lit(5).cast("bigint").alias("end_ms"), broken("id").alias("content"))
    with pytest.raises(Exception):
        files.write_files(many, out, name)
    assert listed(out) == ["rec1.srt", "rec2.srt"] and "new" in open(f"{out}/rec1.srt").read()


def test_files_of_attempts_that_were_not_reported_go(tmp_path):
    import pyarrow as pa

    batch = lambda *r: iter([pa.RecordBatch.from_pylist([{"file": f, "block": b} for f, b in r])])
    writer = files.FileWriter(f"{tmp_path}/x", "json")
    writer.write(batch(("a", "0")))  # an attempt that was lost after it had written
    kept = writer.write(batch(("a", "1"), ("a", "2"), ("b", "3")))
    writer.commit([kept, None, files.Written([])])
    assert listed(f"{tmp_path}/x") == ["a", "b"]
    assert open(f"{tmp_path}/x/a").read() == "[\n1,\n2\n]"
    with pytest.raises(ValueError):
        writer.commit([writer.write(batch(("a", "1"))), writer.write(batch(("a", "1")))])
    assert listed(f"{tmp_path}/x") == ["a", "b"] and open(f"{tmp_path}/x/a").read() == "[\n1,\n2\n]"
    with pytest.raises(ValueError):
        writer.write(batch(("a", "1"), ("b", "1"), ("a", "1")))


def test_session_settings_stay(spark, tmp_path):
    from captionloom.sources import write

    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    write.write_chunks(spark.createDataFrame([(1, 0, 0, 0, 10, "x")], CUES), f"{tmp_path}/c")
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))
