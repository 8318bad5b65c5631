"""The pause-aware cascade cuts long sentences at recognizer boundaries before it looks at grammar."""

from pyspark.sql import functions as F

from captionloom.operators import split
from captionloom.plans import pipelines

WORDS = "rec_id bigint, chunk_id int, seg_idx bigint, word_idx bigint, word string, start_ms bigint, end_ms bigint"


def spoken(spark, segments, pause=50):
    rows, at, k = [], 0, 0
    for s, text in enumerate(segments):
        for w in text.split():
            rows.append((1, 0, s, k, w, at, at + 200))
            at, k = at + 200 + pause, k + 1
    return spark.createDataFrame(rows, WORDS)


def captions(words):
    return [r["text"] for r in pipelines.pause_captions(words).orderBy("sent_idx").collect()]


LONG = ["we walked along the river for hours", "and nobody said a single word until", "the old lighthouse came into view at last"]


def test_long_sentences_are_cut_where_the_recognizer_cut(spark):
    assert captions(spoken(spark, LONG)) == LONG[:2] + [LONG[2] + "."]
    # without the recognizer's segments grammar decides
    other = captions(spoken(spark, LONG).drop("seg_idx"))
    assert other != LONG[:2] + [LONG[2] + "."] and " ".join(other).rstrip(".") == " ".join(LONG)


def test_short_segments_join_the_one_before(spark):
    parts = ["we walked along the river for hours and hours", "then", "nobody said a single word until the lighthouse came into view"]
    assert captions(spoken(spark, parts)) == [f"{parts[0]} then", parts[2] + "."]


def test_pauses_come_first_and_fitting_sentences_stay(spark):
    words = spoken(spark, LONG).withColumn("start_ms", F.expr("start_ms + if(word_idx >= 10, 2000, 0)")).withColumn("end_ms", F.expr("end_ms + if(word_idx >= 10, 2000, 0)"))
    text = " ".join(LONG).split()
    assert captions(words) == [" ".join(text[:10]), " ".join(text[10:])]
    assert captions(spoken(spark, ["a short one", "in two segments"])) == ["a short one in two segments."]


def test_profile_b_with_bounds_keeps_every_word(spark):
    df = spark.createDataFrame([(" ".join(LONG), [7, 14]), (" ".join(LONG), []), (" ".join(LONG), None), ("x " * 100, [50]), ("short", [])], "text string, b array<int>")
    out = split.enforce_length(df.withColumn("id", F.monotonically_increasing_id()), profile="b", bounds=F.col("b"))
    for r in out.groupBy("id", "text").agg(F.array_sort(F.collect_list(F.struct("part_idx", "part"))).alias("p")).collect():
        parts = [p["part"] for p in r["p"]]
        assert " ".join(parts).split() == r["text"].split() and all(len(p) <= 80 for p in parts)
    first = out.where("size(b) = 2").orderBy("part_idx").collect()
    assert [r["part"] for r in first] == LONG
