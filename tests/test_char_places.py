"""Every sentence has its own place in the chunk, or is marked as without one."""

from captionloom.operators import align
from captionloom.plans import pipelines


def frames(spark, spoken, texts):
    words = [(1, 0, i, w, 100 * i, 100 * i + 90) for i, w in enumerate(spoken)]
    words = spark.createDataFrame(words, "rec_id bigint, chunk_id bigint, word_idx bigint, word string, start_ms bigint, end_ms bigint")
    sents = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(texts)], "rec_id bigint, chunk_id bigint, sent_idx bigint, text string")
    return sents, words


def test_repeats_borders_tokens_and_unmatched(spark):
    spoken = ["heart", "Yes.", "art", "Yes.", "one", "two", "New York", "four", "five", "Yes."]
    texts = ["art", "Yes.", "Yes!", "one two New York fuor five", "Yes", "Yes", "nowhere", "..."]
    got = {r["sent_idx"]: r for r in align.char_places(*frames(spark, spoken, texts)).collect()}
    want = [(2, 2), (1, 1), (3, 3), (4, 8), (9, 9), (-1, -1), (-1, -1), (-1, -1)]
    assert [(got[i]["start_word_idx"], got[i]["end_word_idx"]) for i in range(8)] == want
    assert (got[3]["start_ms"], got[3]["end_ms"], got[6]["start_ms"]) == (400, 890, None)


def test_char_captions_keep_every_sentence_at_its_own_time(spark):
    _, words = frames(spark, ["Yes.", "Come", "in.", "Yes.", "Come", "in."], [])
    got = pipelines.char_captions(words).orderBy("sent_idx").collect()
    spans = [(r["start_ms"], r["end_ms"]) for r in got]
    assert len(set(spans)) == len(spans) > 2 and spans == sorted(spans)
