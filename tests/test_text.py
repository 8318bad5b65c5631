"""Hand-written cases of the text rules."""

import pytest
from pyspark.sql import functions as F

from captionloom.functions import captions as cp
from captionloom.functions import text as tx
from captionloom.functions.models import BOUNDS, checked, model_column
from captionloom.operators import lookup


def one(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_word_forms(spark):
    assert one(spark, tx.norm_align, "Don't!", "'tis", "a'b'c", "—Été—", "rock’n", "...") == ["don t", "tis", "a b c", "été", "rock n", ""]
    assert one(spark, tx.norm_clean, "Don't!", "'Tis'", "well-known") == ["dont", "tis", "wellknown"]
    assert one(spark, tx.norm_text, " Don't  stop, it's—ok ") == ["don t stop it s ok"]
    assert one(spark, tx.clean_case, "“Hi”,  it's well-known!\n OK") == ["Hi it's well-known OK"]
    assert one(spark, tx.lower_hyphen_word, "Re-do,") == ["re-do"]
    assert one(spark, tx.lower_plain_word, "Re-do, I'm") == ["redo i'm"]


def test_white_space_is_unicode(spark):
    assert one(spark, tx.collapse, " a  b\t\nc　") == ["a b c"]


def test_marks(spark):
    assert one(spark, tx.finalize, " a, ", "a..", "好。", "a") == ["a", "a.", "好", "a"]
    assert one(spark, tx.punctuate_rule, "hello", "Hi?", "  ", "élan!") == ["Hello.", "Hi?", "", "Élan!"]
    df = spark.createDataFrame([(["we", "go", "now", "ok"], [0, 2, 10]), (["a", "b"], []), (["a"], [12])], "t array<string>, l array<int>")
    got = [r[0] for r in df.select(tx.punctuate_labels(F.col("t"), F.col("l"))).collect()]
    assert got == ["We go, now... ok", "A b.", "A"]
    df = spark.createDataFrame([("a, b.", 4), ("a, b, c.", 4), ("a", 0), (" ", 3), ("a, b, c", 12)], "x string, n int")
    assert [r[0] for r in df.select(tx.punct_plausible(F.col("x"), F.col("n"))).collect()] == [False, False, False, False, True]


def test_predicates(spark):
    assert one(spark, tx.has_protected, "go IN THE house", "tea or milk", "within the", "plain") == [True, True, False, False]
    assert one(spark, tx.translatable, "...", "é", " ", "_") == [False, True, False, True]


def test_responses(spark):
    fenced = "x\n```srt\n1\n00:00:01,000 --> 00:00:02,000\nhi\n```\ny"
    assert one(spark, tx.extract_code_block, fenced, "```\n1\nb```", " plain ") == ["1\n00:00:01,000 --> 00:00:02,000\nhi", "1\nb", "plain"]
    assert one(spark, tx.clean_srt_text, "Sure!\n\n1\n 00:00:01 --> 00:00:02 \n hi \n\n", "nothing") == ["1\n00:00:01 --> 00:00:02\nhi\n\n", ""]


def test_caption_columns(spark):
    assert one(spark, lambda c: cp.select_lang(c, "en"), "a\nb\nc", "a") == ["a", "a"]
    assert one(spark, lambda c: cp.select_lang(c, "zh"), "a\nb\nc", "a") == ["b\nc", "a"]
    df = spark.createDataFrame([(3723004,), (59996,), (90000000,)], "ms bigint")
    got = df.select(cp.srt_time(F.col("ms")), cp.vtt_time(F.col("ms")), cp.clock_time(F.col("ms")), cp.ass_time(F.col("ms"))).collect()
    assert tuple(got[0]) == ("01:02:03,004", "01:02:03.004", "1:02:03.004000", "1:02:03.00")
    assert tuple(got[1]) == ("00:00:59,996", "00:00:59.996", "0:00:59.996000", "0:01:00.00")
    assert got[2][2] == "1 day, 1:00:00"
    assert one(spark, cp.srt_stamp_to_ms, "01:02:03,004", "1:2:3.5", "0:0:1", "x") == [3723004, 3723500, 1000, None]


def test_glossary_rules_chain_in_order(spark):
    df = spark.createDataFrame([("The cat and the hat; other",), ("été that",), ("cost 5",)], "text string")
    rules = spark.createDataFrame([(0, "and the", "& the"), (1, "the", "le"), (2, "le hat", "$1\\x"), (3, "cost", "prix")], "ord int, term string, replacement string")
    want = ["le cat & $1\\x; other", "été that", "prix 5"]
    assert [r[0] for r in lookup.apply_glossary(df, rules).collect()] == want
    # slices of two rules, stored in between
    assert sorted(r[0] for r in lookup.apply_glossary(df, rules, slice_size=2).collect()) == sorted(want)
    many = spark.createDataFrame([(i, f"zz{i}", "q") for i in range(60)], "ord int, term string, replacement string").unionByName(
        rules.withColumn("ord", F.col("ord") + 100))
    assert [r[0] for r in lookup.apply_glossary(df, many).collect()] == want


def test_pretranslate_asks_once_per_text(spark):
    df = spark.createDataFrame([("hi",), ("hi",), ("yo",), ("...",)], "text string")
    known = spark.createDataFrame([("yo", "YO!")], "term string, replacement string")
    asked = model_column(lambda: (lambda xs: [f"<{x}>" for x in xs]), "string")
    out = lookup.pretranslate(df, known, translator=asked)
    assert sorted(map(tuple, out.collect())) == [("...", "..."), ("hi", "<hi>"), ("hi", "<hi>"), ("yo", "YO!")]


def test_glossary_has_one_way_for_any_number_of_rules(spark):
    df = spark.createDataFrame([("in İstanbul now, 5 µm wide, the Straße",), ("kelvin Kelvin ſo",)], "text string")
    rules = [(k, f"term{k}", f"<{k}>") for k in range(450)]
    odd = [(1000, "istanbul", "X"), (1001, "μm", "Y"), (1002, "kelvin", "K"), (1003, "so", "S")]
    one = lookup.apply_glossary(df, spark.createDataFrame(odd, "ord int, term string, replacement string")).collect()
    for n in (20, 21, 200, 450):
        many = spark.createDataFrame(rules[:n] + odd + odd, "ord int, term string, replacement string")
        assert lookup.apply_glossary(df, many).collect() == one
        assert sorted(lookup.apply_glossary(df, many, slice_size=7).collect()) == sorted(one)
    hit = spark.createDataFrame([(" ".join(f"Term{k}" for k in range(450)),)], "text string")
    got = lookup.apply_glossary(hit, spark.createDataFrame(rules, "ord int, term string, replacement string")).first()[0]
    assert got == " ".join(f"<{k}>" for k in range(450))


def test_glossary_slices_lose_no_rule(spark):
    df = spark.createDataFrame([("a b",)], "text string")
    rules = spark.createDataFrame([(0, "a", "b"), (0, "a", "c"), (0, "b", "d")], "ord int, term string, replacement string")
    assert {lookup.apply_glossary(df, rules, slice_size=n).first()[0] for n in (1, 2, 3, 10)} == {"d d"}


def test_repeated_dictionary_terms_and_cache_keys(spark):
    df = spark.createDataFrame([("hi",), ("yo",)], "text string")
    known = spark.createDataFrame([(0, "hi", "1"), (2, "hi", "3"), (1, "hi", "2")], "ord int, term string, replacement string")
    assert sorted(map(tuple, lookup.pretranslate(df, known).collect())) == [("hi", "3"), ("yo", "yo")]
    cache = df.selectExpr("text as key", "explode(array('new', 'old')) as value").withColumn(
        "modified", F.expr("timestamp '2024-01-10 00:00:00' - if(value = 'old', interval 1 day, interval 0 day)"))
    hits, misses = lookup.cached_lookup(df.withColumnRenamed("text", "key"), cache, F.lit("2024-01-11 00:00:00").cast("timestamp"))
    assert sorted(map(tuple, hits.collect())) == [("hi", "new"), ("yo", "new")] and misses.count() == 0


def test_bounds():
    assert checked(80, *BOUNDS["max_chars"], "max_chars") == 80
    with pytest.raises(ValueError):
        checked(5, *BOUNDS["max_chars"], "max_chars")
