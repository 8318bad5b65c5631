"""Steps that must do their work once, in bounded pieces and without a task's start for every group."""

from pyspark.sql import functions as F

from captionloom.functions import models
from captionloom.functions.text import clean_word, explode_parts, lower_hyphen_word, lower_plain_word, norm_align, norm_clean
from captionloom.operators import align, rewrite, split
from captionloom.plans import pipelines


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_are_made_once(spark, tmp_path):
    spark.createDataFrame([(1, "a;b"), (2, ""), (3, None)], "id long, text string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    out = explode_parts(df, F.filter(F.split("text", ";"), lambda p: p != ""), "i", "p", ["id"])
    assert sorted(map(tuple, out.collect())) == [(1, 0, "a"), (1, 1, "b")]
    assert _plan(out).count("split(") == 1
    cut = _plan(split.enforce_length(df, profile="b"))
    assert "Filter" not in cut or not any("aggregate(" in line for line in cut.split("\n") if "Filter" in line)


def test_chunks_share_a_worker_and_null_keys_are_one_chunk(spark):
    words = [(r, 0, i, w, 100 * i, 100 * i + 50) for r in (1, 2, None) for i, w in enumerate(f"a{r} b c d".split())]
    sents = [(r, 0, 0, f"a{r} b") for r in (1, 2, 3, None)]
    ws = spark.createDataFrame(words, "rec_id long, chunk_id int, word_idx long, word string, start_ms long, end_ms long")
    ss = spark.createDataFrame(sents, "rec_id long, chunk_id int, sent_idx long, text string")
    out = align.align_monotonic(ss, ws)
    assert "CoGroup" not in _plan(out)
    got = {r["rec_id"]: (r["start_ms"], r["end_ms"], r["confidence"], r["n_tokens"]) for r in out.collect()}
    assert got == {1: (0, 150, 1.0, 2), 2: (0, 150, 1.0, 2), None: (0, 150, 1.0, 2)}


def test_a_chunk_may_run_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        words = [(r, 0, i, f"w{i}", i, i + 1) for r in range(3) for i in range(10)]
        ws = spark.createDataFrame(words, "rec_id long, chunk_id int, word_idx long, word string, start_ms long, end_ms long")
        ss = spark.createDataFrame([(r, 0, s, f"w{3 * s} w{3 * s + 1}") for r in range(3) for s in range(3)],
                                   "rec_id long, chunk_id int, sent_idx long, text string")
        got = sorted((r["rec_id"], r["sent_idx"], r["start_word_idx"]) for r in align.align_unused_robust(ss, ws).collect())
        assert got == [(r, s, 3 * s) for r in range(3) for s in range(3)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_windows_need_no_scores_of_the_vocabulary(monkeypatch):
    def never(*_):
        raise AssertionError("scored against the whole vocabulary")

    monkeypatch.setattr(align._Chunk, "_scores", never)
    chunk = align._Chunk("one two three four five six seven eight nine ten".split())
    sents = ["three four five".split(), "six sevem eight nine".split()]
    # 3.6 of 4 tokens: sevem is like seven
    assert list(align._unused_robust(chunk, sents)) == [(2, 4, 1.0), (5, 8, 0.9)]


def test_a_model_gets_bounded_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "MODEL_BYTES", 1000)
    run = models.model_column(lambda: lambda texts: [str(len(texts))] * len(texts), "string")
    df = spark.createDataFrame([(i, "x" * 100) for i in range(40)] + [(40, None), (41, "x" * 5000)], "id int, text string").coalesce(1)
    got = [int(r[0]) for r in df.select(run("text")).collect()]
    assert len(got) == 42 and max(got) <= 1000 // 164 and got[-1] == 1


def test_a_character_is_classified_once(monkeypatch):
    asked = []
    monkeypatch.setattr(rewrite, "is_word", lambda c: asked.append(c) or c.isalnum())
    assert rewrite.Rewriter([("he", "she"), ("and", "&")])("the other and he " * 50) == "the other & she " * 50
    assert len(asked) == len(set(asked))


def test_plain_words_have_the_same_forms(spark):
    df = spark.createDataFrame([("Abc9",), ("abc\n",), ("Don't",), ("",), (None,), ("É",)], "w string")
    forms = [f(F.col("w")) for f in (norm_align, norm_clean, clean_word, lower_hyphen_word, lower_plain_word)]
    assert [tuple(r) for r in df.select(*forms).collect()] == [
        ("abc9", "abc9", "Abc9", "abc9", "abc9"), ("abc", "abc", "abc", "abc", "abc"),
        ("don t", "dont", "Don't", "don't", "don't"), ("",) * 5, (None,) * 5, ("é", "é", "É", "é", "é")]


def test_answers_are_parsed_once(spark, monkeypatch):
    stored = []
    real = pipelines.materialize
    monkeypatch.setattr(pipelines, "materialize", lambda df, label: stored.append(label) or real(df, label))
    cues = spark.createDataFrame([(1, 0, i, 1000 * i, 1000 * i + 900, f"c{i}") for i in range(7)],
                                 "rec_id long, chunk_id int, cue_idx long, start_ms long, end_ms long, content string")
    head, tail = pipelines.REQUEST
    out = pipelines.translate_batches(cues, lambda p: p.removeprefix(head).removesuffix(tail), 3)
    assert stored.count("parsed") == 1 and "regexp_replace" not in "".join(line for line in _plan(out).split("\n") if "posexplode" in line)
    assert "posexplode" not in _plan(out)
    assert sorted((r["cue_idx"], r["content"]) for r in out.collect()) == [(i + 1, f"c{i}\nc{i}") for i in range(7)]
