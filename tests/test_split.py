"""Splitters against straightforward loops over regular expression matches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from captionloom.operators import segment, split

MAX = 40
WORDS = "and the cat but in if because house so then you know I mean at the to it would go, red; blue: stop. what? wow! like at or on one".split()


def _texts():
    rnd = random.Random(2)
    out = ["", "short", "a" * 60, "a" * 30 + " " + "b" * 60 + " c", "éa, àb, çc dd ee ff gg hh ii jj kk ll mm, nn oo pp"]
    for _ in range(150):
        out.append(" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(3, 40))))
    return out


TEXTS = _texts()


def run(spark, fn):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, x string")
    return {r[0]: r[1] for r in df.select("i", fn(F.col("x"))).collect()}


def pieces(text, cuts):
    edges = [0, *cuts, len(text)]
    return [p for p in (text[a:b].strip() for a, b in zip(edges, edges[1:])) if p]


def balanced(text, limit):
    cuts, cur = [], 0
    marks = [m.start() for m in re.finditer(split.BALANCED, text, re.I)]
    while True:
        rated = []
        for p in marks:
            left, right = text[cur:p].strip(), text[p:].strip()
            if p > cur and left and len(left) <= limit:
                bad = abs(len(left) - (len(left) + len(right)) // 2)
                rated.append((bad + 50 * (min(len(left), len(right)) < 15) + 100 * (len(right) > limit), p))
        if not rated:
            break
        cur = min(rated)[1]
        cuts.append(cur)
        if len(text) - cur <= limit:
            break
    return pieces(text, cuts) or [text]


def midpoint(text, pattern, limit, low):
    ok = []
    for m in re.finditer(pattern, text, re.I):
        sides = [text[:m.end()].strip(), text[m.end():].strip()]
        if all(low <= len(s) <= limit for s in sides):
            ok.append((abs(m.end() - len(text) // 2), m.end(), sides))
    return min(ok)[2] if ok else [text]


def safe(text, limit):
    spans = [m.span() for p in split.PROTECTED for m in re.finditer(p, text, re.I)]
    for p in split.SAFE:
        for m in re.finditer(p, text, re.I):
            sides = [text[:m.end()].strip(), text[m.end():].strip()]
            if all(15 <= len(s) <= limit for s in sides) and not any(a <= m.end() <= b for a, b in spans):
                return sides
    return [text]


def before(text, pattern, limit):
    cuts, cur = [], 0
    for m in re.finditer(pattern, text, re.I):
        if 20 <= len(text[cur:m.start()].strip()) <= limit and len(text[m.start():].strip()) > 20:
            cur = m.start()
            cuts.append(cur)
    return pieces(text, cuts) or [text]


def after(text, limit):
    for p in split.GRAMMAR:
        cuts, cur = [], 0
        for m in re.finditer(p, text, re.I):
            size = len(text[cur:m.end()].strip())
            if size >= 20 and size > limit:
                break
            if size >= 20:
                cur = m.end()
                cuts.append(cur)
        parts = pieces(text, cuts)
        if len(parts) > 1 and all(len(x) <= limit for x in parts):
            return parts
    return [text]


def first(text, tries):
    return next((t for t in tries if len(t) > 1), [text])


def grammar(text, limit):
    tries = [safe(text, limit)] if any(re.search(p, text, re.I) for p in split.PROTECTED) else []
    return first(text, tries + [midpoint(text, p, limit, 15) for p in split.NATURAL] + [midpoint(text, p, limit, 20) for p in split.GRAMMAR])


def commas(text):
    out = []
    for p in re.findall(r"[^,]*,|[^,]+$", text):
        p = p[:-1].strip() + "," if p.endswith(",") else p.strip()
        if p and out and len(out[-1]) < 15:
            out[-1] += " " + p
        elif p:
            out.append(p)
    return out if len(out) > 1 else [text]


def punct(text, limit):
    out, cur = [], ""
    for p in re.findall(r"[^.!?;:]*[.!?;:]|[^.!?;:]+$", text):
        if len(cur + p) <= limit:
            cur += p
        else:
            out, cur = out + [cur.strip()], p
    out = [p for p in [*out, cur.strip()] if p]
    return out if len(out) > 1 else [text]


def pack(text, limit):
    out = []
    for w in text.split():
        if out and len(out[-1]) + 1 + len(w) <= limit:
            out[-1] += " " + w
        else:
            out.append(w)
    return out


CASES = {
    "balanced": (lambda c: split.split_balanced(c, max_chars=MAX), lambda x: balanced(x, MAX)),
    "midpoint": (lambda c: split.split_midpoint(c, split.NATURAL[0], MAX, 15), lambda x: midpoint(x, split.NATURAL[0], MAX, 15)),
    "midpoint_marks": (lambda c: split.split_midpoint(c, split.NATURAL[3], MAX, 15), lambda x: midpoint(x, split.NATURAL[3], MAX, 15)),
    "safe": (lambda c: split.split_safe(c, MAX), lambda x: safe(x, MAX)),
    "grammar": (lambda c: split.split_grammar(c, MAX), lambda x: grammar(x, MAX)),
    "before": (lambda c: split.split_greedy_before(c, max_chars=MAX), lambda x: before(x, split.CONJUNCTIONS, MAX)),
    "after": (lambda c: split.split_greedy_after(c, MAX), lambda x: after(x, MAX)),
    "semantic": (lambda c: split.split_semantic(c, MAX), lambda x: first(x, [before(x, p, MAX) for p in split.SEMANTIC])),
    "commas": (split.split_commas, commas),
    "punct": (lambda c: split.pack_punct(c, MAX), lambda x: punct(x, MAX)),
}


@pytest.mark.parametrize("name", CASES)
def test_splitter_equals_loop(spark, name):
    fn, plain = CASES[name]
    got = run(spark, fn)
    for i, x in enumerate(TEXTS):
        if x:
            assert got[i] == plain(x), x


def test_packing(spark):
    got = run(spark, lambda c: segment.pack_words(c, MAX))
    for i, x in enumerate(TEXTS):
        assert got[i] == pack(x, MAX)


def test_sentence_rules(spark):
    df = spark.createDataFrame([("Hi there.  Go!! now? A.b ok",)], "x string")
    assert df.select(segment.sentences_by_rule(F.col("x"))).first()[0] == ["Hi there.", "Go!!", "now?", "A.b ok"]
    assert df.select(segment.sentences_by_rule_caps(F.col("x"))).first()[0] == ["Hi there.", "Go!! now.", "A.b ok."]


@pytest.mark.parametrize("profile", ["plain", "a", "b", "c", "d"])
def test_profiles_keep_all_words_and_the_length(spark, profile):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS) if x], "i int, text string")
    parts = split.enforce_length(df, max_chars=MAX, profile=profile)
    got = {}
    for i, _, part in parts.select("i", "part_idx", "part").orderBy("i", "part_idx").collect():
        got.setdefault(i, []).append(part)
    for i, x in enumerate(TEXTS):
        if x:
            assert "".join(got[i]).replace(" ", "") == x.replace(" ", "")
            assert all(len(p) <= MAX or " " not in p for p in got[i])


def test_word_position_cuts(spark):
    toks = "aaaa bbbb cccc dddd eeee ffff gggg hhhh".split()
    df = spark.createDataFrame([(toks, [2, 4], [4]), (toks, [], [1])], "t array<string>, b array<int>, m array<int>")
    plain = [r[0] for r in df.select(split.split_at_bounds(F.col("t"), F.col("b"), 30, 15)).collect()]
    assert plain == [["aaaa bbbb cccc dddd", "eeee ffff gggg hhhh"], [" ".join(toks)]]
    merged = [r[0] for r in df.select(split.split_at_bounds_merging(F.col("t"), F.col("m"), 34, 15)).collect()]
    assert merged == [["aaaa bbbb cccc dddd", "eeee ffff gggg hhhh"], [" ".join(toks)]]


def test_pauses_inside_a_sentence(spark):
    ws = [("hello", 0, 100), ("my", 2000, 2100), ("friends", 2200, 2300), ("goodbye", 5000, 5100), ("everybody", 5150, 5200)]
    df = spark.createDataFrame([([dict(word=w, start_ms=s, end_ms=e) for w, s, e in ws],)], "ws array<struct<word:string,start_ms:bigint,end_ms:bigint>>")
    assert df.select(split.split_by_pauses(F.col("ws"))).first()[0] == ["hello my friends", "goodbye everybody"]
    assert df.select(split.split_by_pauses(F.col("ws"), compat=True)).first()[0] == ["my friends", "goodbye everybody"]


def test_recognizer_bounds_come_after_commas(spark):
    words = [f"word{k:02d}x" for k in range(24)]  # 8 characters with the blank
    whole = " ".join(words)
    comma = " ".join(words[:9]) + ", " + " ".join(words[9:])
    odd = " ".join(words[:3]) + " because " + " ".join(words[3:14])
    rows_ = [(0, whole, [8, 16]), (1, whole, []), (2, whole, None), (3, comma, [12, 16]), (4, odd, [6]), (5, whole, [23])]
    df = spark.createDataFrame(rows_, "i int, text string, b array<int>")
    got = {}
    for r in split.enforce_length(df, "text", 80, "a", bounds=F.col("b")).orderBy("i", "part_idx").collect():
        got.setdefault(r.i, []).append(r.part.split())
    plain = {}
    for r in split.enforce_length(df.drop("b"), "text", 80, "a").orderBy("i", "part_idx").collect():
        plain.setdefault(r.i, []).append(r.part.split())
    assert got[0] == [words[:8], words[8:16], words[16:]]
    assert got[1] == plain[1] and got[2] == plain[2] and got[5] == plain[5]
    # the second part of the comma cut is cut at the boundary after its third word, and at the next one
    assert [x for p in got[3] for x in p] == comma.split() and got[3][0] == comma.split()[:9]
    assert [len(p) for p in got[3]] == [9, 7, 8] or [len(p) for p in got[3]] == [9, 3, 4, 8]
    assert got[4][0] == odd.split()[:6] and "".join(map("".join, got[4])) == odd.replace(" ", "")


def test_captions_use_segment_borders(spark):
    said = [f"word{k:02d}x" for k in range(20)]
    w = spark.createDataFrame([(1, 0, k // 7, k, x, 100 * k, 100 * k + 90) for k, x in enumerate(said)],
                              "rec_id bigint, chunk_id int, seg_idx bigint, word_idx bigint, word string, start_ms bigint, end_ms bigint")
    from captionloom.operators import segment
    from captionloom.plans import pipelines

    segs = segment.segment_bounds(w).join(segment.rebuild_text(w), ["rec_id", "chunk_id", "seg_idx"])
    out = pipelines.captions(w, segs).orderBy("sent_idx").collect()
    assert [r.text.split() for r in out] == [said[:7], said[7:14], said[14:]]
    assert [(r.start_ms, r.end_ms) for r in out] == [(0, 690), (700, 1390), (1400, 1990)]


def test_repeated_words_in_long_texts(spark):
    """The search for a repeated word stays within the reach of the first cut; it took minutes over these texts."""
    word = lambda k: "".join(chr(98 + int(d)) for d in f"{k:06d}")
    far = " ".join(word(k) for k in range(6000))  # no word comes twice
    late = far + " xq yy zz xq " + word(9)
    first = "one two three four five xq six seven eight xq nine ten eleven twelve"
    texts = [far, late, first, first.replace(" ", "\u00a0 \t"), "Ünder a b c d e f g h i ÜNDER rest of this text goes on", "a a", "x. a b c. a b c", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    # 6,000 words tried against all of the rest would be 10^9 steps a text
    got = {r.i: r.p for r in df.select("i", split.split_semantic(F.col("text"), MAX).alias("p")).collect()}
    assert got[0] == [far] and got[1] == [late]
    small = [(i, x) for i, x in enumerate(texts) if len(x) < 1000]
    old = spark.createDataFrame(small, "i int, text string").select("i", split._first_split(
        lambda x: [split.split_greedy_before(x, p, MAX) for p in split.SEMANTIC], F.col("text")).alias("p")).collect()
    assert {r.i: r.p for r in old} == {i: got[i] for i, _ in small} and len(got[2]) > 1
