"""Aligners against window scans written as plain loops."""

import random

from helpers import rows
from pyspark.sql import functions as F

from captionloom.operators import align, quality, timing

VOCAB = "red green blue the a it's Walk walked talking talk up. down, on".split()


def _chunks(seed=4, n=12):
    rnd = random.Random(seed)
    words, sents = [], []
    for c in range(n):
        ws = [rnd.choice(VOCAB) for _ in range(rnd.randrange(4, 40))]
        words += [(1, c, 100 * c + i, w, 50 * i, 50 * i + 40) for i, w in enumerate(ws)]
        at, k = 0, 0
        while at < len(ws):
            size = rnd.choice([1, 2, 3, 5, 8])
            part = ws[at:at + size]
            if rnd.random() < 0.5:
                part[rnd.randrange(len(part))] = rnd.choice(["zzz", "walks", "rad", "!!", "the"])
            sents.append((1, c, k, " ".join(part)))
            at, k = at + size, k + 1
    return words, sents


def _frames(spark):
    words, sents = _chunks()
    w = spark.createDataFrame(words, "rec_id bigint, chunk_id int, word_idx bigint, word string, start_ms bigint, end_ms bigint")
    s = spark.createDataFrame(sents, "rec_id bigint, chunk_id int, sent_idx bigint, text string")
    return w, s


def _normal(spark, form):
    """Normal forms by the library's own (separately tested) column functions."""
    w, s = _frames(spark)
    norm, toks = align.FORMS[form]
    ws, ss = {}, {}
    for c, i, t in w.select("chunk_id", "word_idx", norm(F.col("word"))).orderBy("chunk_id", "word_idx").collect():
        ws.setdefault(c, []).append((i, t))
    for c, k, t in s.select("chunk_id", "sent_idx", toks(F.col("text"))).orderBy("chunk_id", "sent_idx").collect():
        ss.setdefault(c, []).append((k, t))
    return ws, ss


def _share(a, b):
    return sum(x == y for x, y in zip(a, b)) / len(b)


def _check(got, want):
    got = {(r["chunk_id"], r["sent_idx"]): (r["start_word_idx"], r["end_word_idx"], round(r["confidence"], 6)) for r in got.collect()}
    assert got == want


def _run(spark, form, rule, drop_empty_words=False):
    ws, ss = _normal(spark, form)
    want = {}
    for c, sents in ss.items():
        seq = [x for x in ws[c] if x[1] or not drop_empty_words]
        ids, toks = [i for i, _ in seq], [t for _, t in seq]
        used = set()
        state = {"cursor": 0}
        for k, sent in sents:
            hit = rule(toks, sent, used, state)
            if hit == "skip":
                continue
            a, b, conf = hit
            want[c, k] = (ids[a], ids[b], round(conf, 6)) if a >= 0 else (-1, -1, 0.0)
    return want


NONE = (-1, -1, 0.0)


def _scan(toks, sent, start, floor):
    for i in range(start, len(toks) - len(sent) + 1):
        share = _share(toks[i:i + len(sent)], sent)
        if share >= floor:
            return i, i + len(sent) - 1, share
    return None


def _mono(toks, sent, used, state):
    if not sent:
        return "skip"
    cur = state["cursor"]
    hit = None
    if cur < len(toks):
        for floor in (1.0, 0.9, 0.85):
            hit = hit or _scan(toks, sent, cur, floor)
    if not hit and len(sent) <= 2:
        tries = [(sent + toks[cur:cur + e], cur) for e in (1, 2)]
        if cur > 0:
            tries.append((toks[max(0, cur - 2):cur] + sent, max(0, cur - 2)))
        for longer, start in tries:
            if not hit and start < len(toks):
                hit = _scan(toks, longer, start, 0.85)
    if not hit:
        return NONE
    state["cursor"] = hit[1] + 1
    return hit


def _free_windows(toks, n, used):
    return [i for i in range(len(toks) - n + 1) if not used & set(range(i, i + n))]


def _best(score, floor, strict, early=None):
    def rule(toks, sent, used, state):
        if not sent:
            return NONE
        best = NONE
        for i in _free_windows(toks, len(sent), used):
            s = score(toks[i:i + len(sent)], sent)
            if s > best[2]:
                best = (i, i + len(sent) - 1, s)
            if early and s >= early:
                break
        ok = best[2] > floor if strict else best[2] >= floor - 1e-9
        if not ok:
            return NONE
        used |= set(range(best[0], best[1] + 1))
        return best
    return rule


def _partial(a, b):
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 3:
        return 0.0
    if a in b or b in a:
        return 0.8
    if abs(len(a) - len(b)) <= 2 and sum(x == y for x, y in zip(a, b)) / max(len(a), len(b)) >= 0.6:
        return 0.6
    return 0.0


def test_monotonic(spark):
    w, s = _frames(spark)
    _check(align.align_monotonic(s, w), _run(spark, "align", _mono))


def test_unused_robust(spark):
    w, s = _frames(spark)
    score = lambda a, b: round(sum(_partial(y, x) for x, y in zip(a, b)) / len(b), 12)
    _check(align.align_unused_robust(s, w), _run(spark, "clean", _best(score, 0.75, False, 0.9)))


def test_unused_simple(spark):
    w, s = _frames(spark)
    _check(align.align_unused_simple(s, w), _run(spark, "hyphen", _best(_share, 0.8, False, 1.0), True))


def test_locate(spark):
    w, s = _frames(spark)
    inner = _best(lambda a, b: round(sum(1.0 if x == y else 0.8 if x in y or y in x else 0 for x, y in zip(a, b)) / len(b), 12), 0.7, False)
    _check(align.locate_range(s, w), _run(spark, "clean", lambda t, x, u, st: inner(t, x, set(), st)))


def _flex(toks, sent, used):
    best = NONE
    for f in range(len(toks)):
        for e in range(f + 1, len(toks)):
            if toks[f] == sent[0] and toks[e] == sent[-1] and not used & set(range(f, e + 1)):
                s = sum(x in toks[f:e + 1] for x in sent) / len(sent)
                if s > best[2]:
                    best = (f, e, s)
    return best if best[2] >= 0.6 else NONE


def test_best_sequence_and_flexible(spark):
    w, s = _frames(spark)
    plain = _best(_share, 0.8, True)

    def rule(toks, sent, used, state):
        if not sent:
            return "skip"
        hit = plain(toks, sent, set(used), state)
        if hit[2] < 0.9:
            flex = _flex(toks, sent, used)
            hit = flex if flex[2] > hit[2] else hit
        if hit[0] >= 0:
            used |= set(range(hit[0], hit[1] + 1))
        return hit

    _check(align.align_best_sequence(s, w), _run(spark, "plain", rule, True))
    want = {k: v for k, v in _run(spark, "plain", lambda t, x, u, st: _flex(t, x, set()) if x else "skip", True).items() if v[0] >= 0}
    _check(align.flexible_spans(s, w.filter("word <> '!!'")), want)


def test_token_set_and_fuzzy(spark):
    w, s = _frames(spark)

    def rule(toks, sent, used, state):
        if not sent:
            return "skip"
        for i in _free_windows(toks, len(sent), used):
            if toks[i:i + len(sent)] == sent:
                used |= set(range(i, i + len(sent)))
                return i, i + len(sent) - 1, 1.0
        best = NONE
        for i in range(len(toks) - 1):
            for n in range(max(1, len(sent) - 2), min(len(sent) + 2, len(toks) - i) + 1):
                share = len(set(sent) & set(toks[i:i + n])) / len(set(sent))
                if not used & set(range(i, i + n)) and share >= 0.7 and share > best[2]:
                    best = (i, i + n - 1, share)
        if best[0] >= 0:
            used |= set(range(best[0], best[1] + 1))
        return best

    _check(align.align_token_set(s, w), _run(spark, "plain", rule, True))

    def first(toks, sent, used, state):
        for i in _free_windows(toks, len(sent), used) if sent else []:
            share = _share(toks[i:i + len(sent)], sent)
            if share >= 0.8:
                used |= set(range(i, i + len(sent)))
                return i, i + len(sent) - 1, share
        return NONE

    _check(align.align_fuzzy_unused(s, w), _run(spark, "plain", first, True))


def test_windows_join_finds_all(spark):
    w, s = _frames(spark)
    ws, ss = _normal(spark, "align")
    for floor in (1.0, 0.85, 0.5):
        want = set()
        for c, sents in ss.items():
            toks, base = [t for _, t in ws[c]], ws[c][0][0]
            for k, sent in sents:
                for i in range(len(toks) - len(sent) + 1 if sent else 0):
                    if _share(toks[i:i + len(sent)], sent) >= floor:
                        want.add((c, k, base + i))
        got = align.exact_and_fuzzy(s, w, floor)
        assert {(r.chunk_id, r.sent_idx, r.start_word_idx) for r in got.collect()} == want


def test_contractions_meet(spark):
    w = spark.createDataFrame([(1, 0, 0, "so", 0, 1), (1, 0, 1, "what's", 2, 3), (1, 0, 2, "up", 4, 5)],
                              "rec_id bigint, chunk_id int, word_idx bigint, word string, start_ms bigint, end_ms bigint")
    s = spark.createDataFrame([(1, 0, 0, "what s up")], "rec_id bigint, chunk_id int, sent_idx bigint, text string")
    r = align.align_contraction(s, w).first()
    assert (r.start_word_idx, r.end_word_idx, r.start_ms, r.end_ms) == (1, 2, 2, 5)


def test_contractions_meet_either_way(spark):
    said = ["five", "o", "clock", "now", "it's", "what", "s", "that"]
    w = spark.createDataFrame([(1, 0, i, x, 10 * i, 10 * i + 5) for i, x in enumerate(said)],
                              "rec_id bigint, chunk_id int, word_idx bigint, word string, start_ms bigint, end_ms bigint")
    texts = ["five o'clock now", "It s what's that", "clock now", "five now"]
    s = spark.createDataFrame([(1, 0, i, x) for i, x in enumerate(texts)], "rec_id bigint, chunk_id int, sent_idx bigint, text string")
    got = rows(align.align_contraction(s, w).select("start_word_idx", "end_word_idx", "sent_idx"), "sent_idx")
    assert [g[:2] for g in got] == [(0, 3), (4, 7), (2, 3), (-1, -1)]


def test_monotonic_spans_do_not_overlap(t):
    got = align.align_monotonic(t.sentences_edited, t.words).filter("start_word_idx >= 0")
    last = {}
    for rec, chunk, a, b in rows(got.select("rec_id", "chunk_id", "start_word_idx", "end_word_idx", "sent_idx").drop("sent_idx"), "rec_id", "chunk_id", "start_word_idx"):
        assert a > last.get((rec, chunk), -1) and b >= a
        last[rec, chunk] = b


def test_fallback_and_repair(spark):
    data = [(1, 0, "x" * 16, None, None), (1, 1, "x" * 2, None, None), (1, 2, "abc", 9000, 9500), (1, 3, "y" * 8, None, None), (1, 4, "z", None, None)]
    df = spark.createDataFrame(data, "k bigint, i bigint, text string, start_ms bigint, end_ms bigint").withColumn("fs", F.lit(100).cast("bigint")).withColumn("fe", F.lit(140).cast("bigint"))
    get = lambda **kw: [r[3:5] for r in rows(timing.fallback_times(df, ["k"], ["i"], **kw), "i")]
    for width in (2, 4096):
        assert get(mode="a", first_start="fs", width=width) == [(100, 2100), (2100, 2600), (9000, 9500), (9500, 10500), (10500, 11000)]
        assert get(mode="b", width=width) == [(0, 2000), (2000, 4000), (9000, 9500), (9500, 11500), (11500, 13500)]
        assert get(mode="c", first_start="fs", first_end="fe", width=width) == [(100, 1740), (1740, 1940), (9000, 9500), (9500, 10300), (10300, 10400)]
    assert get(mode="d") == [(0, 0), (0, 0), (9000, 9500), (0, 0), (0, 0)]
    bad = spark.createDataFrame([(1, 0, 50, 50), (1, 1, 9, 8), (1, 2, 3000, 3100), (1, 3, 5, 5), (1, 4, 6, 6)], "k bigint, i bigint, start_ms bigint, end_ms bigint")
    for width in (2, 4096):
        got = [r[2:] for r in rows(timing.repair_times(bad, ["k"], ["i"], width=width), "i")]
        assert got == [(50, 1050), (1050, 2050), (3000, 3100), (3100, 4100), (4100, 5100)]


def test_anomaly_labels(spark):
    data = [(1, 0, i, s, e, x) for i, (s, e, x) in enumerate([(0, 100, "hello"), (100, 200, "hello"), (150, 20000, "hello"), (20000, 20000, "a"), (20001, 20002, "b"), (20003, 20004, "c")])]
    df = spark.createDataFrame(data, "rec_id bigint, chunk_id int, seg_idx bigint, start_ms bigint, end_ms bigint, text string")
    full = quality.anomalies(df, width=2).first().labels
    assert full == ["repeated_segments(2)", "long_segments(1)", "zero_duration(1)", "fragmented(3/6)", "single_chars(3)", "overlaps(1)"]
    assert "single_chars(3)" not in quality.anomalies(df, variant="plain").first().labels


def test_token_scores_by_their_definition():
    """Contained or containing .8, alike .6, equal 1; the pieces of a token are looked up and not searched in all words."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcü𝄞") for _ in range(rng.randint(1, 8)))
    for _ in range(40):
        norms = [word() for _ in range(60)]
        chunk = align._Chunk(norms)
        for tok in [word() for _ in range(20)] + norms[:5]:
            got = dict(zip(chunk.names, chunk.token_scores(tok, True).tolist(), strict=True))
            for name, score in got.items():
                same = sum(a == b for a, b in zip(name, tok)) / max(len(name), len(tok))
                alike = abs(len(name) - len(tok)) <= 2 and same >= 0.6
                want = 0.8 if tok in name or name in tok else 0.6 if alike else 0.0
                want = 0.0 if len(name) < 3 or len(tok) < 3 else want
                assert score == (1.0 if name == tok else want), (name, tok)
