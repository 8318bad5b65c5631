import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionloom.llm import hard_negatives, line_dedup, prefix_trie
from captionloom.llm.common import table
from captionloom.llm.queries import op11_hard_negatives

SF = "/root/testdata/sf0.001"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def fold(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- lines -------------------------------------------------------------------------------------------------------------


def plain_lines(rows, min_chars=40, min_docs=5):
    """``(id, n_lines, n_dropped, kept text)`` per (id, text)."""
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = fold(line.strip(BLANKS))
            if len(key) >= min_chars:
                holders[key].add(i)
    keep = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (k := fold(x.strip(BLANKS))) not in keep or keep[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def check_lines(df, **params):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = Counter((i, n, d, sha(t)) for i, n, d, t in plain_lines(rows, **params))
    assert Counter(map(tuple, line_dedup.line_dedup(df, **params).collect())) == want
    return sum(d * n for (_, _, d, _), n in want.items())


def test_lines_of_documents(docs):
    assert check_lines(docs) > 0
    assert check_lines(docs, min_chars=10, min_docs=2) > 0


def test_lines_odd_rows(spark, odd, nothing):
    check_lines(odd)
    assert line_dedup.line_dedup(nothing).count() == 0
    long = "Über " + "x" * 36  # 41 code points
    rows = [(i, f"{long}\n\n  {long.upper() if i % 2 else long}\t\nown {i}") for i in range(6)]
    rows += [(None, long), (None, long), (5, long + "\n"), (5, long + "\n"), (-1, "\r\n".join([long] * 50_000)), (9, None), (10, "short\n" * 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert check_lines(df) > 50_000
    assert check_lines(df, min_docs=9) == 0


def test_dropped_lines_leave_other_columns(odd):
    df = odd.unionByName(odd.withColumn("text", F.lit("a line of more than forty code points, everywhere\nx")).withColumn("doc_id", F.expr("doc_id + 100")))
    got = line_dedup.drop_lines(df)
    assert got.columns == df.columns and got.schema["text"].dataType == df.schema["text"].dataType
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = Counter((i, None if t is None else k) for (_, t), (i, _, _, k) in zip(rows, plain_lines(rows), strict=True))
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    assert {r["a.b"] for r in got.select("`a.b`").collect()} == {"a.b"}


def test_frequent_lines_go_by_broadcast_and_rare_ones_by_shuffle(spark):
    hot, rare = "h" * 45, "r" * 45
    rows = [(i, "\n".join([hot] * 3 + ([rare] if i % 400 == 0 else []) + [f"{i} {'u' * 45}"] * 2)) for i in range(4000)]
    assert check_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)) == 3 * 3999 + 9


# ---- tries -------------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for each in convs.values():
        each.sort(key=lambda x: x[:2])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 4
        way = [x[2:] for x in convs.get(c - int(math.fmod(c, 20)), [])[:h] + convs[c][h:]]
        for d in range(len(way) + 1):
            members[tuple(way[:d])].append(c)
        ends[tuple(way)].append(c)
    children, saved, leaves = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for n, cs in members.items():
        words = len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", n[-1][1])]) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(cs) - 1) * words
            leaves[n[:d]] += n not in children
    return Counter((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), children[n], leaves[n], saved[n],
                    sha(",".join(map(str, sorted(ends[n]))))) for n, cs in members.items())


def check_trie(df, **params):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.trie(df, **params)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = plain_trie(rows)
    assert Counter(map(tuple, got.collect())) == want
    return want


def test_trie_of_conversations(spark):
    assert sum(check_trie(table(spark, SF, "conversations")).values()) > 20


@pytest.mark.parametrize("band", [2, 3, 16])
def test_deep_tries_take_several_rounds(spark, band):
    r = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(r.choice([0, 1, 3, 9, 40])):
            rows.append((c, t, r.choice(["user", "bot"]) if t < 6 else "user", "a b" if t > 2 else r.choice(["x", "y z"])))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    assert max(d for _, d, *_ in check_trie(df, band=band)) > 30


def test_trie_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, depth string, c string, words string"
    rows = [(None, 0, "user", "no id"), (7, None, None, None), (7, 3, "user", "hi  there"), (8, None, "", ""), (8, 3, "user", "hi  there"),
            (20, 0, "user", "w " * 30_000), (21, 0, "user", "one"), (22, 1, "a", "b"), (40, 5, "a", "b"), (40, 9, "a", "b"), (40, 9, "a", "b"),
            (-5, 1, "a", "b"), (-25, 1, "ab", ""), (-24, 1, "a", "b"), (2**60, 0, "a", "b")]
    rows += [(c, t, "u", "same") for c in range(300, 900) for t in range(2)]  # many copies, ends of one node
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)
    check_trie(df)
    assert prefix_trie.trie(df.where("false")).count() == 0


# ---- hard negatives ----------------------------------------------------------------------------------------------------


def plain_negatives(rows, every=50):
    """``rows``: (id, label, list)."""
    q = {i: (k, [math.floor(256 * x) for x in v]) for i, k, v in rows
         if None not in (i, k, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = Counter()
    for a, (kind, v) in q.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in q.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if q[i][0] == kind][:5]:
            fits = [i for i in order if q[i][0] != kind and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out.update((a, p, k, i, score[p], score[i]) for k, i in enumerate(fits, 1))
    return out


def check_negatives(df, **params):
    want = plain_negatives([(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()], **params)
    assert Counter(map(tuple, hard_negatives.hard_negatives(df, **params).collect())) == want
    return sum(want.values())


def test_negatives_of_embeddings(spark, monkeypatch):
    df = table(spark, SF, "embeddings")
    moved = df.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    assert check_negatives(moved) > 50
    assert Counter(map(tuple, op11_hard_negatives(spark, SF).collect())) == Counter(map(tuple, hard_negatives.hard_negatives(moved).collect()))
    for name, value in (("BLOCK", 64 * 64), ("PIECE_ROWS", 7), ("PIECE_ANCHORS", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert check_negatives(moved, every=5) > 500


def test_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (50, 1, [1.0, 0.5]), (100, 2, [1.0, 0.25]), (1, 1, [1.0, 0.5]), (2, 2, [0.75, 0.0]), (3, 2, [0.75, 0.0]), (4, 2, [0.75]),
            (5, 3, []), (6, None, [1.0, 1.0]), (7, 1, None), (8, 1, [1.0, None]), (9, 1, [nan, 1.0]), (10, 1, [1.0, inf]), (None, 1, [1.0, 1.0]),
            (150, 3, [-1.0, -1.0]), (11, 3, [1.0, 1.0]), (200, 4, [0.0, 0.0]), (12, 4, [0.0, 0.0]), (250, 5, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, label int, embedding array<float>, id string, q string")
    assert check_negatives(df) > 5
    assert Counter(map(tuple, hard_negatives.hard_negatives(df.union(df)).collect())) == Counter(map(tuple, hard_negatives.hard_negatives(df).collect()))
    for empty in (df.where("false"), df.where("vec_id % 50 <> 0")):
        assert hard_negatives.hard_negatives(empty).collect() == []
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(df.withColumn("embedding", F.expr("transform(embedding, x -> cast(x * 1e9 as float))")))


def test_products_are_exact():
    r = np.random.default_rng(3)
    for dims, top in ((1, 1), (64, 300), (64, 1 << 20), (1000, 1 << 24), (200, 1 << 26)):
        a, b = r.integers(-top, top + 1, (9, dims)), r.integers(-top, top + 1, (13, dims))
        a[0], b[0] = top, -top
        primes = hard_negatives.moduli(dims * top * top, dims)
        assert len(set(primes)) == len(primes) and all(p > 1 and all(p % k for k in range(2, int(p**0.5) + 1)) for p in primes)
        got = hard_negatives.products(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
        assert (got == a.astype(object) @ b.T.astype(object)).all()


def test_negatives_of_large_components(spark):
    r = random.Random(9)
    rows = [(i, i % 3, [r.uniform(-4e5, 4e5) if i % 5 else 4e5 for _ in range(5)]) for i in range(80)]
    assert check_negatives(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"), every=4) > 20


def test_lines_are_dropped_without_python(spark):
    """Every choice of lines of a text, empty ones included, and a plan in which no Python worker takes memory."""
    lines = ["", "a", "", "ü\t", "b", ""]
    data = [("\n".join(lines), [i for i in range(6) if mask >> i & 1][::-1]) for mask in range(64)] + [("", [0]), ("x", []), ("long\n" * 50_000, list(range(1, 50_000, 2)))]
    df = spark.createDataFrame(data, "text string, gone array<int>")
    got = df.select("text", "gone", line_dedup._without(F.col("text"), F.col("gone")).alias("kept")).collect()
    assert len(got) == 67
    for r in got:
        gone = set(r.gone)
        assert r.kept == "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone)
    plan = line_dedup.line_dedup(df.select(F.lit(1).alias("doc_id"), "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
