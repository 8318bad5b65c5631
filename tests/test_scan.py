"""Block scans against plain loops, with hot keys and tiny blocks."""

import random

from helpers import rows
from pyspark.sql import functions as F

from captionloom.operators import merge, segment
from captionloom.operators.scan import gap_groups, machine_entry, ordered_scan, with_previous, with_rank


def _data(spark, n=400, seed=5):
    rnd = random.Random(seed)
    # key 0 holds most rows
    data = [(0 if rnd.random() < 0.7 else rnd.randrange(1, 5), i, rnd.randrange(100), rnd.choice([None, i])) for i in range(n)]
    return data, spark.createDataFrame(data, "k bigint, pos bigint, v bigint, o bigint")


def _expected(data):
    out, state = [], {}
    for k, pos, v, o in sorted(data):
        total, top, last = state.get(k, (0, None, None))
        out.append((k, pos, total, top, last))
        state[k] = (total + v, v if top is None else max(top, v), last if o is None else o)
    return out


def test_prefix_values_equal_a_loop_for_every_block_width(spark):
    data, df = _data(spark)
    want = _expected(data)
    for width, depth in ((3, 2), (16, 1), (4096, 0), (1000, 2)):
        got = ordered_scan(df, ["k"], ["pos"], sums={"s": F.col("v")}, maxes={"m": F.col("v")}, lasts={"l": F.col("o")}, width=width, depth=depth)
        assert rows(got.select("k", "pos", "s", "m", "l"), "k", "pos") == want


def test_composite_order(spark):
    data = [(1, c, i, 10 * c + i) for c in range(7) for i in range(c + 1)] + [(2, 0, 0, 5)]
    df = spark.createDataFrame(data, "k bigint, c bigint, i bigint, v bigint")
    for width in (2, 3, 100):
        got = with_rank(df, ["k"], ["c", "i"], "n", width=width)
        want, seen = [], {}
        for k, c, i, _ in sorted(data):
            seen[k] = seen.get(k, 0) + 1
            want.append((k, c, i, seen[k]))
        assert rows(got.select("k", "c", "i", "n"), "k", "c", "i") == want
        prev = with_previous(df, ["k"], ["c", "i"], {"p": "v"}, width=width)
        assert [r[3] for r in rows(prev.select("k", "c", "i", "p"), "k", "c", "i")] == [
            None, *[d[3] for d in sorted(data) if d[0] == 1][:-1], None]


def test_gap_groups_with_sparse_positions(spark):
    rnd = random.Random(3)
    at, data = 0, []
    for i in range(0, 600, 3):
        at += rnd.choice([0, 10, 10, 10, 60])
        data.append((rnd.choice([1, 1, 1, 2]), i, at, at + 5))
    df = spark.createDataFrame(data, "k bigint, pos bigint, s bigint, e bigint")
    want, state = [], {}
    for k, pos, s, e in sorted(data):
        g, end = state.get(k, (0, None))
        g += end is not None and s - end > 20
        want.append((k, pos, g))
        state[k] = (g, e)
    for width, depth in ((7, 2), (50, 1), (4096, 0)):
        got = gap_groups(df, ["k"], "pos", "s", "e", 20, width=width, depth=depth)
        assert rows(got.select("k", "pos", "utt_id"), "k", "pos") == want


def test_machine_entry_equals_a_loop(spark):
    rnd = random.Random(9)
    data = [(k, i, [rnd.randrange(4) for _ in range(4)]) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(data, "k bigint, pos bigint, step array<int>")
    want, state = [], {}
    for k, i, step in data:
        want.append((k, i, state.get(k, 0)))
        state[k] = step[state.get(k, 0)]
    for width, depth in ((3, 2), (8, 1), (256, 0)):
        assert rows(machine_entry(df, ["k"], "pos", "step", width=width, depth=depth), "k", "pos") == want


def _greedy(words, limit):
    lines = []
    for w in words:
        if lines and len(lines[-1]) + 1 + len(w) <= limit:
            lines[-1] += " " + w
        else:
            lines.append(w)
    return lines


def test_packing_one_endless_utterance_block_by_block(spark):
    rnd = random.Random(1)
    words = ["x" * rnd.choice([1, 2, 3, 5, 8, 13, 30]) for _ in range(700)]
    words[333] = "y" * 25  # longer than a line
    df = spark.createDataFrame([(7, i, w, 10 * i, 10 * i + 9) for i, w in enumerate(words)],
                               "rec_id bigint, word_idx bigint, word string, start_ms bigint, end_ms bigint")
    want = _greedy(words, 20)
    for width, depth in ((22, 2), (64, 1), (4096, 0)):
        got = rows(segment.pack_utterances(df, 3000, 20, width=width, depth=depth), "start_word_idx")
        assert [g[6] for g in got] == want
        assert got[0][2] == 0 and got[-1][3] == 699
        assert all(a[3] + 1 == b[2] for a, b in zip(got, got[1:]))
        assert all(g[4] == 10 * g[2] and g[5] == 10 * g[3] + 9 for g in got)


def test_layout_does_not_change_results(spark, t):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, segment.pack_utterances(t.words, width=128, depth=2).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] and seen[0]


def test_merge_numbers_are_dense(t):
    merged = merge.merge_chunks(t.cues, width=3)
    for _, nums in merged.groupBy("rec_id").agg(F.sort_array(F.collect_list("merged_idx"))).collect():
        assert nums == list(range(1, len(nums) + 1))
