import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionloom.llm import common, exact_dedup, graph, mixing, simhash


def fold(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    return groups


def check_exact(df, keep="max"):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    groups = plain_groups(rows)
    want = []
    for i, t in rows:
        ids = [x for x in groups[fold(t)] if x is not None]
        best = (max if keep == "max" else min)(ids) if ids else None
        want.append((i, best, len(groups[fold(t)]), i == best, hashlib.sha256(fold(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(df, keep=keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert Counter(got) == Counter(want)


def test_exact_dedup_matches_plain_groups(docs):
    check_exact(docs)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup_odd_rows(odd, keep):
    check_exact(odd, keep)


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert exact_dedup.drop_duplicates(nothing).columns == nothing.columns


def runs_of(df, **kw):
    return Counter((bytes(r["digest"]), r["n_bytes"], r["check"], r["keep_id"], r["group_size"]) for r in exact_dedup.merge_runs(df, **kw).collect())


def test_merge_runs_has_the_same_result_for_any_tree(docs):
    rows = exact_dedup.digests(docs.repartition(13))
    want = runs_of(rows, rounds=1, fan_in=2)
    groups = plain_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((k[3], k[4]) for k in want.elements()) == sorted((max(g), len(g)) for g in groups.values())
    assert all(runs_of(rows, rounds=r, fan_in=f) == want for r, f in ((2, 2), (5, 2), (3, 4), (2, 8)))
    assert exact_dedup.rounds_for(0, 8) == 2 and exact_dedup.rounds_for(10**9, 8) == 4


def test_each_level_merges_sorted_runs_in_order(docs):
    """Levels are sort aggregates over runs sorted for them; the exchanges between them go by run alone."""
    rows = exact_dedup.digests(docs.repartition(5))
    plan = exact_dedup.merge_runs(rows, rounds=3, fan_in=2)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("hashpartitioning(run#") >= 4
    after = [x for x in plan.split("\n") if "REPARTITION_BY_NUM" in x and "RoundRobin" not in x]
    assert len(after) == 3 and not any("digest" in x for x in after)


def test_texts_are_one_only_where_all_hashes_agree(spark):
    rows = [(1, b"d", 5, 7), (2, b"d", 5, 7), (3, b"d", 6, 7), (4, b"d", 5, 8), (None, b"d", 5, 8), (None, b"e", 1, 1)]
    df = spark.createDataFrame(rows, "id bigint, digest binary, n_bytes int, check bigint")
    for keep, best in (("max", 2), ("min", 1)):
        got = {(r["keep_id"], r["group_size"]) for r in exact_dedup.merge_runs(df, rounds=2, fan_in=2, keep=keep).collect()}
        assert got == {(best, 2), (3, 1), (4, 2), (None, 1)}


def test_drop_duplicates_keeps_the_largest_id(odd):
    got = exact_dedup.drop_duplicates(odd)
    assert got.columns == odd.columns
    ids = Counter(r["doc_id"] for r in got.select("doc_id").collect())
    assert ids[5] == 1 and 4 not in ids and 1 not in ids and ids[2] == 1 and ids[6] == 1


def clashing(spark):
    """Ids that repeat or lack, rows that repeat, and columns with the names that are used inside."""
    rows = [(1, "same text here", "a", "p"), (1, "same text here", "a", "p"), (1, "same text here", "a", "q"), (None, "same text here", "a", "p"),
            (1, "another text", "a", "p"), (None, "lone", "b", "p"), (None, "lone", "b", "p"), (None, "lone", "b", "r"), (2, "x", None, "p"), (2, "y", None, "p")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __sha string")
    for name in ("__copies", "__copy", "__id", "__kept", "m1", "m2", "n", "row", "copies", "best", "run", "check", "known", "first", "block"):
        df = df.withColumn(name, F.col("__sha"))
    return df


def test_stages_on_repeated_ids_and_clashing_names(spark):
    df = clashing(spark)
    got = exact_dedup.drop_duplicates(df)
    assert got.columns == df.columns and Counter(r["__sha"] in "pqr" for r in got.collect()) == {True: 5}
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "lone"), (1, "another text"), (1, "same text here"), (2, "x"), (2, "y")]
    near = simhash.keep_one(df)
    assert near.columns == df.columns
    fps = {r["text"]: plain_fingerprint(r["text"]) for r in df.collect()}
    assert len({*fps.values()}) == 5
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near.collect()) == [(0, "lone"), (1, "another text"), (1, "same text here"), (2, "x"), (2, "y")]
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    each = mixing.mix(df).collect()
    rows = mixed.collect()
    assert len(rows) == sum(r["copies"] for r in each) and words(rows) == sum(r["taken"] for r in each)
    assert Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in rows) == Counter(
        {k: n for k in {(r["doc_id"], r["source"], r["size"]) for r in each}
         if (n := sum(r["copies"] for r in each if (r["doc_id"], r["source"], r["size"]) == k))})


def test_near_copies_of_one_id_leave_one(spark):
    base = "one two three four five six seven eight nine ten " * 4
    df = spark.createDataFrame([(3, base), (3, base + "eleven"), (None, base), (5, base), (5, "other words entirely " * 5)], "doc_id bigint, text string")
    got = simhash.keep_one(df).collect()
    fps = [plain_fingerprint(r["text"]) for r in df.collect()]
    linked = [[bin(a ^ b).count("1") <= 2 for b in fps] for a in fps]
    assert len(got) == len(set(plain_components(len(fps), linked)))
    assert (5, "other words entirely " * 5) in [tuple(r) for r in got] and sum(r["doc_id"] == 3 and r["text"] == base for r in got) <= 1


def test_a_row_taken_any_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 3)
    df = spark.createDataFrame([(1, "a b", "s")] * 7 + [(2, "a b", "s"), (3, "c", "t")], "doc_id bigint, text string, source string")
    each = mixing.mix(df).collect()
    assert mixing.mixed(df).count() == sum(r["copies"] for r in each)


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, linked):
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i]] + [label[j] for j in range(n) if linked[i][j]]) for i in range(n)]
        if new == label:
            break
        label = new
    return label


def check_simhash(df):
    rows = sorted(((r["doc_id"], plain_fingerprint(r["text"])) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    linked = [[bin(a ^ b).count("1") <= 2 for _, b in rows] for _, a in rows]
    label = plain_components(len(rows), linked)
    want = Counter((i, f"{f:016x}", rows[label[k]][0]) for k, (i, f) in enumerate(rows))
    got = Counter(tuple(r) for r in simhash.near_dedup(df).select("doc_id", "fingerprint", "component_id").collect())
    assert got == want


def test_simhash_matches_brute_force(docs):
    check_simhash(docs)


def test_simhash_odd_rows(odd, nothing):
    check_simhash(odd.where("doc_id is null or doc_id <> 9"))
    assert simhash.near_dedup(nothing).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns


@pytest.mark.parametrize("crowded", [1, 64])
def test_near_pairs_connects_all_close_fingerprints(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 12, dtype=np.int64)
    fps = {int(b) for b in base} | {0, -1, -(1 << 63)}
    for _ in range(160):
        bits = rng.choice(64, rng.integers(1, 4), replace=False)
        value = int(rng.choice(base)) & (1 << 64) - 1
        for b in bits:
            value ^= 1 << int(b)
        fps.add(value - (1 << 64) if value >> 63 else value)
    fps = sorted(fps)
    pairs = simhash.near_pairs(spark.createDataFrame([(f,) for f in fps], "fp bigint"))
    got = dict(map(tuple, graph.components(pairs).collect()))
    linked = [[bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for b in fps] for a in fps]
    label = plain_components(len(fps), linked)
    assert [got.get(f, f) for f in fps] == [fps[k] for k in label]
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 2 for r in pairs.collect())


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000} and 5000 not in got
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), cap=3.0):
    """Excess shared anew by weight, round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[k % 3]) for k, s in enumerate(order)}
    left, target, open_ = float(sum(sizes.values())), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix_meets_targets(request, which):
    df = request.getfixturevalue(which)
    words = [(r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in df.collect()]
    sizes, longest = defaultdict(int), defaultdict(int)
    for s, n in words:
        sizes[s] += n
        longest[s] = max(longest[s], n)
    got = mixing.mix(df).collect()
    assert len(got) == len(words) and Counter((r["source"], r["size"]) for r in got) == Counter(words)
    want = plain_targets(sizes)
    for s in sizes:
        rows = [r for r in got if r["source"] == s]
        assert rows[0]["source_size"] == sizes[s] and rows[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in rows) - want[s]) <= 2 * longest[s] + 1e-6
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in rows)
    again = mixing.mix(df.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_of_no_words(spark, nothing):
    assert mixing.mix(nothing).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")).collect()
    assert [r["target"] for r in got] == [0, 0] and [r["copies"] for r in got] == [0, 0]


def test_mixed_emits_whole_rows(docs):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.select("doc_id").collect()) == Counter({k: v for k, v in copies.items() if v})


def test_mixed_odd_rows(odd, nothing):
    got = mixing.mixed(odd)
    assert got.columns == odd.columns and got.where(F.col("text").isNull()).count() <= 3
    assert mixing.mixed(nothing).count() == 0


def test_probes_are_not_broadcast(spark, tmp_path):
    # 66 rows a fingerprint, which Spark sizes as the stored fingerprints themselves
    spark.range(2000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fps")
    plan = simhash.near_pairs(spark.read.parquet(f"{tmp_path}/fps"))._jdf.queryExecution().executedPlan().toString()
    inner = [line for line in plan.splitlines() if "Join [" in line and ", Inner" in line]
    assert inner and all("SortMergeJoin" in line for line in inner)


def test_rows_are_not_picked_by_a_broadcast(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    docs.select(*common.row_marks(docs)).withColumn("n", F.lit(1)).write.parquet(f"{tmp_path}/chosen")
    got = common.pick(docs, spark.read.parquet(f"{tmp_path}/chosen"))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 2000
