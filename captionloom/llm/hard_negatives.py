"""Hard negatives: exact integer scores by matrix products in residue number systems, then windowed selection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import join_frequent

#: float32 holds every whole number up to here, so a sum of products of residues is exact below it.
EXACT = 1 << 24
#: Components (rows x dimensions) of a block at most, and of the pieces scored at a time.
BLOCK, PIECE_ANCHORS, PIECE_ROWS = 1 << 21, 256, 2048
#: Scores are longs; squared lengths of vectors stay below this.
LONGEST = float(1 << 61)
NONE = np.iinfo(np.int64).min


def moduli(bound: int, dims: int) -> list[int]:
    """Primes, largest first, whose product exceeds ``2 * bound``; a product of residues summed over ``dims`` (or as many
    dimensions as are summed at a time, 64 at least) is exact in float32."""
    most = 2 * int((EXACT / max(64, min(dims, 64))) ** 0.5) + 1  # residues lie in -(p - 1) / 2 ... (p - 1) / 2
    sieve = np.ones(most + 1, bool)
    for i in range(2, int(most**0.5) + 1):
        sieve[i * i :: i] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > 2 * bound:
            return out or [p]
        out.append(p)
        product *= p
    raise ValueError("scores do not fit the primes")


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Remainders by ``p`` of whole numbers in float64, between -p / 2 and p / 2."""
    return x - p * np.rint(x / p)


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The matrix modulo each prime, in float32."""
    whole = matrix.astype(np.float64)
    return [balanced(whole, p).astype(np.float32) for p in primes]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact signed inner products (rows of ``left`` by rows of ``right``), as int64.

    One float32 matrix product a prime, in slices of the dimensions whose sums stay exact. The balanced remainders
    are then turned into digits of a mixed radix, each found from the ones before (Garner); with odd primes
    and digits on both sides of zero the number they spell is the signed score itself.
    """
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        a, b = left[k], right[k]
        step = max(1, EXACT // ((p - 1) // 2) ** 2)
        rest = np.zeros((a.shape[0], b.shape[0]))
        for lo in range(0, a.shape[1], step):
            rest = balanced(rest + (a[:, lo : lo + step] @ b[:, lo : lo + step].T).astype(np.float64), p)
        for q, digit in zip(primes, digits, strict=False):
            rest = balanced((rest - digit) * pow(q, -1, p), p)
        digits.append(rest)
    out, weight = np.zeros(digits[0].shape, np.int64), 1
    for p, digit in zip(primes, digits, strict=True):
        out += digit.astype(np.int64) * np.int64((weight + (1 << 63)) % (1 << 64) - (1 << 63))  # sums wrap, their end does not
        weight *= p
    return out


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists as rows of a matrix; what shorter ones lack is zero."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _first(scores: np.ndarray, ids: np.ndarray, best: np.ndarray, best_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest of the best so far and of new scores, largest first. Rows come in order of id, so of ties
    the one met first has the smallest id, and that is the one argmax finds. ``NONE`` marks no row."""
    pool = np.hstack([best, scores])
    names = np.hstack([best_ids, np.broadcast_to(ids, scores.shape)])
    at = np.arange(len(pool))
    out, out_ids = np.empty_like(best), np.empty_like(best_ids)
    for k in range(best.shape[1]):
        place = pool.argmax(axis=1)
        out[:, k], out_ids[:, k] = pool[at, place], names[at, place]
        pool[at, place] = NONE
    return out, out_ids


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("id")


def _pieces(n: int, step: int):
    return [slice(lo, lo + step) for lo in range(0, n, step)]


def positives_of(primes: list[int], dims: int, count: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Per anchor of a block, the ``count`` rows of largest score in a block of rows of its label, itself left out."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: dict[str, list[np.ndarray]] = {"anchor_id": [], "positive_id": [], "positive_score": []}
        if anchors.num_rows and rows.num_rows:
            rows = _sorted(rows)
            ids, mine = rows["id"].to_numpy(), anchors["id"].to_numpy()
            left, right = residues(_matrix(anchors["q"], dims), primes), residues(_matrix(rows["q"], dims), primes)
            for a in _pieces(len(mine), PIECE_ANCHORS):
                size = (len(mine[a]), count)
                best, names = np.full(size, NONE), np.zeros(size, np.int64)
                for r in _pieces(len(ids), PIECE_ROWS):
                    s = products([x[a] for x in left], [x[r] for x in right], primes)
                    s[mine[a][:, None] == ids[r][None, :]] = NONE
                    best, names = _first(s, ids[r], best, names)
                i, k = np.nonzero(best != NONE)
                for name, x in zip(found, (mine[a][i], names[i, k], best[i, k]), strict=True):
                    found[name].append(x)
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in found.items()})

    return run


def negatives_of(primes: list[int], dims: int, count: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Per anchor and positive of a block, the ``count`` rows of largest score among a block's rows of other labels whose
    score is ``low`` to ``high`` hundredths of the positive's."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: dict[str, list[np.ndarray]] = {x: [] for x in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")}
        if anchors.num_rows and rows.num_rows:
            rows = _sorted(rows)
            ids, kinds = rows["id"].to_numpy(), rows["label"].to_numpy()
            mine, kind = anchors["id"].to_numpy(), anchors["label"].to_numpy()
            slots = max(len(x) for x in anchors["positives"].to_pylist())
            pos, want = np.zeros((len(mine), slots), np.int64), np.full((len(mine), slots), NONE)
            for i, each in enumerate(anchors["positives"].to_pylist()):
                for k, p in enumerate(each):
                    pos[i, k], want[i, k] = p["positive_id"], p["positive_score"]
            whole, part = np.divmod(want, 100)
            top, least = high * whole + high * part // 100, low * whole - (-low * part) // 100
            top[want == NONE], least[want == NONE] = NONE, NONE + 1
            left, right = residues(_matrix(anchors["q"], dims), primes), residues(_matrix(rows["q"], dims), primes)
            for a in _pieces(len(mine), PIECE_ANCHORS):
                size = (slots, len(mine[a]), count)
                best, names = np.full(size, NONE), np.zeros(size, np.int64)
                for r in _pieces(len(ids), PIECE_ROWS):
                    s = products([x[a] for x in left], [x[r] for x in right], primes)
                    s[kind[a][:, None] == kinds[r][None, :]] = NONE
                    for k in range(slots):
                        fits = (s <= top[a, k, None]) & (s >= np.maximum(least[a, k], best[k][:, -1] + 1)[:, None])
                        hit = np.flatnonzero(fits.any(axis=1))
                        if len(hit):
                            best[k][hit], names[k][hit] = _first(np.where(fits[hit], s[hit], NONE), ids[r], best[k][hit], names[k][hit])
                k, i, j = np.nonzero(best != NONE)
                for name, x in zip(found, (mine[a][i], pos[a][i, k], want[a][i, k], names[k, i, j], best[k, i, j]), strict=True):
                    found[name].append(x)
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in found.items()})

    return run


def quantised(vectors: DataFrame, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(id, label, q)`` of the rows that take part: ``q`` holds floor(scale * x) of every component."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vec_col).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("q"))


def _cells(left: DataFrame, right: DataFrame, keys: list[str], n: int, fn, schema: str) -> DataFrame:
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # columns of their own: both sides come from one table
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInArrow(fn, schema)


def _first_rows(found: DataFrame, per: list[str], score: str, name: str, count: int) -> DataFrame:
    order = Window.partitionBy(*per).orderBy(F.col(score).desc(), F.col(name))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label", every: int = 50,
                   n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id is divisible by ``every``. Vectors are quantised to floor(``scale`` x), and a score
    is the whole inner product, exact at any size. An anchor's positives are the ``n_positives`` other rows of its
    label with the largest scores, and for each of these the ``n_negatives`` rows of other labels with the largest
    scores between ``low`` and ``high`` hundredths of the positive's; ties go to the smaller id. Scores of zero or
    less work alike: below zero the range is empty.

    All anchors meet all rows in blocks whose size is bounded in components, once for positives (blocks of a
    label, cut as a label needs) and once for negatives; a block pair returns the few best of each anchor, and
    windows choose among them. No score leaves a task. More rows make more blocks, never larger ones.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Of rows that repeat
    an id, the one of least (label, vector) does. Shorter vectors count as filled up with zeros, an empty one
    as zero. Vectors whose squared length reaches 2^61 after quantising raise ValueError: their scores fit no long.
    Fewer positives or negatives than asked for give fewer rows; no rows give none. Other columns are not read.
    """
    schema = "anchor_id bigint, positive_id bigint, positive_score bigint"
    full = f"{schema}, negative_id bigint, negative_score bigint"
    rows = quantised(vectors, F.col(label) if isinstance(label, str) else label, id_col, vec_col, scale)
    one = F.min(F.struct("label", "q")).alias("one")
    rows = materialize(rows.groupBy("id").agg(one).select("id", "one.label", "one.q"), "vectors")
    length = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, n_anchors, dims, longest = rows.agg(
        F.count(F.lit(1)), F.count_if(F.col("id") % every == 0), F.max(F.size("q")), F.max(length)).first()
    spark = vectors.sparkSession
    if not n_anchors:
        return spark.createDataFrame([], full).select(
            "anchor_id", "positive_id", F.lit(1).alias("rank"), "negative_id", "positive_score", "negative_score")
    if longest >= LONGEST:
        raise ValueError(f"scores of vectors this long do not fit a long: squared length {longest:g} after quantising")
    dims = max(1, dims)
    primes = moduli(int(longest) + 1, dims)
    most, tasks = max(64, BLOCK // dims), 2 * spark.sparkContext.defaultParallelism

    def blocks(count: Column | int, least: int = 1):
        """Blocks for so many rows: as few as their size allows, but some for every core."""
        if isinstance(count, int):
            return max(-(-count // most), min(-(-count // 1024), tasks), least)
        return F.ceil(count / F.lit(most)).cast("int")

    def block(of: Column | int, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(of) if isinstance(of, int) else of).cast("int")

    is_anchor = F.col("id") % every == 0
    kinds = materialize(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("n_anchors")), "labels")
    kinds = kinds.where("n_anchors > 0").select(
        "label", "n", F.greatest(blocks(F.col("n")), F.least(F.ceil(F.col("n") / 1024).cast("int"), F.lit(tasks))).alias("row_blocks"),
        blocks(F.col("n_anchors")).alias("anchor_blocks"))
    mine = join_frequent(rows, kinds, ["label"], "n", n)
    of_label = mine.withColumn("r", block(F.col("row_blocks"), 1)).select(
        "id", "q", "label", "r", F.explode(F.sequence(F.lit(0), F.col("anchor_blocks") - 1)).alias("a"))
    anchors = mine.where(is_anchor).withColumn("a", block(F.col("anchor_blocks"), 2)).select(
        "id", "q", "label", "a", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("r"))
    cells = kinds.agg(F.sum(F.col("row_blocks") * F.col("anchor_blocks"))).first()[0]
    near = _cells(anchors, of_label, ["label", "a", "r"], min(cells, 8192), positives_of(primes, dims, n_positives), schema)
    near = _first_rows(near, ["anchor_id"], "positive_score", "positive_id", n_positives)
    near = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    known = materialize(rows.where(is_anchor).join(near.withColumnRenamed("anchor_id", "id"), "id"), "anchors")

    row_blocks, anchor_blocks = blocks(n), -(-n_anchors // most)
    every_row = rows.withColumn("r", block(row_blocks, 3)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    every_anchor = known.withColumn("a", block(anchor_blocks, 4)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    far = _cells(every_anchor, every_row, ["a", "r"], min(row_blocks * anchor_blocks, 8192),
                 negatives_of(primes, dims, n_negatives, low, high), full)
    return _first_rows(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS a JOIN v AS r ON a.id % 50 = 0 AND a.id <> r.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 3
"""
