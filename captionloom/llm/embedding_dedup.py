"""Near duplicates of embeddings by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import column
from .graph import components

LEAF, SAMPLE, DEPTH = 4096, 20_000, 12


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random rotation, the same for every run."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, width: int) -> list[tuple[int, int]]:
    """Coordinates in runs of ``width``; the last takes what is left over."""
    n = max(1, dim // width)
    return [(i * width, dim if i == n - 1 else (i + 1) * width) for i in range(n)]


def budget(t: float, block: tuple[int, int], dim: int) -> float:
    """A block's share of the squared distance, in proportion to its coordinates, and a hair for rounding."""
    return t * (block[1] - block[0]) / dim * (1 + 1e-9) + 1e-12


@dataclass
class Tree:
    """Cuts of a block's space: node ``k`` compares coordinate ``axis[k]`` with ``at[k]``; children 2k and 2k + 1."""

    axis: np.ndarray
    at: np.ndarray

    def homes(self, x: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Leaf of each row, ``depth`` cuts down."""
        node = np.ones(len(x), np.int64)
        for d in range(int(depth.max(initial=0))):
            live = np.flatnonzero(depth > d)
            k = node[live]
            node[live] = 2 * k + (x[live, self.axis[k]] >= self.at[k])
        return node

    def reached(self, x: np.ndarray, depth: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` of all leaves that hold points within ``radius`` of a row in every cut's coordinate."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        done_row, done_node = [], []
        for d in range(int(depth.max(initial=0)) + 1):
            stop = depth[row] <= d
            done_row.append(row[stop])
            done_node.append(node[stop])
            row, node = row[~stop], node[~stop]
            gap = x[row, self.axis[node]] - self.at[node]
            left, right = gap < radius, gap >= -radius
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return np.concatenate(done_row), np.concatenate(done_node)


def grow(points: np.ndarray, depth: int = DEPTH) -> Tree:
    """Median cuts of a sample along its widest coordinate, as deep as the sample has 16 points in a node."""
    axis, at = np.zeros(1 << (depth + 1), np.int64), np.zeros(1 << (depth + 1))
    todo = [(1, points, 0)]
    while todo:
        k, x, d = todo.pop()
        if d >= depth or not x.shape[1]:
            continue
        axis[k] = int(np.argmax(np.ptp(x, axis=0))) if len(x) else 0
        at[k] = np.median(x[:, axis[k]]) if len(x) else 0.0
        right = x[:, axis[k]] >= at[k]
        if len(x) >= 32:
            todo += [(2 * k, x[~right], d + 1), (2 * k + 1, x[right], d + 1)]
    return Tree(axis, at)


def units(batch: pa.RecordBatch, name: str = "vec") -> np.ndarray:
    flat = column(batch, name).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(batch.num_rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(id, label, dim, vec, copies)``: a row per different vector of a label, with its smallest id; the
    vectors that can link at all."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("vec", lambda x: x == 0)
    rows = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("vec") > 0) & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True)))
    return rows.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("vec"))


def _tiles(reps: DataFrame, dim: int, t: float, width: int, leaf: int, seed: int) -> DataFrame:
    """``(label, block, tile, guest, id, copies, vec)``: each vector at home in one leaf of each block, and a guest in
    every later leaf that its block's range reaches."""
    spark = reps.sparkSession
    turn, parts = rotation(dim, seed), blocks_of(dim, width)
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(max(1000, SAMPLE * 64 // max(64, dim))).select("vec").toArrow().combine_chunks()
    points = units(sample.to_batches()[0]) @ turn
    trees = [grow(points[:, a:b]) for a, b in parts]
    counts = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf)
    depth = F.least(F.lit(DEPTH), F.ceil(F.log2(F.col("n") / leaf))).cast("int")
    rows = reps.join(counts, "label", "left").select("id", "label", "copies", "vec", F.when(F.col("n").isNull(), 0).otherwise(depth).alias("depth"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                x = units(batch) @ turn
                deep = column(batch, "depth").to_numpy()
                for k, (a, b) in enumerate(parts):
                    home = trees[k].homes(x[:, a:b], deep)
                    row, node = trees[k].reached(x[:, a:b], deep, budget(t, (a, b), dim) ** 0.5 + 1e-9)
                    some = node >= home[row]
                    row, node = row[some], node[some]
                    take = pa.array(row)
                    kept = [column(batch, c).take(take) for c in ("id", "label", "copies", "vec")]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(row), k, np.int32)), pa.array(node), pa.array(node > home[row])],
                                                     ["id", "label", "copies", "vec", "block", "leaf", "guest"])

    kinds = dict(reps.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, copies bigint, vec array<double>, block int, leaf bigint, guest boolean"
    placed = rows.mapInArrow(run, schema)
    full = materialize(placed.where("NOT guest").groupBy("label", "block", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * leaf)).cast("int").alias("parts")).where("parts > 1"), "full-leaves")
    split = placed.join(full, ["label", "block", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.when(F.col("guest"), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    split = split.withColumn("own", own).withColumn("part", F.explode(F.sequence(F.col("own"), F.col("parts") - 1)))
    return split.select("label", "block", "leaf", "part", (F.col("guest") | (F.col("part") > F.col("own"))).alias("guest"), "id", "copies", "vec")


def _links(tiles: DataFrame, dim: int, t: float, cosine: float, width: int, seed: int) -> DataFrame:
    """``(id, links, other)``: for each tile, how many other vectors each vector links with by it, copies counted, and
    a vector of the same connected part."""
    turn, parts = rotation(dim, seed), blocks_of(dim, width)
    limits = [budget(t, p, dim) for p in parts]

    def near(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = parts[k]
        d = x[:, a:b] - y[:, a:b]
        return (d * d).sum(axis=1) <= limits[k]

    def pairs(k: int, home: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Links between two sets of ``(units, rotated)`` rows that block ``k`` is the first to find."""
        (u, x), (v, y) = home, other
        a, b = parts[k]
        p, q = x[:, a:b], y[:, a:b]
        d = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * (p @ q.T)
        close = d <= limits[k] + 1e-9
        i, j = np.nonzero(close)
        ok = near(k, x[i], y[j])
        i, j = i[ok], j[ok]
        for earlier in range(k):
            ok = ~near(earlier, x[i], y[j])
            i, j = i[ok], j[ok]
        ok = np.einsum("nd,nd->n", u[i], v[j]) >= cosine
        return i[ok], j[ok]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, links, label = None, None, None, None

        def rows_of(batch: pa.RecordBatch) -> tuple:
            u = units(batch)
            return u, u @ turn, column(batch, "id").to_numpy(), column(batch, "copies").to_numpy()

        def out(ids, n, other) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(other)], ["id", "links", "other"])

        def join(i: np.ndarray) -> None:
            """Homes ``i`` are connected."""
            seen = np.unique(label[i])
            if len(seen) > 1:
                label[np.isin(label, seen)] = seen[0]

        def meet(guests: tuple | None) -> Iterator[pa.RecordBatch]:
            u, x, ids, copies = homes
            other = homes if guests is None else guests
            for lo in range(0, len(other[2]), 512):
                part = tuple(c[lo : lo + 512] for c in other)
                i, j = pairs(key[1], (u, x), part[:2])
                if guests is None:
                    once = i < j + lo
                    i, j = i[once], j[once]
                links[:] += np.bincount(i, part[3][j], len(ids)).astype(np.int64)
                got = np.bincount(j, copies[i], len(part[2]))
                order = np.argsort(j, kind="stable")
                i, j = i[order], j[order]
                each = np.flatnonzero(np.diff(j, prepend=-1))
                for a, b in zip(each, [*each[1:], len(j)], strict=False):
                    join(i[a:b] if guests is not None else np.append(i[a:b], lo + j[a]))
                if guests is None:
                    links[lo : lo + 512] += got.astype(np.int64)
                elif len(each):
                    yield out(part[2][j[each]], got[j[each]], ids[i[each]])

        def finish() -> Iterator[pa.RecordBatch]:
            ids = homes[2]
            root = ids[label]
            some = np.flatnonzero((links > 0) | (root != ids))
            if len(some):
                yield out(ids[some], links[some], root[some])

        waiting: list[tuple] = []

        def settle() -> Iterator[pa.RecordBatch]:
            """All homes of the tile have come."""
            nonlocal homes, links, label, waiting
            if homes is None and waiting:
                homes = tuple(np.concatenate(c) for c in zip(*waiting, strict=True))
                links, label, waiting = np.zeros(len(homes[2]), np.int64), np.arange(len(homes[2])), []
                yield from meet(None)

        for batch in batches:
            keys = list(zip(*[column(batch, c).to_pylist() for c in ("label", "block", "leaf", "part")], strict=True))
            guest = column(batch, "guest").to_numpy(zero_copy_only=False)
            cut = [0, *[n for n in range(1, len(keys)) if keys[n] != keys[n - 1] or guest[n] != guest[n - 1]], len(keys)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if lo == hi:
                    continue
                if keys[lo] != key:
                    yield from settle()
                    if homes is not None:
                        yield from finish()
                    key, homes, waiting = keys[lo], None, []
                part = rows_of(batch.slice(lo, hi - lo))
                if not guest[lo]:
                    waiting.append(part)
                else:
                    yield from settle()
                    if homes is not None:  # a leaf without homes has nothing to meet
                        yield from meet(part)
        yield from settle()
        if homes is not None:
            yield from finish()

    kind = dict(tiles.dtypes)["id"]
    dealt = tiles.repartition("label", "block", "leaf", "part").sortWithinPartitions("label", "block", "leaf", "part", "guest")
    return dealt.mapInArrow(run, f"id {kind}, links bigint, other {kind}")


def near_dedup(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
               width: int = 8, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """One row per vector: ``(id_col, n_links, component_id, kept)``.

    Vectors of equal labels link at a cosine of ``cosine`` or more, in double precision. Unit vectors at that cosine have
    a squared distance of 2 (1 - cosine) at most. They are rotated and split into blocks of ``width`` coordinates, each
    with its share of that distance in proportion; a pair that links keeps within the share of one block at least. Each block is a range join:
    median cuts (from a sample of 20,000 vectors at most, which only shapes the leaves) divide its space until a leaf holds about
    ``leaf`` vectors of a label; a vector is at home in its leaf and a guest in the later leaves its range
    reaches. In a leaf, pairs within the block's share are candidates, of the first such block alone, and
    are verified by the cosine. A leaf with more homes than twice ``leaf`` is split by hash, and guests stream by, so a task's
    memory is bounded. What leaves a task is a count per vector and a spanning forest of its links, never the pairs.

    Equal vectors of a label are one vector with that many copies; each copy links with the others. Vectors that are null,
    empty, zero, of null label, or hold null or non-finite components link with nothing; neither do different lengths. Such
    rows, and vectors without partners, have 0 links and their own id as component. Null ids are returned without links. Repeated ids
    count as copies of their own. An empty table gives an empty result; other columns are not read.
    """
    t = 2 * (1 - cosine)
    reps = materialize(usable(vectors, id_col, vec_col, label_col), "vectors")
    parts = []
    for (dim,) in reps.select("dim").distinct().orderBy("dim").collect():
        tiles = _tiles(reps.where(F.col("dim") == dim), dim, t, width, leaf, seed)
        parts.append(_links(tiles, dim, t, cosine, width, seed))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    if not parts:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = materialize(found, "vector-links")
    roots = components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = reps.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "label", "vec", F.coalesce("root", "id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.join(named, ["label", "vec"], "left")
    linked = F.col("root").isNotNull() & F.col("id").isNotNull()
    component = F.when(linked, F.col("root")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.when(linked, F.col("n_links")).otherwise(0).cast("bigint").alias("n_links"),
        component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"),
    )
