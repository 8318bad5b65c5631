"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import column, pick, row_marks, slices, texts_of, unpacked
from .graph import components

#: Fingerprints a table bucket may hold before its probes go by the neighbour keys instead.
CROWDED = 64
HALF = 32


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64 values."""
    words = text.encode().lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    if not words:
        return 0
    rows = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    each = xxhash.xxh64_intdigest
    hashes = np.array([each(s, seed) for s in map(b" ".join, rows)], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = hashes[lo : lo + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """``(id, fp, *also)`` of whole texts; null counts as empty, and texts without words have fingerprint 0. ``also`` names
    columns of whole numbers that are passed on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = [fingerprint(t, shingle) for t in texts_of(part)]
            yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(fps, pa.int64()), *[column(part, c) for c in also]], ["id", "fp", *also])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *also)
    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in ("id", "fp", *also)))


def _segments(fp):
    """The two halves of a fingerprint, as (number, value)."""
    return F.array(
        F.struct(F.lit(0).alias("seg"), fp.bitwiseAND(F.lit((1 << HALF) - 1)).alias("val")),
        F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned(fp, HALF).alias("val")),
    )


def near_pairs(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` at 2 or fewer differing bits.

    Multi-index hashing: of two fingerprints that differ in 2 bits at most, one 32-bit half differs in 1 bit
    at most. Each half has a table, (half, value) to fingerprint; a probe enumerates the ball of one bit about
    its own value, fetches the matches, and keeps those whose complete distance is 2 or less. Only bits that
    are set get cleared: of two halves that differ in a bit, one has it set and finds the other.

    A bucket of more than ``CROWDED`` fingerprints would give as many pairs as the square of its size. All
    fingerprints that lie in such a bucket or probe it go another, equally exact way: each lists its 65
    neighbours of 0 or 1 bit. Two at distance 2 or less share a neighbour, and all that share one are within
    2 of each other, so a key holds 65 fingerprints at most and the smallest links to the rest.
    """
    table = fps.select("fp", F.explode(_segments(F.col("fp"))).alias("s")).select("fp", "s.seg", "s.val")
    bits = F.explode(F.sequence(F.lit(-1), F.lit(HALF - 1))).alias("bit")
    mask = F.when(F.col("bit") < 0, F.lit(0).cast("bigint")).otherwise(F.expr("shiftleft(1L, bit)"))
    probes = (
        table.select("fp", "seg", "val", bits).withColumn("mask", mask)
        .where((F.col("bit") < 0) | (F.col("val").bitwiseAND(F.col("mask")) != 0))
        .select("fp", "seg", F.col("val").bitwiseXOR(F.col("mask")).alias("val"))
    )
    crowded = table.groupBy("seg", "val").count().where(F.col("count") > CROWDED).select("seg", "val")
    sparse = table.withColumnRenamed("fp", "b").join(crowded, ["seg", "val"], "left_anti")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    # Spark sizes both sides as if ``explode`` made no rows, and would broadcast probes by the million
    found = probes.withColumnRenamed("fp", "a").hint("merge").join(sparse.hint("merge"), ["seg", "val"]).where((F.col("a") != F.col("b")) & close).select("a", "b")
    dense = probes.join(crowded, ["seg", "val"], "left_semi").select("fp").distinct()
    around = F.explode(F.expr("transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i)))")).alias("key")
    stars = (
        dense.select("fp", around).groupBy("key").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)
        .select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b").distinct()
    )
    return found.union(stars)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: ``(id_col, fingerprint, component_id)``.

    ``fingerprint``: 16 hex digits of the SimHash over shingles of ``shingle`` words (texts with fewer: the whole;
    no words or null: zero, linked like any other). ``component_id``: the smallest id reachable by links of 2
    or fewer differing bits, itself included. Equal fingerprints are collapsed before the search, so a group
    of copies of any size is one entry of it. Repeated rows are returned as often as they come; null ids are
    never the smallest unless alone. An empty table gives an empty result; other columns are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    labels = _labels(rows).select("fp", "component_id")
    return rows.join(labels.hint("merge"), "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _labels(rows: DataFrame) -> DataFrame:
    """``(fp, root, component_id)`` per distinct fingerprint of stored ``(id, fp)`` rows."""
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fps")
    roots = components(near_pairs(fps.select("fp")))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One document of each component, with all its columns: the smallest id; among rows without an id or that share the
    smallest, the one of least hash of all its columns. Rows that are alike count once."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *row_marks(docs))
    marked = materialize(fingerprints(rows, "id", "text", shingle, ("m1", "m2")), "fingerprints")
    labels = _labels(marked.select("id", "fp"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "m1", "m2")
    one = marked.groupBy("fp", "id", "m1", "m2").agg(F.count(F.lit(1)).alias("n")).groupBy("fp").agg(F.min_by("n", first).alias("n"), F.min(first).alias("first"))
    least = one.join(labels.hint("merge"), "fp").groupBy("root").agg(F.min_by("n", "first").alias("n"), F.min("first").alias("first"))
    return unpacked(pick(docs, materialize(least.select("first.m1", "first.m2", "n"), "kept-rows")), docs.columns)
