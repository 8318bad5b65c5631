"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Texts of ASCII alone take the faster built-in, which gives the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_crc(id_col: str, modulus: int) -> Column:
    """Remainder of the CRC-32 of the id's decimal text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def join_frequent(rows: DataFrame, table: DataFrame, keys: list[str], n_col: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and in ``n_col`` how many rows have that key.

    Of ``total`` rows, at most ``share`` keys can hold more than a ``share``-th each, whatever the input; these few rows
    of the table are broadcast. No other key is large, so the rest meets in a shuffle. Reads both sides twice: give
    it stored tables.
    """
    frequent = F.col(n_col) * share > F.lit(total)
    few = F.broadcast(table.where(frequent))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(table.where(~frequent), keys)
    return rows.join(few, keys).unionByName(rest)


def row_marks(df: DataFrame, marks: tuple[str, str] = ("m1", "m2")) -> list[Column]:
    """Two hashes of a whole row, 128 bits in all, which stand for it where rows have no key; maps are left out."""
    parts = [F.col(f"`{f.name}`") for f in df.schema.fields if not f.dataType.simpleString().startswith("map")]
    nulls = [c.isNull() for c in parts]
    return [F.xxhash64(*nulls, *parts).alias(marks[0]), F.xxhash64(*parts, F.lit(1), *nulls).alias(marks[1])]


def packed(df: DataFrame) -> DataFrame:
    """``(m1, m2, row)``: the marks of each row and all its columns in one, so that none of their names can clash."""
    return df.select(*row_marks(df), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)])


def pick(df: DataFrame, chosen: DataFrame, extra: tuple[str, ...] = (), few: int = 100_000) -> DataFrame:
    """``(row, *extra)``: one row of ``df`` for each of the marks ``chosen`` (``m1, m2, n, *extra``), of which ``df`` holds
    ``n`` rows that are alike. Rows that occur once only meet their mark. The others are first reduced to one, in each
    task and after the shuffle, so that copies of a row never gather; their marks are counted, and broadcast if there
    are ``few`` at most. ``chosen`` must be a stored table."""
    rows, marks = packed(df), ["m1", "m2"]
    # Spark takes a stored table for as large as its files, which are a tenth of it in memory, and may broadcast it
    once = rows.join(chosen.where("n = 1").select(*marks, *extra).hint("merge"), marks).select("row", *extra)
    more = chosen.where("n > 1").select(*marks, *extra)
    n_more = more.limit(few + 1).count()
    if not n_more:
        return once
    more = F.broadcast(more) if n_more <= few else more
    alike = rows.join(more.select(*marks), marks, "left_semi").groupBy(*marks).agg(F.first("row").alias("row"))
    return once.unionByName(alike.join(more, marks).select("row", *extra))


def slices(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece holds about ``max_bytes`` of text, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        piece = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield batch.slice(lo, hi - lo)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts, null as empty."""
    return [t or "" for t in column(batch, name).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of unsigned 64-bit numbers that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
