"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, pick, row_marks, unpacked

#: Hash cells of a source and size, and copies of a row that are made at a time.
SALTS, BLOCK = 1024, 65_536


def _hash_unit(text, bits: int = 48):
    """0 <= x < 1 from the first hex digits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("bigint") / F.lit(float(1 << bits))


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.0, cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """Per source ``(no_source, src, source_size, target, rate, shift)`` from ``(no_source, src, n, size)`` rows.

    Weights go round the sources by code point, the null source last. Targets share ``share`` of all words by
    weight, none above ``cap`` times its source: with sources in order of cap over weight, the first
    whose fair share of what is left stays under its cap sets the share of all that follow. One row per source
    meets in the ordering, never a document.
    """
    per = sizes.groupBy("no_source", "src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("k"), F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy("no_source", "src")
    per = per.withColumn("k", F.row_number().over(order) - 1).withColumn("w", w).withColumn("top", F.lit(cap) * F.col("source_size"))
    line = Window.orderBy(F.col("top") / F.col("w"), "k")
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("all_size", F.lit(float(share)) * F.sum("source_size").over(every)).withColumn(
        "level", (F.col("all_size") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ).withColumn("place", F.row_number().over(line))
    fair = F.when(F.col("level") * F.col("w") <= F.col("top"), F.struct("place", "level"))
    per = per.withColumn("fair", F.min(fair).over(every)["level"])
    target = F.least(F.col("top"), F.coalesce(F.col("fair") * F.col("w"), F.col("top")))
    return per.withColumn("target", target).select(
        "no_source", "src", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        _hash_unit(F.concat(F.lit(seed), F.col("no_source").cast("string"), F.col("src"))).alias("shift"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1),
        share: float = 1.0, cap: float = 3.0, seed: str = "mix", also: tuple[str, ...] = ()) -> DataFrame:
    """Per document ``(id_col, source_col, size, source_size, target, copies, taken)``.

    All documents of a source have the same expected number of copies, its target over its size. They are put in
    order of size, the expectations are summed up along it, one offset per source is added, and a document
    is taken once for every whole number its step crosses. In order of size, the words taken miss the target by
    less than twice the longest document of the source. The order is (size, hash of the id, id); counts by
    (source, size, hash cell) give each cell its place, so only a cell of about 1/1024 of the documents of
    one source and size is ranked in one task. Everything follows from the data and the seed: reruns agree.

    Null texts have size 0 and are taken or not like others; a null source is a source of its own, last in order.
    Rows that repeat are documents of their own. With no words at all every target is 0. An empty table gives
    an empty result. Columns other than those named are not read; ``also`` names columns that are passed on.
    A cell is one hash value of the documents of one source and size: where a source has n documents of one
    size, about n / 1024 of them are ranked in one task; the sources themselves, one row each, in one.
    """
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint"), F.lit(SALTS)).alias("salt"), *also,
    ), "sizes")
    cells = rows.groupBy("no_source", "src", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy("no_source", "src", "size").agg(F.sum("n").alias("n"))
    per = targets(sizes, weights, share, cap, seed)
    here = Window.partitionBy("no_source", "src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(here), F.lit(0))).drop("n").join(per, ["no_source", "src"])
    inner = Window.partitionBy("no_source", "src", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("skip", F.coalesce(F.sum("n").over(inner), F.lit(0))).drop("n").join(starts, ["no_source", "src", "size"])
    cell = Window.partitionBy("no_source", "src", "size", "salt").orderBy("id")
    at = F.col("start") + F.col("skip") + F.row_number().over(cell)
    ranked = rows.join(placed.hint("merge"), ["no_source", "src", "size", "salt"]).withColumn("at", at)
    crossed = F.floor(F.col("at") * F.col("rate") + F.col("shift")) - F.floor((F.col("at") - 1) * F.col("rate") + F.col("shift"))
    return ranked.withColumn("copies", crossed.cast("bigint")).select(
        F.col("id").alias(id_col), F.when(~F.col("no_source"), F.col("src")).alias(source_col), "size",
        F.col("source_size").cast("bigint").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *also,
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns. Rows that share an id are documents of their
    own; rows alike in every column are taken together, as often as all of them are."""
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), *row_marks(docs))
    each = mix(marked, "id", "text", "source", also=("m1", "m2"), **params)
    most = each.groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"))
    taken = pick(docs, materialize(most.where("copies > 0"), "taken"), ("copies",))
    # in blocks, as rows that are alike may be taken any number of times together
    blocks = taken.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {BLOCK}"))))
    left = F.least(F.lit(BLOCK), F.col("copies") - F.col("block") * BLOCK).cast("int")
    return unpacked(blocks.select("row", F.explode(F.sequence(F.lit(1), left)).alias("copy")), docs.columns)


SQL = """
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 1024 AS salt
  FROM documents
), s AS (
  SELECT no_source, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL
), k AS (
  SELECT *, row_number() OVER (ORDER BY no_source, src) - 1 AS k FROM s
), w AS (
  SELECT *, CAST([5, 2, 1][1 + k % 3] AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS top FROM k
), l AS (
  SELECT *, row_number() OVER (ORDER BY top / w, k) AS place,
    ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - coalesce(sum(top) OVER (ORDER BY top / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY top / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), f AS (
  SELECT level AS fair FROM l WHERE level * w <= top ORDER BY place LIMIT 1
), g AS (
  SELECT no_source, src, source_size, least(top, coalesce((SELECT fair FROM f) * w, top)) AS target,
    CAST('0x' || substr(md5('mix' || CAST(no_source AS VARCHAR) || src), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS shift
  FROM l
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate, g.shift,
    row_number() OVER (PARTITION BY d.no_source, d.src ORDER BY d.size, d.salt, d.doc_id) AS pos
  FROM d JOIN g ON d.no_source = g.no_source AND d.src = g.src
), c AS (
  SELECT *, CAST(floor(pos * rate + shift) - floor((pos - 1) * rate + shift) AS BIGINT) AS copies FROM r
)
SELECT doc_id, size, source_size, target, copies * size AS taken FROM c
"""
