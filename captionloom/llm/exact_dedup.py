"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ascii_lower, join_frequent, pick, row_marks, unpacked

#: A text: its SHA-256, its length and a second hash. Texts are one only where all three agree.
TEXT = ["digest", "n_bytes", "check"]
#: Rows a run holds at the end, about.
RUN_ROWS = 1 << 20


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *also: Column) -> DataFrame:
    """``(id, digest, n_bytes, check)``: SHA-256, length and XXH64 of the text with A-Z lower-cased; null counts as empty."""
    return docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), *also).select(
        "id", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("check"), *[F.col(c) for c in ("m1", "m2")[: len(also)]])


def rounds_for(n_rows: int, fan_in: int) -> int:
    """Rounds after which a run holds about ``RUN_ROWS`` rows; two at least."""
    rounds = 2
    while fan_in**rounds * RUN_ROWS < n_rows:
        rounds += 1
    return rounds


def merge_runs(rows: DataFrame, rounds: int = 2, fan_in: int = 8, keep: str = "max") -> DataFrame:
    """``(digest, n_bytes, check, keep_id, group_size)`` of ``(id, digest, n_bytes, check)`` rows.

    There are ``fan_in ** rounds`` runs, numbered in base ``fan_in``. At first each holds the rows of some partitions, sorted by
    digest, with equal ones merged. In round r the runs whose numbers differ in digit r alone exchange: each cuts
    itself into ``fan_in`` ranges by the digit r of the digests' own place among all runs, and takes one range of every
    partner. A binomial exchange, for ``fan_in`` of 2. What a run receives is merged in order of the digests: equal
    neighbours become one row with the best id and the sum of their sizes, if length and second hash agree too.
    After the last round a run holds one range of digests, whole. A row crosses the network once a round; a text
    that fills a third of the corpus is one row a run from the start.
    """
    runs = fan_in**rounds
    # an id that is null never wins against others
    known = F.col("id").isNotNull() if keep == "max" else F.col("id").isNull()
    best = F.max if keep == "max" else F.min
    group = ["run", *TEXT]
    # the digest's place among the runs, from its first four bytes
    home = F.floor(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("bigint") * runs / F.lit(float(1 << 32))).cast("int")
    level = rows.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs))).groupBy(*group).agg(
        best(F.struct(known.alias("known"), "id")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    for r in range(rounds):
        digit = fan_in**r
        own = F.floor(F.col("run") / digit) % fan_in
        moved = (F.col("run") + (F.floor(home / digit) % fan_in - own) * digit).cast("int")
        # sorted by the grouping columns, so the merge below is one pass over neighbours (a sort aggregate)
        level = level.withColumn("run", moved).repartition(min(runs, 1 << 14), "run").sortWithinPartitions(*group)
        level = level.groupBy(*group).agg(best("best").alias("best"), F.sum("group_size").alias("group_size"))
    return level.select(*TEXT, F.col("best.id").alias("keep_id"), "group_size")


def _merged(rows: DataFrame, keep: str) -> DataFrame:
    """Stored ``rows`` with ``keep_id`` and ``group_size``."""
    n = rows.count()
    groups = materialize(merge_runs(rows, rounds_for(n, 8), 8, keep), "digest-groups")
    return join_frequent(rows, groups, TEXT, "group_size", n)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per document: ``(id_col, keep_id, group_size, kept, text_sha256)``.

    Equal texts (A-Z lower-cased, null as empty) form a group, of which the row with the largest
    (``keep="min"``: smallest) id stays. Null ids never win against others; in a group of null ids alone
    ``keep_id`` is null and its rows are kept. Rows that repeat an id and its text are one document and
    share the decision; each is counted and returned. An empty table gives an empty result. Columns other
    than the two named are not read. Texts of any length cost their digests.
    """
    rows = materialize(digests(docs, id_col, text_col), "digests")
    return _merged(rows, keep).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The documents that ``exact_dedup`` keeps, with all their columns, one row a group: of rows that share the kept id and
    its text, one stays (the one of least hash of all its columns)."""
    marks = row_marks(docs)
    rows = materialize(digests(docs, id_col, text_col, *marks), "digests")
    kept = _merged(rows, keep).where(F.col("id").eqNullSafe(F.col("keep_id")))
    one = kept.groupBy(*TEXT, "m1", "m2").agg(F.count(F.lit(1)).alias("n"))
    one = one.groupBy(*TEXT).agg(F.min(F.struct("m1", "m2", "n")).alias("one")).select("one.*")
    return unpacked(pick(docs, materialize(one, "kept-rows")), docs.columns)


SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
