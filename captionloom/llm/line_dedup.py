"""Lines that many documents share: exploded, hashed, counted per distinct document, dropped by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ascii_lower, join_frequent

#: ASCII white space, which is stripped from a line's ends: [\x20\x09-\x0D].
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _row_mark(id_col: str, text: Column) -> list[Column]:
    """Two hashes that stand for (id, text), so that rows need no unique id."""
    i, none = F.col(id_col), F.col(id_col).isNull()
    return [F.xxhash64(none, i, text).alias("__row1"), F.xxhash64(text, F.lit(1), i, none).alias("__row2")]


def long_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """``(__row1, __row2, id, pos, key1, key2)`` of every line whose key has ``min_chars`` code points or more.

    The key is two 64-bit hashes of the normalised line: 128 bits, so that chance never makes two lines one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(*_row_mark(id_col, text), F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = each.where(F.octet_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keyed.select("__row1", "__row2", "id", "pos", F.xxhash64("key").alias("key1"), F.xxhash64(F.lit(1), "key").alias("key2"))


def repeated_lines(lines: DataFrame, min_docs: int = 5) -> DataFrame:
    """``(key1, key2, n_lines, keep_id)`` of keys that at least ``min_docs`` distinct documents hold.

    Lines are first added up by (key, document), then by key, both before and after the shuffle, so a line that
    a third of all documents share reaches its key's task as one row from each task.
    """
    per_doc = lines.groupBy("key1", "key2", "id").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_doc.groupBy("key1", "key2").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_lines"), F.max("id").alias("keep_id"))
    return per_key.where(F.col("n_docs") >= min_docs).drop("n_docs")


def dropped_positions(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """``(__row1, __row2, gone array<int>)``: the positions of the lines each row loses.

    Few keys can hold a large share of all lines; those are broadcast, the others meet their lines in a shuffle.
    """
    keyed = join_frequent(lines, repeated, ["key1", "key2"], "n_lines", lines.count())
    lost = keyed.where(~F.col("id").eqNullSafe(F.col("keep_id")))
    return lost.groupBy("__row1", "__row2").agg(F.collect_set("pos").alias("gone"))


def _without(text: Column, gone: Column) -> Column:
    """A text without the lines at the positions ``gone``: the runs of lines between them, each line copied once."""

    def kept(v: Column) -> Column:
        lines, at = v["lines"], v["at"]
        starts = F.concat(F.array(F.lit(-1)), at)
        ends = F.concat(at, F.array(F.size(lines)))
        runs = F.zip_with(starts, ends, lambda a, b: F.when(b - a > 1, F.array_join(F.slice(lines, a + 2, F.greatest(b - a - 1, F.lit(0))), "\n")))
        return F.array_join(runs, "\n")  # leaves out the runs without a line

    held = F.struct(F.split(text, "\n", -1).alias("lines"), F.array_sort(gone).alias("at"))
    return F.get(F.transform(F.array(held), kept), F.lit(0))


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with three columns more: ``__kept`` (the text that stays, null texts as empty), ``__n_lines``, ``__n_dropped``."""
    lines = materialize(long_lines(docs, id_col, text_col, min_chars), "lines")
    repeated = materialize(repeated_lines(lines, min_docs), "repeated-lines")
    gone = dropped_positions(lines, repeated)
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select("*", *_row_mark(id_col, text)).join(gone, ["__row1", "__row2"], "left")
    return marked.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col("gone").isNull(), text).otherwise(_without(text, F.col("gone"))).alias("__kept"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("__n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("__n_dropped"),
    )


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per document: ``(id_col, n_lines, n_dropped, kept_sha256)``.

    A text is split at line feeds; null and empty texts are one empty line. A line's key is the line without ASCII
    white space at its ends, A-Z lower-cased. Lines whose key has ``min_chars`` code points or more and
    occurs in ``min_docs`` or more documents stay only in the document of the largest id that holds it, there as
    often as they come; all others stay. Documents are told apart by id: rows that share an id count as one document
    and each keeps its lines if the id is the largest; rows without an id count as one document too, the smallest. Rows
    come out as often as they come in, an empty table gives an empty result, and columns other than the two
    named are not read. What a task holds of one document is its lines, however long the text.
    """
    return without_lines(_named(docs, id_col, text_col), "id", "text", min_chars, min_docs).select(
        F.col("id").alias(id_col), F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with what ``line_dedup`` leaves of their texts in ``text_col``; null texts stay null, all other columns
    as they are, whatever their names."""
    rest = [c for c in docs.columns if c != text_col]
    packed = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("rest"))
    kept = without_lines(packed, "id", "text", min_chars, min_docs)
    columns = {c: F.col(f"rest.c{i}") for i, c in enumerate(rest)} | {text_col: F.when(F.col("text").isNotNull(), F.col("__kept"))}
    return kept.select(*[columns[c].alias(c) for c in docs.columns])


SQL = """
WITH l AS (
  SELECT doc_id, u.line, u.pos FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(line, pos)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), d AS (
  SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.doc_id, k.pos, k.line, d.key IS NULL OR d.keep_id = k.doc_id AS stays FROM k LEFT JOIN d ON k.key = d.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (NOT stays) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
