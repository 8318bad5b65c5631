"""Readers: caption files, transcripts, chunk manifests, glossaries, signals, file catalogs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.captions import srt_stamp_to_ms
from ..functions.text import explode_parts, strip, sub
from ..schema import CHUNK_MANIFEST, GLOSSARY_JSON, TRANSCRIPT
from ..session import small_files_session

_SCHEME = r"^[A-Za-z0-9]+:(//[^/]*)?"
# chunk number from a file name; a prefix test, so ``chunk_1.srt.bak`` counts as well
CHUNK_FILE = r"^chunk_(\d+)\.srt"


def parse_srt_blocks(blocks: DataFrame, text: str = "value") -> DataFrame:
    """Cue blocks (index line, time line, content lines) to columns; a malformed block goes to ``_corrupt``."""
    rows = blocks.withColumn("_l", F.split(sub(F.col(text), r"\A(\s*\n)+|\n+\z", ""), "\n", -1))
    # position of the time line: the second line, or the first where the index is missing
    at = F.when(F.get("_l", F.lit(1)).contains("-->"), 1).when(F.get("_l", F.lit(0)).contains("-->"), 0)
    rows = rows.withColumn("_at", at)
    stamp = F.get("_l", F.col("_at"))
    rows = rows.withColumns({
        "cue_idx": F.when(F.col("_at") == 1, strip(F.get("_l", F.lit(0)))).try_cast("bigint"),
        "start_ms": srt_stamp_to_ms(F.substring_index(stamp, "-->", 1)),
        "end_ms": srt_stamp_to_ms(F.regexp_extract(stamp, r"-->\s*([^\s]+)", 1)),
        "content": F.array_join(F.slice("_l", F.col("_at") + 2, F.size("_l")), "\n"),
    })
    bad = F.col("start_ms").isNull() | F.col("end_ms").isNull()
    return rows.withColumns({
        "_corrupt": F.when(bad, F.col(text)),
        "content": F.when(~bad, F.col("content")),
    }).drop("_l", "_at", text)


# an empty line ends a cue only where the next one starts: an index line or none, and a time line
_NEXT_CUE = r"\n[ \t]*\n\s*(?=(?:[^\n]*\n)?[^\n]*-->)"


def srt_pieces(text: Column) -> Column:
    """The cues of a caption text as texts; a paragraph without a time line belongs to the cue before it."""
    tidy = sub(sub(text, r"\x{feff}|\r(?=\n)", ""), r"\r", "\n")
    return F.filter(F.split(tidy, _NEXT_CUE, -1), lambda p: strip(p) != "")


def _blocks(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.explode(srt_pieces(F.col("value"))))


def _whole_files(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    reader = small_files_session(spark).read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))


def read_srt(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Cues of SRT files: ``path, file, cue_idx, start_ms, end_ms, content, _corrupt``.

    A cue may hold empty lines, so a file is read as one text; the writers here cut long recordings into many.
    Unreadable files are skipped; ``skipped_files`` lists them.
    """
    raw = _whole_files(spark, path, glob)
    return parse_srt_blocks(_blocks(raw)).select("path", "file", "cue_idx", "start_ms", "end_ms", "content", "_corrupt")


def skipped_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files with bytes that ``read_srt`` could not read: ``path, length``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        files = files.option("pathGlobFilter", glob)
    listed = files.load(path).select("path", "length").filter("length > 0")
    got = _whole_files(spark, path, glob).select("path").distinct()
    plain = lambda c: sub(c, r"^file:/+", "/")  # noqa: E731  both readers name the file, with one slash or three
    return listed.join(got.select(plain(F.col("path")).alias("_p")), plain(F.col("path")) == F.col("_p"), "left_anti")


def parse_srt_text(df: DataFrame, text: str) -> DataFrame:
    """Cues of caption texts held in a column (model responses), numbered by ``pos`` from 0 in their order."""
    rows = explode_parts(df, srt_pieces(F.col(text)), "pos", "value")
    return parse_srt_blocks(rows).withColumn("pos", F.col("pos").cast("bigint"))


def discover_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files below ``path`` with the number from the name."""
    files = catalog(spark, path)
    number = F.regexp_extract("file", CHUNK_FILE, 1)
    return files.withColumn("chunk_id", number.try_cast("int")).filter("chunk_id is not null")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all chunk files of a folder, with their chunk number."""
    cues = read_srt(spark, path, "chunk_*")
    return cues.withColumn("chunk_id", F.regexp_extract("file", CHUNK_FILE, 1).try_cast("int")).filter("chunk_id is not null")


def read_transcripts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Nested recognizer results; without ``segments`` the list is empty."""
    reader = spark.read.schema(TRANSCRIPT)
    df = reader.option("mode", "PERMISSIVE").json(path) if fmt == "json" else reader.format(fmt).load(path)
    return df.withColumn("segments", F.coalesce("segments", F.expr("cast(array() as " + TRANSCRIPT["segments"].dataType.simpleString() + ")")))


def read_chunk_timing(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Chunk manifests, a JSON array per file (or JSON lines, as ``write_chunk_timing`` leaves them); the
    folder name is the recording."""
    df = small_files_session(spark).read.option("multiLine", str(not lines).lower()).option("recursiveFileLookup", "true").schema(CHUNK_MANIFEST).json(path)
    return df.select(
        F.element_at(F.split("_metadata.file_path", "/"), -2).alias("recording"),
        F.col("chunk_index").alias("chunk_id"), F.col("start_time_ms").alias("start_ms"),
        F.col("end_time_ms").alias("end_ms"), "duration_ms").filter("chunk_id is not null")


def parse_glossary(df: DataFrame, column: str = "value") -> DataFrame:
    """Glossary JSON texts to ``kind, ord, term, replacement``; terms of ``exact_replace`` are lower-cased.

    A text that is not valid JSON gives no rows. ``ord`` is the place in the file.
    """
    rows = df.withColumn("_g", F.from_json(F.col(column), GLOSSARY_JSON)).drop(column)
    keep = [c for c in rows.columns if c != "_g"]
    parts = [rows.select(*keep, F.lit(kind).alias("kind"), F.posexplode(f"_g.{kind}").alias("ord", "term", "replacement"))
             for kind in ("exact_replace", "pre_translate")]
    exact = parts[0].withColumn("term", F.lower("term"))
    return exact.unionByName(parts[1])


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    return parse_glossary(spark.read.text(path, wholetext=True))


# fixed values: (format tag, bits) of the WAV forms that are read
WAV_FORMS = {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """WAV files to ``path, channel, rate, idx, value``; one file is one bounded task input (WAV sizes are 32-bit),
    samples leave it in Arrow batches.

    PCM of 8, 16, 24 and 32 bits comes in 16-bit units (a full-scale sample is 32768), as do floats of 32 and 64
    bits (1.0 is 32768). A file in another form, or none at all, gives one row with a null ``idx``.
    """
    import numpy as np
    import pandas as pd

    def decode(batches):
        def samples(raw):
            kind, bits = form
            if kind == 3:
                return np.frombuffer(raw, f"<f{bits // 8}").astype("float64") * 32768.0
            if bits == 8:
                return (np.frombuffer(raw, "u1").astype("float64") - 128.0) * 256.0
            if bits == 24:
                three = np.frombuffer(raw, "u1").reshape(-1, 3)
                high = np.zeros((len(three), 4), "u1")
                high[:, 1:] = three
                return high.view("<i4").ravel() / 65536.0
            return np.frombuffer(raw, f"<i{bits // 8}").astype("float64") / 2.0 ** (bits - 16)

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                at, rate, channels, form, known = 12, 0, 1, None, False
                while data[:4] == b"RIFF" and at + 8 <= len(data):
                    tag, size = data[at:at + 4], int.from_bytes(data[at + 4:at + 8], "little")
                    if tag == b"fmt ":
                        kind, channels = (int.from_bytes(data[at + k:at + k + 2], "little") for k in (8, 10))
                        rate = int.from_bytes(data[at + 12:at + 16], "little")
                        if kind == 0xFFFE:  # extensible: the form stands in the extension
                            kind = int.from_bytes(data[at + 32:at + 34], "little")
                        form = (kind, int.from_bytes(data[at + 22:at + 24], "little"))
                    elif tag == b"data" and form in WAV_FORMS and channels:
                        known, width = True, form[1] // 8
                        n = min(size, len(data) - at - 8) // width
                        for first in range(0, n, 500_000 * channels):
                            count = min(500_000 * channels, n - first)
                            k = np.arange(first, first + count)
                            raw = data[at + 8 + first * width:at + 8 + (first + count) * width]
                            yield pd.DataFrame({
                                "path": name, "channel": (k % channels).astype("int32"), "rate": rate,
                                "idx": k // channels, "value": samples(raw)})
                    at += 8 + size + (size & 1)
                if not known:
                    yield pd.DataFrame({"path": [name], "channel": pd.array([None], "Int32"), "rate": [rate],
                                        "idx": pd.array([None], "Int64"), "value": [np.nan]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, channel int, rate int, idx bigint, value double")


def catalog(spark: SparkSession, root: str, glob: str = "*.srt*") -> DataFrame:
    """Caption files below ``root/<project>[/<subfolder>]`` with size and change time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    # scheme and authority aside, the path below the root
    base = sub(F.col("path"), _SCHEME, "")
    below = len(re.sub(_SCHEME, "", root).rstrip("/")) + 2
    inner = F.split(F.substr(base, F.lit(below)), "/", -1)
    return files.select(
        "path", "length", "modificationTime",
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.when(F.size(inner) > 1, F.get(inner, F.lit(0))).alias("project"),
        F.when(F.size(inner) > 2, F.get(inner, F.size(inner) - 2)).otherwise("original").alias("subfolder"))


def subfolders(files: DataFrame) -> DataFrame:
    """Sub-folders that hold chunk files, ``original`` first."""
    return files.filter(F.col("file").rlike(r"^chunk_.*\.srt$")).select("project", "subfolder").distinct().orderBy(
        "project", F.col("subfolder") != "original", "subfolder")


def choose_sources(files: DataFrame, mode: str) -> DataFrame:
    """Files to translate: ``api`` takes merged files if the project has any, else chunks; ``local`` takes both."""
    merged, chunk = F.col("file").rlike(r"_merged\.srt$"), F.col("file").rlike(r"^chunk_.*\.srt$")
    rows = files.filter((merged | chunk) & (F.col("subfolder") == "original")).withColumn("is_merged", merged)
    if mode == "local":
        return rows
    whole = rows.filter("is_merged").select("project").distinct()
    return rows.filter("is_merged").unionByName(rows.filter("not is_merged").join(whole, "project", "left_anti"))
