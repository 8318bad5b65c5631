"""Incremental work: new chunk files, content-hash cache, pauses in arriving words."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import cached_lookup
from ..session import materialize, path_exists, small_files_session
from ..sources.files import list_files, read_whole, tasks_for
from ..sources.read import CHUNK_FILE, _blocks, parse_srt_blocks


#: Chunk files that a stored list names.
LISTED = 10_000


def stream_chunks(spark: SparkSession, path: str, max_files: int = 100_000, known: str | None = None) -> DataFrame:
    """Cues of chunk files as they appear. The checkpoint of the query is the list of processed chunks.

    Chunk files are small, so a batch takes many: each batch costs a second by itself, and every tenth one writes the list of
    all files so far anew.

    Spark's file stream holds all files' names, states and places on the driver, a kilobyte or two each. Where they may be hundreds
    of thousands, name a folder ``known`` that belongs to the checkpoint: tasks list what is in ``path`` at this call and add what is
    not yet listed to ``known``, and the stream is one of lists, whose files are read by tasks. ``path`` is then a folder of a store
    that Arrow knows, and a later call takes later files.
    """
    if known is not None:
        list_arrivals(spark, path, known)
        rows = spark.readStream.schema(_LISTS).option("maxFilesPerTrigger", max(1, max_files // LISTED)).parquet(known)
        raw = read_whole(rows.repartition(tasks_for(spark))).select(
            F.col("content").cast("string").alias("value"), "path", F.url_decode(F.substring_index("path", "/", -1)).alias("file"))
        return _numbered(raw)
    raw = (small_files_session(spark).readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", max_files)
           .option("recursiveFileLookup", "true").option("pathGlobFilter", "chunk_*").load(path)
           .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file")))
    return _numbered(raw)


_LISTS = "root string, file string"


def list_arrivals(spark: SparkSession, path: str, known: str) -> None:
    """Adds the chunk files below ``path`` that the lists in ``known`` do not have. A file is in one list alone, so what a call that
    was cut off has left is completed by the next."""
    found, there = list_files(spark, [path], "chunk_"), path_exists(spark, known)
    if there:
        found = found.join(spark.read.schema(_LISTS).parquet(known).hint("merge"), ["root", "file"], "left_anti")
    new = materialize(found, "arrivals")
    n = new.count()
    if n or not there:
        new.repartition(-(-n // LISTED) or 1).write.mode("append").parquet(known)


def _numbered(raw: DataFrame) -> DataFrame:
    cues = parse_srt_blocks(_blocks(raw))
    return cues.withColumn("chunk_id", F.regexp_extract("file", CHUNK_FILE, 1).try_cast("int")).filter("chunk_id is not null")


def run_available(cues: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there once and stop; a later call takes only new files."""
    query = cues.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


def stream_cached(
    items: DataFrame, cache_path: str, compute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, days: int = 7,
) -> None:
    """Per micro-batch: take fresh cache rows by key, compute the others and add them to the cache.

    Batches are named by their id, so a repeated batch after a failure replaces its own output; what an earlier
    attempt of the same batch has cached is not read. The cache lies in a folder a day, and only the days that
    can still hold fresh rows are read.
    """
    spark = items.sparkSession
    columns = "key string, value string, modified timestamp, day date, batch bigint"

    def step(batch: DataFrame, batch_id: int) -> None:
        if path_exists(spark, cache_path):
            cache = spark.read.schema(columns).parquet(cache_path)
        else:
            cache = spark.createDataFrame([], columns)
        young = (F.col("day") >= F.date_sub(F.current_date(), days + 1)) & (F.col("batch") != batch_id)
        hits, misses = cached_lookup(batch, cache.filter(young), F.current_timestamp(), days=days)
        today = spark.sql("select current_date()").first()[0]
        fresh = f"{cache_path}/day={today}/batch={batch_id}"
        compute(misses.dropDuplicates(["key"])).select("key", "value", F.current_timestamp().alias("modified")).write.mode(
            "overwrite").parquet(fresh)
        new = misses.join(spark.read.parquet(fresh).select("key", "value"), "key")
        hits.withColumn("hit", F.lit(True)).unionByName(new.withColumn("hit", F.lit(False))).write.mode(
            "overwrite").parquet(f"{out}/batch={batch_id}")

    query = items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_utterances(words: DataFrame, max_gap_ms: int = 3000, lateness: str = "1 minute", keys: Sequence[str] = ("rec_id",)) -> DataFrame:
    """Utterances by pause over words with event time (``ts`` = start time of the word).

    The session gap of a word is its own length plus ``max_gap_ms``, so the pause counts from its end; a
    pause of exactly ``max_gap_ms`` keeps the words together, as in the batch operator. Session windows
    keep sums per session, not words. Words later than the watermark are dropped.
    """
    # sessions merge when they overlap, and touching ones do not: one microsecond makes an exact pause join
    span = (F.col("end_ms") - F.col("start_ms") + max_gap_ms) * 1000 + 1
    session = F.session_window("ts", F.format_string("%d microseconds", span))
    source = words.withWatermark("ts", lateness) if words.isStreaming else words
    return source.groupBy(*keys, session.alias("session")).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_words")).drop("session")
