"""A result cache for streams: a folder a day, filtered by key, compacted, and expired by dropping days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import cached_lookup
from ..session import new_shared_path

COLUMNS = "key string, value string, modified timestamp, batch bigint"
#: Keys of a batch that are handed to the files' key filters one by one; larger batches meet the cache by a join alone.
ASKED = 1000


class ResultCache:
    """Results by key under ``path``: ``day=<date>/<first batch>-<last batch>[-<n>]`` folders of Parquet files.

    *Reading.* Only the days that can hold fresh rows are read. Files carry a Bloom filter of their keys, so a batch of few
    keys skips the files that hold none of them. *Writing.* A batch writes one folder named by its id; repeated after a
    failure, it replaces its own, and what it had cached before is not read by it. *Compaction.* A day of more than
    ``max_parts`` folders is written anew as one, which names the batches it covers; folders it covers count no more
    and are removed, also by a later call if this one is cut off. So files stay bounded however many batches come.
    *Expiry.* Days that can hold no fresh row are removed as a whole.

    One stream writes to a cache; any number may read it.
    """

    def __init__(self, spark: SparkSession, path: str, days: int = 7, max_parts: int = 8):
        self.spark, self.path, self.days, self.max_parts = spark, path.rstrip("/"), days, max_parts
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folders(self, at: str) -> list[str]:
        where = self._path(at)
        if not self._store.exists(where):
            return []
        return sorted(f.getPath().getName() for f in self._store.listStatus(where) if f.isDirectory() and not f.getPath().getName().startswith("_"))

    def _remove(self, at: str) -> None:
        self._store.delete(self._path(at), True)

    def days_held(self) -> list[str]:
        return [d.removeprefix("day=") for d in self._folders(self.path) if d.startswith("day=")]

    def parts(self, day: str, clean: bool = False) -> list[str]:
        """The folders of a day that count: those that no finished folder of more batches covers."""
        found = {}
        for name in self._folders(f"{self.path}/day={day}"):
            lo, hi = (int(x) for x in name.split("-")[:2])
            if self._store.exists(self._path(f"{self.path}/day={day}/{name}/_SUCCESS")):
                found[name] = (lo, hi)
        live = [n for n, (a, b) in found.items() if not any(c <= a and b <= d and (d - c > b - a) for m, (c, d) in found.items() if m != n)]
        if clean:
            for name in set(found) - set(live):
                self._remove(f"{self.path}/day={day}/{name}")
        return live

    def read(self, batch: int | None = None) -> DataFrame:
        """All rows of the days that count, but for those of ``batch``."""
        today = self.spark.sql("select current_date()").first()[0]
        oldest = str(today - dt.timedelta(days=self.days + 1))
        paths = [f"{self.path}/day={d}/{p}" for d in self.days_held() if d >= oldest for p in self.parts(d)]
        if not paths:
            return self.spark.createDataFrame([], COLUMNS)
        rows = self.spark.read.schema(COLUMNS).parquet(*paths)
        return rows if batch is None else rows.where(F.col("batch") != batch)

    def add(self, rows: DataFrame, batch: int, name: str | None = None, day: str | None = None) -> str:
        """Writes ``(key, value, modified, batch)`` rows as one folder; returns its path."""
        day = day or str(self.spark.sql("select current_date()").first()[0])
        at = f"{self.path}/day={day}/{name or f'{batch}-{batch}'}"
        rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").option(
            "parquet.bloom.filter.expected.ndv#key", "1000000").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(at)
        return at

    def compact(self) -> None:
        """Days of many folders become days of one; days out of date go."""
        today = self.spark.sql("select current_date()").first()[0]
        oldest = str(today - dt.timedelta(days=self.days + 1))
        for day in self.days_held():
            if day < oldest:
                self._remove(f"{self.path}/day={day}")
                continue
            live = self.parts(day, clean=True)
            if len(live) <= self.max_parts:
                continue
            spans = [[int(x) for x in n.split("-")[:2]] for n in live]
            rows = self.spark.read.schema(COLUMNS).parquet(*[f"{self.path}/day={day}/{n}" for n in live])
            youngest = F.max(F.struct("modified", "value", "batch")).alias("y")  # of a key, its youngest row
            rows = rows.groupBy("key").agg(youngest).select("key", "y.value", "y.modified", "y.batch")
            lo, hi = min(a for a, _ in spans), max(b for _, b in spans)
            self.add(rows, hi, f"{lo}-{hi}", day)
            self.parts(day, clean=True)

    def lookup(self, batch: DataFrame, batch_id: int | None = None) -> tuple[DataFrame, DataFrame]:
        """``(hits, misses)`` of a batch with a column ``key``."""
        cache = self.read(batch_id)
        asked = [r[0] for r in batch.select("key").distinct().limit(ASKED + 1).collect()]
        if len(asked) <= ASKED:
            cache = cache.where(F.col("key").isin(asked))
        return cached_lookup(batch, cache, F.current_timestamp(), days=self.days)


def cached_step(cache: ResultCache, compute: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """What a stream does with each batch: fresh results from the cache, the others computed once a key and added to it; the
    batch's rows, with ``value`` and ``hit``, go to ``<out>/batch=<id>``. A repeated batch writes the same again."""

    def step(batch: DataFrame, batch_id: int) -> None:
        held = f"{new_shared_path(cache.spark, 'batch')}"
        batch.write.parquet(held)  # the batch is read several times
        rows = cache.spark.read.schema(batch.schema).parquet(held)
        hits, misses = cache.lookup(rows, batch_id)
        new = compute(misses.select("key").distinct()).select(
            "key", "value", F.current_timestamp().alias("modified"), F.lit(batch_id).cast("bigint").alias("batch"))
        fresh = cache.spark.read.schema(COLUMNS).parquet(cache.add(new, batch_id))
        done = misses.join(fresh.select("key", "value"), "key").withColumn("hit", F.lit(False))
        hits.withColumn("hit", F.lit(True)).unionByName(done).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        cache.compact()

    return step


def run_cached(items: DataFrame, cache: ResultCache, compute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Takes what is new in the stream ``items`` (with a column ``key``) through the cache and stops; goes on from ``checkpoint``."""
    query = items.writeStream.foreachBatch(cached_step(cache, compute, out)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
