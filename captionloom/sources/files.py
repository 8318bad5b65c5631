"""Caption files that a player opens: one whole file per recording, put in place when the job has succeeded."""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.scan import with_rank
from .ranges import store_of
from .write import HEADS, render, srt_cues

#: What stands before the first block of a file, between blocks and after the last.
FRAMES = {"srt": ("", "", ""), "txt": ("", "", ""), "vtt": (HEADS["vtt"], "", ""), "ass": (HEADS["ass"], "", ""), "json": ("[\n", ",\n", "\n]"),
          "lines": ("", "", "")}
BUFFER = 1 << 20
#: Files the driver moves at a time, and files it knows by name at a time.
MOVERS, KNOWN = 16, 10_000


@dataclass
class Written(WriterCommitMessage):
    """Where a task has listed the files it has finished. The driver gets no names, as files may be millions."""

    lists: list[str]


class FileWriter(DataSourceArrowWriter):
    """Rows ``(file, block)``, a file's rows together and in order, to one file each.

    A task writes below ``_writing-<job>/<attempt>``, a folder that no other attempt knows, lists its files there and reports
    the list only at its end. The driver then moves the listed files to their names and removes the folder: files of failed or
    repeated attempts were never reported and go with it. A file is a stream through its task, whatever its length; of all
    files together the driver holds 8 bytes each.
    """

    def __init__(self, path: str, fmt: str, folders: bool = False):
        self.path, self.fmt, self.folders = path, fmt, folders
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = store_of(self.path)
        folder = f"{base}/{self.job}/{uuid.uuid4().hex}"
        head, between, tail = FRAMES[self.fmt]
        seen, names, name, out, parts, size = set(), None, None, None, [], 0

        def put(last: bool) -> None:
            nonlocal parts, size
            if out is not None:
                out.write("".join(parts).encode("utf-8"))
                parts, size = [], 0
                if last:
                    out.write(tail.encode("utf-8"))
                    out.close()

        for batch in iterator:
            for file, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if file != name:
                    put(True)
                    if file in seen:
                        raise ValueError(f"rows of {file} are not together")
                    if names is None:
                        store.create_dir(folder)
                        names = store.open_output_stream(f"{folder}/list")
                    name, at = file, f"{folder}/{len(seen)}"
                    seen.add(file)
                    out = store.open_output_stream(at)
                    names.write(json.dumps([at, file]).encode() + b"\n")
                    parts.append(head)
                else:
                    parts.append(between)
                parts.append(block)
                size += len(block)
                if size > BUFFER:
                    put(False)
        put(True)
        if names is None:
            return Written([])
        names.close()
        return Written([f"{folder}/list"])

    def listed(self, messages: list[Written | None]) -> Iterator[list[tuple[str, str]]]:
        """``(where it lies, its name)`` of the reported files, some at a time."""
        store, _ = store_of(self.path)

        def lines() -> Iterator[tuple[str, str]]:
            for each in messages:
                for at in each.lists if each else []:
                    with io.TextIOWrapper(store.open_input_file(at), "utf-8", newline="\n") as f:
                        yield from (tuple(json.loads(line)) for line in f)

        return map(list, batched(lines(), KNOWN))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = store_of(self.path)
        marks = [np.fromiter((xxhash.xxh64_intdigest(file) for _, file in some), np.uint64, len(some)) for some in self.listed(messages)]
        marks = np.sort(np.concatenate([np.zeros(0, np.uint64), *marks]))
        twice = set(marks[1:][marks[1:] == marks[:-1]].tolist())
        del marks
        if twice:  # names, or two that share a hash
            names = [file for some in self.listed(messages) for _, file in some if xxhash.xxh64_intdigest(file) in twice]
            if len(set(names)) < len(names):
                self.abort(messages)
                raise ValueError("a file was written by several tasks")
        folders = lambda some: sorted({f"{base}/{file}".rsplit("/", 1)[0] for _, file in some})
        old = self.folders and store.get_file_info(base).type != fs.FileType.NotFound
        store.create_dir(base)
        with ThreadPoolExecutor(MOVERS) as pool:  # a store answers many requests at a time
            for some in self.listed(messages) if old else []:  # before a file is moved: others may come to its folder
                there = [f.path for f in store.get_file_info(folders(some)) if f.type != fs.FileType.NotFound]
                for _ in pool.map(store.delete_dir, there):
                    pass
            for some in self.listed(messages):
                for _ in pool.map(store.create_dir, folders(some)):
                    pass
                for _ in pool.map(lambda move: store.move(move[0], f"{base}/{move[1]}"), some):
                    pass
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = store_of(self.path)
        folder = f"{base}/{self.job}"
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class CaptionFiles(DataSource):
    """Sink ``caption_files``: options ``path``, ``format``, and ``folders``: a file's folder is replaced as a whole."""

    @classmethod
    def name(cls) -> str:
        return "caption_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], self.options.get("format", "srt"), self.options.get("folders") == "true")


def write_files(cues: DataFrame, path: str, file: Column, fmt: str = "srt", keys: Sequence[str] = ("rec_id",),
                order: Sequence[str] = ("chunk_id", "cue_idx"), **kw) -> None:
    """One file per recording (or per chunk, with ``keys`` to match) below ``path``, named by the column ``file``.

    SRT cues are filtered, sorted by start and numbered; other formats keep the given order. Rows are dealt by recording and
    sorted within tasks, so a recording streams through one task into its file, head, separators and end
    included. Files of the same name are replaced, all others stay; if the job fails, nothing changes. Recordings that
    share a name share its file, one after another. No setting of the session is changed.
    """
    keys, order = list(keys), list(order)
    if fmt == "srt":
        rows, rank = srt_cues(cues, keys, order, **kw), "index"
    else:
        rows, rank = with_rank(cues, keys, order, "_rank", **kw), "_rank"
    named = render(rows, fmt, rank).select(file.alias("file"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(rank).alias("_r"), "block")
    named = named.repartition("file").sortWithinPartitions("file", *[f"_k{i}" for i in range(len(keys))], "_r")
    cues.sparkSession.dataSource.register(CaptionFiles)
    named.select("file", "block").write.format("caption_files").option("format", fmt).mode("append").save(path)


def _parts(path: str) -> tuple[str, str]:
    """A path as Arrow's store and as Spark name it."""
    base = store_of(path)[1].rstrip("/")
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) and not path.startswith("file:"):
        return base, path.rstrip("/")
    return base, f"file:{base}"


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def list_files(spark: SparkSession, paths: Sequence[str], prefix: str = "") -> DataFrame:
    """``(root, file)``: files at any depth below the folders ``paths`` whose names begin with ``prefix``, by their names below
    ``root``; hidden ones are left out, and so is a folder that is not there.

    Tasks list the files, and none of their names comes to the driver: the entries of each of ``paths`` are listed by one task,
    then the folders among them are dealt out, each to be listed whole by one task.
    """
    from pyarrow import fs

    def listed(root: str, inner: str, recursive: bool) -> Iterator[tuple[str, bool]]:
        store, base = store_of(root)
        base = base.rstrip("/")
        for f in store.get_file_info(fs.FileSelector(f"{base}/{inner}".rstrip("/"), recursive=recursive, allow_not_found=True)):
            name = f.path[len(base) + 1:]
            if not any(map(_hidden, name.split("/"))):
                yield name, f.type == fs.FileType.Directory

    def rows(found: Iterable[tuple[str, str, bool]]) -> Iterator[pa.RecordBatch]:
        for some in batched(found, KNOWN):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some, strict=True)], ["root", "name", "folder"])

    def top(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows((root, *f) for b in batches for root in b.column(0).to_pylist() for f in listed(root, "", False))

    def below(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (x.values() for b in batches for x in b.to_pylist())
        return rows((root, *f) for root, name, folder in each for f in (listed(root, name, True) if folder else [(name, False)]))

    n = tasks_for(spark)
    roots = spark.createDataFrame([(_parts(p)[1],) for p in paths], "root string").repartition(min(n, len(paths)))
    found = roots.mapInArrow(top, "root string, name string, folder boolean").repartition(n)
    found = found.mapInArrow(below, "root string, name string, folder boolean")
    begins = F.substring_index("name", "/", -1).startswith(prefix)
    return found.where(~F.col("folder") & begins).select("root", F.col("name").alias("file"))


def tasks_for(spark: SparkSession) -> int:
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_whole(found: DataFrame) -> DataFrame:
    """``(path, content)`` of the files ``(root, file)`` of ``list_files``: their bytes whole, and paths as Spark's file stream gives them.
    A task reads file after file."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, texts, size, stores = [], [], 0, {}
        made = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["path", "content"])
        for batch in batches:
            for root, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if root not in stores:
                    stores[root] = store_of(root)[0], *_parts(root)
                store, base, uri = stores[root]
                with store.open_input_file(f"{base}/{file}") as f:
                    text = f.read()
                if paths and size + len(text) > BUFFER:
                    yield made()
                    paths, texts, size = [], [], 0
                paths.append(re.sub(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]', lambda m: f"%{ord(m[0]):02X}", f"{uri}/{file}"))
                texts.append(text)
                size += len(text)
        if paths:
            yield made()

    return found.select("root", "file").mapInArrow(read, "path string, content binary")


def can_write_folders(rows: DataFrame, path: str, keys: Sequence[str]) -> bool:
    """Whether ``write_folders`` can take the rows: integer keys, and a store that Arrow knows."""
    kinds = dict(rows.dtypes)
    try:
        store_of(path)
    except (ValueError, OSError, NotImplementedError):
        return False
    return all(kinds[k] in ("tinyint", "smallint", "int", "bigint") for k in keys)


def write_folders(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], text: Column, suffix: str = ".txt",
                  part: Column | None = None) -> None:
    """A folder ``key=value/..`` for each group below ``path``, as ``partitionBy`` names them, with one file of the group's
    ``text`` values in order, a line end after each, or one for each number ``part``. Folders that get rows are replaced, the others stay.

    For groups that are many and small: Spark's own writer opens each file with a checksum file beside it, sets their rights by a
    command of the system where Hadoop's native library is missing, and the driver renames folder after folder.
    """
    value = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    parts = [F.concat(F.lit(f"{k}="), value(k)) for k in keys]
    named = rows.select(F.concat(F.concat_ws("/", *parts), F.format_string(f"/part-%05d{suffix}", F.lit(0) if part is None else part)).alias("file"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                        F.concat(F.coalesce(text, F.lit("")), F.lit("\n")).alias("block"))
    named = named.repartition("file").sortWithinPartitions("file", *[f"_o{i}" for i in range(len(order))])
    rows.sparkSession.dataSource.register(CaptionFiles)
    named.select("file", "block").write.format("caption_files").option("format", "lines").option("folders", "true").mode("append").save(path)
