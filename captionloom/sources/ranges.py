"""Readers that cut files into byte ranges: caption texts at cue borders, WAV data at sample borders."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .read import WAV_FORMS, parse_srt_blocks

#: Bytes of a range, and bytes read at a time.
RANGE_BYTES, STEP = 64 << 20, 1 << 20
#: Ranges that are a task each; more ranges are dealt in runs, until a task has so many bytes, a range counting ``OPEN_BYTES`` more.
TASKS, TASK_BYTES, OPEN_BYTES = 256, 32 << 20, 32 << 10
_BLANK = rb"(?:[ \t\n\x0b\x0c\r]|\xef\xbb\xbf)"
_LINE_END = rb"(?:\r\n|\r(?!\n)|\n)"
# an empty line, other blanks, and then a cue: an index line or none, and a time line
_CUT = re.compile(_LINE_END + rb"(?:[ \t]|\xef\xbb\xbf)*" + _LINE_END + _BLANK + rb"*(?=(?:[^\r\n]*" + _LINE_END + rb")?[^\r\n]*-->)")


def _before_blanks(data: bytes, low: int, end: int) -> int:
    """Where the blanks that end at ``end`` begin, not before ``low``."""
    while end > low:
        if data[end - 1] in b" \t\n\x0b\x0c\r":
            end -= 1
        elif end - 3 >= low and data[end - 3 : end] == b"\xef\xbb\xbf":
            end -= 3
        else:
            break
    return end


def store_of(path: str):
    """The file system of a path and the path within it: local, HDFS and the object stores that Arrow knows."""
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else os.path.abspath(path)


def files_below(path: str, suffix: str) -> list[tuple[str, int]]:
    """``(path, size)`` of the files at or below ``path`` whose names end in ``suffix``; names starting with ``_`` or ``.`` are left out."""
    from pyarrow import fs

    store, base = store_of(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((f.path, f.size) for f in found
                  if f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._")


class Span(InputPartition):
    """Bytes ``low`` to ``high`` of a file."""

    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


class Spans(InputPartition):
    """What one task reads: ``(file, low, high, step)``, ranges of ``step`` bytes that follow one another in a file."""

    def __init__(self, runs: list[tuple[str, int, int, int]]):
        self.runs = runs

    def __iter__(self) -> Iterator[Span]:
        for file, low, high, step in self.runs:
            for lo in range(low, max(high, low + 1), step):
                yield Span(file, lo, min(lo + step, high))


def dealt(runs: list[tuple[str, int, int, int]]) -> list[Spans]:
    """Runs of ranges as tasks: few small ranges are a task each, many share one, so that tasks grow with the bytes and not
    with the number of files and ranges."""
    count = lambda low, high, step: max(1, -(-(high - low) // step))
    n = sum(count(*run[1:]) for run in runs)
    cost = n * OPEN_BYTES + sum(high - low for _, low, high, _ in runs)
    limit = min(TASK_BYTES, cost / TASKS) if n > TASKS else 0
    out: list[Spans] = []
    held, size = [], 0.0
    for file, low, high, step in runs:
        while True:
            each = min(step, high - low) + OPEN_BYTES
            take = min(count(low, high, step), max(1, int((limit - size) // each)))
            if held and size + each > limit:
                out.append(Spans(held))
                held, size = [], 0.0
                continue
            end = min(high, low + take * step)
            held.append((file, low, end, step))
            size += take * each
            low = end
            if low >= high:
                break
    return out + [Spans(held)] if held else out


def cues_of_range(f, low: int, high: int, step: int = STEP) -> Iterator[tuple[int, bytes]]:
    """``(offset, bytes)`` of the caption blocks that start in bytes ``low`` to ``high`` of an open file.

    A block starts at the file's first byte or where a cut ends. Whether a cut ends at a place depends only on the blanks
    before it and the two lines after it, so a range finds its first block by itself: it steps back over
    the blanks before it, and ahead to the first cut. It reads on past ``high`` until its last block is whole.
    """
    start = low
    if low:
        f.seek(max(0, low - 2))
        around, here = f.read(low + 2 - max(0, low - 2)), min(low, 2)
        for k in (1, 2):  # a byte order mark that the range's edge cuts
            if around[here - k : here - k + 3] == b"\xef\xbb\xbf" and here >= k:
                start = low - k
    while start > 0:  # back over the blanks before it
        back = max(0, start - 4096)
        f.seek(back)
        edge = _before_blanks(f.read(start - back), 0, start - back)
        start = back + edge
        if edge > 2 or not back:
            break
        if edge:  # perhaps the end of a byte order mark
            f.seek(max(0, start - 3))
            if f.read(min(3, start)) != b"\xef\xbb\xbf":
                break
            start -= 3
    f.seek(start)
    data, at, whole = b"", start, False  # ``at`` is the offset of data[0]
    block = 0 if low == 0 else None  # offset at which the block in work starts
    scan = 0
    while True:
        cut = _CUT.search(data, scan)
        if cut:
            here = at + cut.end()
            if block is not None:
                yield block, data[block - at : cut.start()]
            if here >= high:
                return
            block = here if here >= low else None
            if block is not None:
                data, at, scan = data[cut.end() :], here, 0
            else:
                scan = cut.end()
            continue
        if whole:
            if block is not None:
                yield block, data[block - at :]
            return
        keep = _open_end(data, scan)
        if block is None and at + keep >= high:
            return
        if block is None:
            data, at, keep = data[keep:], at + keep, 0
        more = f.read(max(step, len(data) // 2))
        whole = not more
        data, scan = data + more, keep


def _open_end(data: bytes, scan: int) -> int:
    """From where a cut can still begin when more bytes follow: the blanks before the last two lines, which may be an index
    line and a time line in work."""
    end = len(data)
    for _ in range(3):
        found = max(data.rfind(b"\n", scan, end), data.rfind(b"\r", scan, end))
        if found < 0:
            break
        end = _before_blanks(data, scan, found + 1)
    return max(scan, end)


class CueRanges(DataSource):
    """``(path, pos, value, error)``: caption blocks with the offset of their first byte. A file that cannot be read is a
    row with ``error``. Options: ``path``, ``suffix`` (``.srt``), ``rangeBytes``. Files that end in ``.gz`` are one range."""

    @classmethod
    def name(cls) -> str:
        return "cue_ranges"

    def schema(self) -> str:
        return "path string, pos bigint, value string, error string"

    def reader(self, schema) -> DataSourceReader:
        return CueReader(self.options)


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", self.SUFFIX)
        self.bytes = max(1, int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES))))
        self.step = int(options.get("step", STEP))

    def partitions(self):
        found = files_below(self.path, self.suffix)
        return dealt([(file, 0, size, max(1, size) if file.endswith(".gz") else self.bytes) for file, size in found]) or [Spans([])]

    def read(self, part: Spans) -> Iterator[pa.RecordBatch]:
        for span in part:
            yield from self.read_span(span)


class CueReader(_RangeReader):
    SUFFIX = ".srt"

    def read(self, part: Spans) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("value", pa.string()), ("error", pa.string())])
        rows: list[dict] = []
        size = 0
        for row in itertools.chain.from_iterable(map(self.rows_of, part)):
            rows.append(row)
            size += len(row["value"] or "")
            if size > STEP:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def rows_of(self, part: Span) -> Iterator[dict]:
        try:
            with _opened(part.file, self.path) as f:
                for pos, value in cues_of_range(f, part.low, 1 << 62 if part.file.endswith(".gz") else part.high, self.step):
                    text = value.decode("utf-8", "replace").replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n")
                    if text.strip(" \t\n\x0b\x0c\r"):
                        yield {"path": part.file, "pos": pos, "value": text, "error": None}
        except (OSError, EOFError, ValueError) as bad:
            yield {"path": part.file, "pos": part.low, "value": None, "error": str(bad)[:500]}


def _opened(file: str, root: str):
    store, _ = store_of(root)
    if not file.endswith(".gz"):
        return store.open_input_file(file)
    import gzip

    return gzip.GzipFile(fileobj=store.open_input_file(file))


class SignalRanges(DataSource):
    """``(path, channel, rate, idx, value)`` of WAV files, as ``read.read_signal`` gives it. Options: ``path``, ``suffix``,
    ``rangeBytes``, and ``from`` and ``to`` (frames ``from <= idx < to``): bytes of other frames are not read."""

    @classmethod
    def name(cls) -> str:
        return "signal_ranges"

    def schema(self) -> str:
        return "path string, channel int, rate int, idx bigint, value double, error string"

    def reader(self, schema) -> DataSourceReader:
        return SignalReader(self.options)


def wav_layout(f, size: int) -> tuple[tuple[int, int] | None, int, int, int, int]:
    """``(form, channels, rate, first byte, bytes)`` of the sound data, from the chunk heads alone; form None if there is
    none that can be read. The 64-bit form (RF64) is read, and data of unknown length lasts to the end."""
    at, form, channels, rate, long = 12, None, 1, 0, None
    f.seek(0)
    if f.read(4) not in (b"RIFF", b"RF64"):
        return None, 1, 0, 0, 0
    while at + 8 <= size:
        f.seek(at)
        head = f.read(8)
        tag, n = head[:4], int.from_bytes(head[4:], "little")
        if tag == b"fmt ":
            data = f.read(min(n, 40))
            kind, channels = (int.from_bytes(data[k : k + 2], "little") for k in (0, 2))
            rate = int.from_bytes(data[4:8], "little")
            if kind == 0xFFFE:  # extensible: the form stands in the extension
                kind = int.from_bytes(data[24:26], "little")
            form = (kind, int.from_bytes(data[14:16], "little"))
        elif tag == b"ds64":
            long = int.from_bytes(f.read(16)[8:], "little")
        elif tag == b"data":
            if form not in WAV_FORMS or not channels:
                return None, 1, rate, 0, 0
            n = (long if long is not None else size) if n == 0xFFFFFFFF else n
            return form, channels, rate, at + 8, min(n, size - at - 8)
        at += 8 + n + (n & 1)
    return None, 1, rate, 0, 0


def samples(raw: bytes, form: tuple[int, int]):
    """Samples in 16-bit units."""
    import numpy as np

    kind, bits = form
    if kind == 3:
        return np.frombuffer(raw, f"<f{bits // 8}").astype("float64") * 32768.0
    if bits == 8:
        return (np.frombuffer(raw, "u1").astype("float64") - 128.0) * 256.0
    if bits == 24:
        high = np.zeros((len(raw) // 3, 4), "u1")
        high[:, 1:] = np.frombuffer(raw, "u1").reshape(-1, 3)
        return high.view("<i4").ravel() / 65536.0
    return np.frombuffer(raw, f"<i{bits // 8}").astype("float64") / 2.0 ** (bits - 16)


class SignalReader(_RangeReader):
    SUFFIX = ".wav"

    def __init__(self, options):
        super().__init__(options)
        self.first, self.last = int(options.get("from", 0)), int(options.get("to", 1 << 62))

    def read_span(self, part: Span) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["path", "channel", "rate", "idx", "value", "error"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string()]

        def none(rate: int, error: str | None):
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip((part.file, None, rate, None, float("nan"), error), kinds, strict=True)], names)

        try:
            store, _ = store_of(self.path)
            with store.open_input_file(part.file) as f:
                form, channels, rate, start, n_bytes = wav_layout(f, f.size())
                if form is None:
                    if part.low == 0:
                        yield none(rate, None)
                    return
                frame = form[1] // 8 * channels
                # frames whose first byte lies in the range; samples of a last frame that is cut off belong to it
                total = -(-(n_bytes // (form[1] // 8)) // channels)
                lo = max(0, -(-(part.low - start) // frame), self.first)
                hi = min(total, -(-(part.high - start) // frame), self.last)
                step = max(1, self.step // frame)
                for first in range(lo, hi, step):
                    f.seek(start + first * frame)
                    raw = f.read(min(min(step, hi - first) * frame, start + n_bytes - (start + first * frame)))
                    value = samples(raw[: len(raw) // (form[1] // 8) * (form[1] // 8)], form)
                    k = np.arange(first * channels, first * channels + len(value))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([part.file] * len(k), pa.string()), pa.array(k % channels, pa.int32()), pa.array(np.full(len(k), rate), pa.int32()),
                        pa.array(k // channels, pa.int64()), pa.array(value, pa.float64()), pa.nulls(len(k), pa.string())], names)
        except (OSError, ValueError) as bad:
            if part.low == 0:
                yield none(0, str(bad)[:500])


def read_srt_ranges(spark: SparkSession, path: str, suffix: str = ".srt", range_bytes: int = RANGE_BYTES, **options) -> DataFrame:
    """Cues of SRT files, ``path, pos, cue_idx, start_ms, end_ms, content, _corrupt, error``, in ranges of ``range_bytes``.

    The rows of ``read.read_srt``, with the offset of each cue in its file, but a long file is many tasks, many short ranges
    are one, and none holds more than a step of its range and the cue in work. A file that cannot be read is a row whose ``error`` says why.
    """
    spark.dataSource.register(CueRanges)
    raw = spark.read.format("cue_ranges").option("suffix", suffix).option("rangeBytes", range_bytes).options(**options).load(path)
    cues = parse_srt_blocks(raw.where("error is null"))
    bad = raw.where("error is not null").select("path", "pos", "error")
    return cues.select("path", "pos", "cue_idx", "start_ms", "end_ms", "content", "_corrupt", "error").unionByName(bad, allowMissingColumns=True)


def read_signal_ranges(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, range_bytes: int = RANGE_BYTES,
                       suffix: str = ".wav", **options) -> DataFrame:
    """WAV files as ``path, channel, rate, idx, value, error``, in ranges of ``range_bytes``; of any length.

    The rows of ``read.read_signal``. With ``first`` and ``last`` only frames ``first <= idx < last`` are read from the files.
    """
    spark.dataSource.register(SignalRanges)
    reader = spark.read.format("signal_ranges").option("suffix", suffix).option("rangeBytes", range_bytes).options(**options)
    if first is not None:
        reader = reader.option("from", first)
    if last is not None:
        reader = reader.option("to", last)
    return reader.load(path)
