"""Byte-level BPE, encoding by a segment tree over pair ranks, and decoding."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices, texts_of

#: A worker's memory of pieces seen: characters of a piece, and bytes in all.
PIECE_BYTES, MEMORY = 64, 192 << 20
#: Bytes of text that are in work at a time, and characters from which a text is split in several lists.
SLICE, LONG_TEXT = 1 << 20, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of ``base64 rank`` lines. Read on the driver; the table is about a
    megabyte, whatever the input, and goes to the tasks with the function."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the whole if it is a token, else merges of the leftmost pair of least rank until none is left.

    The leaves of a segment tree are byte positions. A live position's leaf holds the rank of the pair that
    starts there times the number of positions, plus the position, so the root is the leftmost of the least
    ranks. A merge changes three leaves at most, each with its way to the root as far as that changes: the pair
    itself, the one swallowed, and the pair before it.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    get, none = ranks.get, 1 << 62
    tree = [none] * n
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        tree.append(none if r is None else r * n + i)
    tree.append(none)
    for k in range(n - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    best = tree[1]
    while best != none:
        i = best % n
        j = end[i]
        end[i] = e = end[j]
        if e < n:
            before[e] = i
            r = get(piece[i : end[e]])
            value = none if r is None else r * n + i
        else:
            value = none
        k = n + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1
        k = n + j
        if tree[k] != none:
            tree[k] = none
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1
        q = before[i]
        if q >= 0:
            r = get(piece[q:e])
            value = none if r is None else r * n + q
            k = n + q
            if tree[k] != value:
                tree[k] = value
                k >>= 1
                while k:
                    a, b = tree[2 * k], tree[2 * k + 1]
                    least = a if a < b else b
                    if tree[k] == least:
                        break
                    tree[k] = least
                    k >>= 1
        best = tree[1]
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pieces(dict):
    """What ``make`` gives for the ids of the pieces seen lately; a new piece is merged when asked for. Two generations of half
    of ``MEMORY`` each: a piece met again moves to the young one, and a full young one replaces the old."""

    def __init__(self, ranks: dict[bytes, int], make: Callable[[list[int]], object] = lambda ids: ids, entry_bytes: int = 280):
        super().__init__()
        self.ranks, self.make, self.entry_bytes = ranks, make, entry_bytes
        self.old, self.used = {}, 0

    def __missing__(self, piece: str):
        got = self.old.get(piece)
        if got is None:
            got = self.make(merge_piece(piece.encode(), self.ranks))
        if len(piece) <= PIECE_BYTES:
            self.used += self.entry_bytes + 4 * len(piece)
            if 2 * self.used > MEMORY:
                self.old, self.used = dict(self), 0
                self.clear()
            self[piece] = got
        return got


def pieces_of(pattern: str) -> Callable[[str], Iterator[list[str]]]:
    """Splits a text into lists of matches of ``pattern``; the matches of a long text come in several lists."""
    compiled = regex.compile(pattern)

    def split(text: str) -> Iterator[list[str]]:
        if len(text) <= LONG_TEXT:
            yield compiled.findall(text)
            return
        found = (m.group() for m in compiled.finditer(text))
        while part := list(islice(found, 1 << 16)):
            yield part

    return split


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """Bytes of every id, in order of the ids."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, r in ranks.items():
        table[r] = token
    return table


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` of whole texts, each match of ``pattern`` on its own, without special tokens.

    Null and empty texts give an empty list. Rows come out as they come in, repeated ones too. A piece that
    recurs in a partition is merged once; what is remembered is bounded. Other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ids_of = pieces_of(pattern), Pieces(ranks).__getitem__
        for part in slices(batches, "text", SLICE):
            flat, ends = array("i"), [0]
            for t in texts_of(part):
                for pieces in split(t):
                    flat.extend(chain.from_iterable(map(ids_of, pieces)))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([column(part, "id"), ids], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes of the ids in order; a null list gives none, an unknown id raises an error."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(token_bytes(ranks), object)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = []
                for ids in column(part, ids_col):
                    values = ids.values if ids.is_valid else None
                    got.append(b"".join(table[values.to_numpy()].tolist()) if values is not None and len(values) else b"")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def default_path() -> str:
    """The multilingual rank file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def digested(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)``: an encoding and its round trip, as digests.

    Encoding, decoding and hashing happen in one pass of one worker, 65,536 pieces of a text at a time, so neither
    ids nor decoded bytes of a whole text are held and nothing but digests leaves it. Null and empty texts
    have no ids; their digests are those of nothing. Repeated rows, null ids and empty tables come out as
    they come in, one row a row; other columns are not read. A worker holds the slice of the table it is
    given, one text at least, and ``MEMORY`` of pieces.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, bytes_of = pieces_of(pattern), token_bytes(ranks).__getitem__
        # of a piece: its ids as text, and what they decode to
        known = Pieces(ranks, lambda ids: (",".join(map(str, ids)), b"".join(map(bytes_of, ids))), 460).__getitem__
        for part in slices(batches, "text", SLICE):
            counts, codes, texts = [], [], []
            for t in texts_of(part):
                n, code, text = 0, hashlib.sha256(), hashlib.sha256()
                for pieces in split(t):
                    if pieces:
                        ids, decoded = zip(*map(known, pieces), strict=True)
                        listed = ",".join(ids).encode()
                        if n:
                            code.update(b",")
                        code.update(listed)
                        text.update(b"".join(decoded))
                        n += listed.count(b",") + 1  # a piece has one id at least
                counts.append(n)
                codes.append(code.hexdigest())
                texts.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [column(part, "id"), pa.array(counts, pa.int64()), pa.array(codes, pa.string()), pa.array(texts, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
