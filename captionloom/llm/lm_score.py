"""Scoring texts by a word n-gram language model: a weighted backoff automaton over distributed counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, column, mix64, slices

#: Tokens that a traversal reads in one go; longer texts are read in pieces side by side.
PIECE = 256
#: Bits of a gram's key beyond those that number all grams. With the number of chunks they make the size of a list: here, three
#: bytes an entry up to some gigabytes of text.
SPARE = 12
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_P = np.uint64(0x100000001B3)
_INV = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(token hashes, where each text's tokens begin and, last, their number)``: lower-cased (A-Z) words, then one end.

    All texts are hashed at once: a word's 64-bit hash comes from differences of a running polynomial of the bytes.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(sizes)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = np.frombuffer(b" ".join(texts.to_pylist()) + b" ", np.uint8)
    data = _FOLD[raw]
    gap = _SPACE[data]
    begin = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    stop = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    powers = np.empty(len(data) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = _P
    np.multiply.accumulate(powers, out=powers)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=run[1:])
    inverse = np.empty(len(data) + 1, np.uint64)
    inverse[0] = 1
    inverse[1:] = _INV
    np.multiply.accumulate(inverse, out=inverse)
    words = mix64((run[stop] - run[begin]) * inverse[begin] + mix64((stop - begin).astype(np.uint64)))
    edges = np.zeros(n + 1, np.int64)
    np.cumsum(sizes + 1, out=edges[1:])
    first = np.searchsorted(begin, edges) + np.arange(n + 1)  # with an end after each text's words
    out = np.empty(len(words) + n, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[first[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = words
    return out, first


def gram_keys(toks: np.ndarray, first: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """``(sequence, text starts, keys, whether there is such a gram)``: the tokens with a start before each text, and by order
    1, 2, ... the key of the gram that ends at each place. A gram's key is made of the key of the gram without its
    last token and that token. Keys of single tokens keep 63 bits, longer ones ``bits``."""
    n = len(first) - 1
    starts = first[:-1] + np.arange(n)
    seq = np.empty(len(toks) + n, np.uint64)
    is_start = np.zeros(len(seq), bool)
    is_start[starts] = True
    seq[is_start], seq[~is_start] = START, toks
    place = np.arange(len(seq)) - np.repeat(starts, np.diff(np.append(starts, len(seq))))
    whole, keys, there = seq, [seq >> np.uint64(1)], [np.ones(len(seq), bool)]
    for k in range(2, order + 1):
        before = np.empty_like(whole)
        before[1:], before[:1] = whole[:-1], 0
        whole = mix64(before * np.uint64(0xFF51AFD7ED558CCD) + seq)
        keys.append(whole >> np.uint64(64 - bits))
        there.append(place >= k - 1)
    return seq, starts, keys, there


@dataclass
class Grams:
    """The distinct grams of a chunk by order, in order of their keys, and the gram that ends at each place of its texts."""

    seq: np.ndarray
    starts: np.ndarray
    keys: list[np.ndarray]
    counts: list[np.ndarray]  # in the chunk's training texts
    at: list[np.ndarray]  # place to gram, -1 where there is none
    place: list[np.ndarray]  # gram to one place where it ends


def grams_of(table: pa.Table, order: int, bits: int) -> Grams:
    trained = table.column("trained").to_numpy()
    parts = [tokens(column(b, "text")) for b in slices(table.select(["text"]).combine_chunks().to_batches(), "text", 2 << 20)]
    toks = np.concatenate([t for t, _ in parts])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
    seq, starts, keys, there = gram_keys(toks, first, order, bits)
    weight = np.repeat(trained, np.diff(np.append(starts, len(seq))))
    out = Grams(seq, starts, [], [], [], [])
    for key, has in zip(keys, there, strict=True):
        where = np.flatnonzero(has)
        unique, one, at = np.unique(key[where], return_index=True, return_inverse=True)
        full = np.full(len(seq), -1, np.int32)
        full[where] = at
        out.keys.append(unique)
        out.counts.append(np.bincount(at[weight[where]], minlength=len(unique)))
        out.at.append(full)
        out.place.append(where[one])
    return out


@dataclass
class Automaton:
    """States are known contexts: state 0 is the root, the empty one. Arcs are known grams, from the context without the last
    token to the longest known context that the token leads to. Every other state has a failure arc to the
    context without its first token. Weights are log10 probabilities."""

    arc_to: np.ndarray
    arc_weight: np.ndarray
    arc_known: np.ndarray
    fail_to: np.ndarray
    fail_weight: np.ndarray
    base: list[int]  # number of the first arc, and state, of each order


def automaton(grams: Grams, totals: list[np.ndarray], n_all: int, backoff: float, concentration: float) -> Automaton:
    """The part of the model's automaton that a chunk's texts can visit, from the totals of its grams.

    A context h that was left c(h) times gives its word w the weight (1 - b) c(h, w) / (c(h) + m) + f(h) p(w | h'), with h' the
    context without its first token and f(h) = b + (1 - b) m / (c(h) + m) the weight of its failure arc; the root
    gives c(w) / (N + 1) to words seen in training and 1 / (N + 1) to all others together. So what may follow a state
    adds up to 1.
    """
    order = len(totals)
    base = np.cumsum([1, *map(len, totals)]).tolist()
    to, weight, known = (np.zeros(base[-1], kind) for kind in (np.int64, np.float64, bool))
    fail_to, fail = np.zeros(base[-1], np.int64), np.ones(base[-1])
    below = None
    for k, total in enumerate(totals, 1):
        mine, end = slice(base[k - 1], base[k]), grams.place[k - 1]
        leads = (total > 0) & (grams.seq[end] != END)
        state = np.where(leads, np.arange(base[k - 1], base[k]), 0)
        known[mine] = total > 0 if k > 1 else True
        if k == 1:
            p = np.maximum(total, 1.0) / (n_all + 1.0)
        else:
            context, shorter = grams.at[k - 2][end - 1], grams.at[k - 2][end]
            left = totals[k - 2][context] + concentration
            p = (1 - backoff) * total / left + (backoff + (1 - backoff) * concentration / left) * below[shorter]
            state = np.where(leads, state if k < order else to[base[k - 2] + shorter], 0)
            fail_to[mine] = to[base[k - 2] + shorter]
        to[mine], weight[mine] = state, np.log10(p)
        fail[mine] = backoff + (1 - backoff) * concentration / (total + concentration)
        below = p
    return Automaton(to, weight, known, fail_to, np.log10(fail), base)


def traverse(machine: Automaton, grams: Grams) -> np.ndarray:
    """Log10 probability of the token at each place, all texts read from left to right.

    A reader stands in a state, takes the arc of the token it reads, or failure arcs until there is one, and goes on from where
    the arc leads. Texts are read side by side. A long text is read in pieces: a state is the longest known
    context of at most order - 1 tokens, so a reader that starts in the root that many tokens before its piece
    has reached the right state when the piece begins.
    """
    order, lengths = len(grams.at), np.diff(np.append(grams.starts, len(grams.seq)))
    arcs = np.stack([np.where(at < 0, 0, at + base) for at, base in zip(grams.at, machine.base, strict=False)])
    n_pieces = -(-(lengths - 1) // PIECE)
    text = np.repeat(np.arange(len(lengths)), n_pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    first = grams.starts[text] + 1 + number * PIECE
    stop = np.minimum(first + PIECE, grams.starts[text] + lengths[text])
    begin = np.maximum(first - (order - 1), grams.starts[text])  # the start itself leads from the root to its state
    by_length = np.argsort(begin - stop, kind="stable")
    begin, stop = begin[by_length], stop[by_length]
    size, out = stop - begin, np.zeros(len(grams.seq))
    state, level_of = np.zeros(len(begin), np.int64), np.searchsorted(machine.base, np.arange(machine.base[-1]), side="right")
    active = len(begin)
    for step in range(int(size.max(initial=0))):
        active = int(np.searchsorted(-size, -step, side="left"))
        here, now = begin[:active] + step, state[:active].copy()
        score = np.zeros(active)
        arc = arcs[level_of[now], here]
        while len(lost := np.flatnonzero(~machine.arc_known[arc])):
            score[lost] += machine.fail_weight[now[lost]]
            now[lost] = machine.fail_to[now[lost]]
            arc[lost] = arcs[level_of[now[lost]], here[lost]]
        out[here] = score + machine.arc_weight[arc]  # places read twice get their last, right value from their own piece
        state[:active] = machine.arc_to[arc]
    return out


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as eight runs of like bytes, which compress where the high ones are alike."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def score(docs: DataFrame, trained: str, id_col: str = "doc_id", text_col: str = "text", order: int = 3, backoff: float = 0.5,
          concentration: float = 20.0, chunk_bytes: int = 4 << 20, bucket_keys: int = 1 << 19) -> DataFrame:
    """One row per document: ``(id_col, n_tokens, n_known, train_tokens, base_score, score)``.

    ``trained``: name of a boolean column, true for the documents the model learns from. Tokens: words with A-Z lower-cased,
    then one end. ``base_score`` sums log10 of add-one unigram probabilities with one more for unknown words; ``n_known``
    counts tokens seen in training. ``score`` is the log10 probability of the text under interpolated grams of up to
    ``order`` words, read off the automaton (``automaton``, ``traverse``).

    Counts cover every training text, and no table of them is ever whole in one place: texts are shuffled once, into
    chunks; each chunk lists its distinct grams with its own counts, the lists are cut by order and key range, a range's
    lists are added up, and each chunk gets back what the others have of its own grams, which is all that its part of
    the automaton takes. Chunks are sized by the text's bytes, ranges by the number of keys, and a gram has at most one
    entry a chunk, however common it is.

    Null and empty texts are an end alone. Null ids and repeated rows are scored like others, the latter each time. With no
    training text all counts are 0 and every token has probability 1. An empty table gives an empty result. Words are
    told apart by 63 bits of hash, so ``n_known`` and ``base_score`` are exact but for a collision among them;
    longer grams by ``SPARE`` bits more than it takes to number them, so about one in 8,000 meets another. A chunk
    holds its texts, one at least: some 100 bytes a byte of text, so texts of up to about 10 MB fit an
    executor's worker of 1 GB.
    """
    if order < 2:
        raise ValueError("the model takes grams of 2 words or more")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(trained), F.lit(False)).alias("trained"))
    n_tokens = F.when(F.col("trained"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) + 1)
    size, n_all = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(n_tokens), F.lit(0))).first()
    bits = min(63, max(40, SPARE + (size // 4).bit_length()))
    chunks, ranges = 1 + size // chunk_bytes, 1 + size // (6 * bucket_keys)
    # rows alike in all are dealt by the partition they lie in
    chunk = F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(chunks)).cast("int")
    dealt = rows.withColumn("chunk", chunk).repartition("chunk")
    kind = rows.schema["id"].dataType.simpleString()

    def listed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grams = grams_of(table, order, bits)
        out: dict[str, list] = {"bucket": [], "chunk": [], "keys": [], "counts": []}
        for k, (keys, counts) in enumerate(zip(grams.keys, grams.counts, strict=True)):
            high = keys >> np.uint64(max(0, (63 if k == 0 else bits) - 32))
            bucket = (high * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)  # ranges of keys
            edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                out["bucket"].append(k * ranges + int(bucket[lo]))
                out["chunk"].append(key[0].as_py())
                out["keys"].append(_planes(np.diff(keys[lo:hi], prepend=np.uint64(0))))
                out["counts"].append(_planes(counts[lo:hi]))
        return pa.table([pa.array(out["bucket"], pa.int64()), pa.array(out["chunk"], pa.int32()), pa.array(out["keys"], pa.binary()), pa.array(out["counts"], pa.binary())], names=list(out))

    def added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists = [np.cumsum(_from_planes(x.as_buffer()), dtype=np.uint64) for x in table.column("keys")]
        counts = np.concatenate([_from_planes(x.as_buffer()) for x in table.column("counts")])
        keys, at = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(at, counts, len(keys)).astype(np.int64)
        edges = np.cumsum([0, *map(len, lists)])
        others = total[at] - counts.astype(np.int64)  # mostly nothing, as most long grams are of one chunk
        parts = [_planes(others[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        types = np.zeros(len(parts), np.int64)  # words of the range, with its first part
        if key[0].as_py() < ranges:
            types[0] = np.count_nonzero(total[keys != START >> np.uint64(1)])
        return pa.table([table.column("bucket"), table.column("chunk"), pa.array(parts, pa.binary()), pa.array(types)],
                        names=["bucket", "chunk", "others", "n_types"])

    lists = dealt.groupBy("chunk").applyInArrow(listed, "bucket bigint, chunk int, keys binary, counts binary")
    totals = lists.groupBy("bucket").applyInArrow(added, "bucket bigint, chunk int, others binary, n_types bigint")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        grams = grams_of(left, order, bits)
        parts = sorted(zip(right.column("bucket").to_pylist(), right.column("others"), strict=True), key=lambda p: p[0])
        flat = np.concatenate([_from_planes(t.as_buffer()) for _, t in parts]).astype(np.int64)
        edges = np.cumsum([0, *map(len, grams.keys)])
        assert len(flat) == edges[-1], "a chunk's totals don't fit its grams"
        counts = [own + flat[a:b] for own, a, b in zip(grams.counts, edges, edges[1:], strict=False)]
        each = traverse(automaton(grams, counts, n_all, backoff, concentration), grams)
        word, begin = counts[0][grams.at[0]], grams.starts
        each[begin], word[begin] = 0, 0
        return pa.table([
            left.column("id"), pa.array(np.diff(np.append(begin, len(word))) - 1), pa.array(np.add.reduceat((word > 0).astype(np.int64), begin)),
            pa.array(np.add.reduceat(np.log10(word + 1.0), begin)), pa.array(np.add.reduceat(each, begin)),
        ], names=["id", "n_tokens", "n_known", "logs", "score"])

    out = dealt.groupBy("chunk").cogroup(totals.select("bucket", "chunk", "others").groupBy("chunk")).applyInArrow(
        scored, f"id {kind}, n_tokens bigint, n_known bigint, logs double, score double")
    # the number of words is known when all ranges are added up: a scalar subquery on the same shuffled lists
    n_types = totals.agg(F.coalesce(F.sum("n_types"), F.lit(0)).alias("n_types")).scalar()
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(n_all)) + n_types + 1.0)
    return out.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(int(n_all)).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
