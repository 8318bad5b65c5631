"""Alignment of sentences to word sequences.

Two forms. *Join form* (``exact_and_fuzzy``, ``flexible_spans``, ``char_spans``): token positions are
indexed per (recording, chunk, token) and sentences meet them by equi-joins; only the positions of a
sentence's rarest tokens are tried, which is exact because a window with similarity >= t must agree in
at least one of any n - ceil(t n) + 1 tokens. *Fold form* (``align_*``): rules in which each sentence
depends on what the sentences before it took. They run per (recording, chunk) with numpy kernels; a
chunk is the unit cut by ``signal.plan_chunks`` (half an hour of speech), not a whole recording.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from itertools import accumulate
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import align_tokens, clean_case, clean_word, lower_hyphen_word, lower_plain_word
from ..functions.text import norm_align, norm_clean, norm_tokens, tokens

CHUNK = ("rec_id", "chunk_id")


def _tokens_by(norm: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: F.filter(F.transform(tokens(text), norm), lambda t: t != "")


# normal form of a word and of a sentence's tokens, per aligner family
FORMS: dict[str, tuple[Callable, Callable]] = {
    "align": (norm_align, align_tokens),
    "clean": (norm_clean, norm_tokens),
    "hyphen": (lower_hyphen_word, _tokens_by(lower_hyphen_word)),
    "plain": (lower_plain_word, _tokens_by(lower_plain_word)),
    "cased": (clean_word, lambda text: tokens(clean_case(text))),
}


# ------------------------------------------------------------------ join form

def token_index(words: DataFrame, form: str = "align", keys: Sequence[str] = CHUNK) -> DataFrame:
    """Sorted positions of every normalized token of a chunk: ``keys, tok, at``."""
    norm = FORMS[form][0]
    return words.select(*keys, norm(F.col("word")).alias("tok"), "word_idx").groupBy(*keys, "tok").agg(
        F.array_sort(F.collect_list("word_idx")).alias("at"))


def _bounds(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    return words.groupBy(*keys).agg(F.min("word_idx").alias("_lo"), F.max("word_idx").alias("_hi"))


def _token_rows(sentences: DataFrame, form: str, keys: Sequence[str]) -> DataFrame:
    toks = FORMS[form][1](F.col("text"))
    return sentences.select(*keys, "sent_idx", toks.alias("_toks")).select(
        *keys, "sent_idx", F.size("_toks").alias("n"), F.posexplode("_toks").alias("k", "tok"))


def exact_and_fuzzy(
    sentences: DataFrame, words: DataFrame, threshold: float = 0.85, form: str = "align", keys: Sequence[str] = CHUNK,
) -> DataFrame:
    """All windows of a sentence's length that agree in at least ``threshold`` of the positions:
    ``keys, sent_idx, n, start_word_idx, end_word_idx, similarity``."""
    keys = list(keys)
    hits = _token_rows(sentences, form, keys).join(token_index(words, form, keys), [*keys, "tok"])
    per = hits.groupBy(*keys, "sent_idx", "n").agg(
        F.array_sort(F.collect_list(F.struct(F.size("at").alias("f"), "k", "at"))).alias("h"))
    # tokens without any position are the rarest and offer no window; the others follow by frequency
    tries = F.expr(
        f"greatest(0, n - cast(ceil(round({threshold} * n, 9)) as int) + 1 - (n - size(h)))")
    starts = F.array_distinct(F.flatten(F.transform(
        F.slice("h", F.lit(1), tries), lambda x: F.transform(x["at"], lambda p: p - x["k"]))))
    rows = per.withColumn("start_word_idx", F.explode(starts)).join(_bounds(words, keys), keys)
    rows = rows.filter("start_word_idx >= _lo and start_word_idx + n - 1 <= _hi")
    agree = F.size(F.filter("h", lambda x: F.array_contains(x["at"], F.col("start_word_idx") + x["k"])))
    rows = rows.withColumn("similarity", agree / F.col("n")).filter(F.col("similarity") >= threshold)
    return rows.select(*keys, "sent_idx", "n", "start_word_idx",
                       (F.col("start_word_idx") + F.col("n") - 1).alias("end_word_idx"), "similarity")


def align_exact(sentences: DataFrame, words: DataFrame, form: str = "align", keys: Sequence[str] = CHUNK) -> DataFrame:
    """Leftmost window equal to the sentence."""
    return align_fuzzy(sentences, words, 1.0, form, keys)


def align_fuzzy(sentences: DataFrame, words: DataFrame, threshold: float = 0.9, form: str = "align", keys: Sequence[str] = CHUNK) -> DataFrame:
    """Leftmost window with at least ``threshold`` similarity."""
    found = exact_and_fuzzy(sentences, words, threshold, form, keys)
    best = F.min(F.struct("start_word_idx", "end_word_idx", "similarity"))
    return found.groupBy(*keys, "sent_idx").agg(best.alias("m")).select(
        *keys, "sent_idx", "m.start_word_idx", "m.end_word_idx", "m.similarity")


def flexible_spans(sentences: DataFrame, words: DataFrame, floor: float = 0.6, form: str = "plain", keys: Sequence[str] = CHUNK) -> DataFrame:
    """Span from a hit of the first token to a hit of the last one that holds the largest share of the
    sentence's tokens (at least ``floor``); the leftmost and then shortest such span.

    The widest span reaches the largest share, so the span starts at the first hit of the first token and
    ends at the first hit of the last token that is not before any found token's earliest position.
    """
    keys = list(keys)
    rows = _token_rows(sentences, form, keys).join(token_index(words, form, keys), [*keys, "tok"], "left")
    edge = rows.groupBy(*keys, "sent_idx").agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("k") == 0, F.get("at", F.lit(0)))).alias("f"),
        F.max_by("at", "k").alias("lasts"),
        F.collect_list(F.struct("k", "at")).alias("h"),
    ).withColumn("l", F.try_element_at("lasts", F.lit(-1))).filter("l > f")
    first_from = F.transform("h", lambda x: F.get(F.filter(x["at"], lambda p: p >= F.col("f")), F.lit(0)))
    edge = edge.withColumn("near", F.filter(first_from, lambda p: p.isNotNull() & (p <= F.col("l"))))
    edge = edge.withColumn("confidence", F.size("near") / F.col("n")).filter(F.col("confidence") >= floor)
    end = F.get(F.filter("lasts", lambda p: (p >= F.array_max("near")) & (p > F.col("f"))), F.lit(0))
    return edge.select(*keys, "sent_idx", F.col("f").alias("start_word_idx"), end.alias("end_word_idx"), "confidence")


def char_spans(sentences: DataFrame, words: DataFrame, keys: Sequence[str] = CHUNK) -> DataFrame:
    """First place of the cleaned sentence in the cleaned chunk text, as a word range; no guesses. Only the first part of
    the search: equal sentences share a place and a hit may start inside a word (``char_places`` does the whole).

    ``words`` are cleaned (empty ones dropped) and joined by blanks; the range holds the words of the first
    and the last character.
    """
    keys = list(keys)
    # empty words are left out of the list, as a filter would clean every word once more
    listed = F.array_sort(F.collect_list(F.when(F.col("w") != "", F.struct("word_idx", "w"))))
    ref = words.select(*keys, "word_idx", clean_word(F.col("word")).alias("w")).groupBy(*keys).agg(listed.alias("ws")).filter(F.size("ws") > 0)
    ref = ref.withColumn("ref", F.concat(F.lit(" "), F.array_join(F.transform("ws", lambda x: x["w"]), " "), F.lit(" ")))
    rows = sentences.select(*keys, "sent_idx", clean_case(F.col("text")).alias("t")).filter("t <> ''").join(ref, keys)
    rows = rows.withColumn("at", F.expr("instr(substr(ref, 2), t)")).filter("at > 0")
    # blanks before an offset count the words that end before it
    blanks = lambda upto: F.expr(f"length(substr(ref, 2, {upto})) - length(replace(substr(ref, 2, {upto}), ' ', ''))")
    return rows.select(
        *keys, "sent_idx",
        F.get("ws", blanks("at - 1").cast("int"))["word_idx"].alias("start_word_idx"),
        F.get("ws", blanks("at - 1 + length(t)").cast("int"))["word_idx"].alias("end_word_idx"))


# ------------------------------------------------------------------ fold form

def _free(used: np.ndarray, n: int) -> np.ndarray:
    """Window starts whose n words are all unused."""
    run = np.concatenate([[0], np.cumsum(used)])
    return run[n:] == run[:-n] if len(used) >= n else np.zeros(0, dtype=bool)


def _first(mask: np.ndarray) -> int:
    return int(mask.argmax()) if mask.any() else -1


class _Chunk:
    """Words of one chunk as integer codes, shared by the kernels."""

    def __init__(self, norms: list[str]):
        self.vocab = {t: i for i, t in enumerate(dict.fromkeys(norms))}
        self.names = list(self.vocab)
        self.seq = np.array([self.vocab[t] for t in norms], dtype=np.int64)
        self.used = np.zeros(len(norms), dtype=bool)
        self.partial: dict[tuple[str, bool], np.ndarray] = {}
        self.text = self.size = self.chars = self.places = None

    def agreement(self, codes: np.ndarray, start: int = 0) -> np.ndarray:
        """Number of agreeing positions for every window from ``start`` on: each place of a token votes for one window."""
        n = len(self.seq) - start - len(codes) + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        if self.places is None:
            self.places = np.argsort(self.seq, kind="stable")
            self.often = np.bincount(self.seq, minlength=len(self.names))
            self.head = np.cumsum(self.often) - self.often
        k = np.flatnonzero(codes >= 0)
        often = self.often[codes[k]]
        at = np.repeat(self.head[codes[k]] - np.cumsum(often) + often, often) + np.arange(often.sum())
        window = self.places[at] - np.repeat(k + start, often)
        return np.bincount(window[(window >= 0) & (window < n)], minlength=n)

    def codes(self, toks: list[str]) -> np.ndarray:
        return np.array([self.vocab.get(t, -1) for t in toks], dtype=np.int64)

    def token_scores(self, tok: str, fuzzy: bool) -> np.ndarray:
        """Score of ``tok`` against every vocabulary entry: 1 equal, .8 contained, .6 alike (if ``fuzzy``)."""
        return self.all_scores([tok], fuzzy)[0]

    def all_scores(self, toks: list[str], fuzzy: bool) -> list[np.ndarray]:
        new = [t for t in dict.fromkeys(toks) if (t, fuzzy) not in self.partial]
        for lo in range(0, len(new), 256):
            part = new[lo:lo + 256]
            self.partial |= zip(((t, fuzzy) for t in part), self._scores(part, fuzzy))
        return [self.partial[t, fuzzy] for t in toks]

    def _scores(self, toks: list[str], fuzzy: bool) -> np.ndarray:
        if self.text is None:
            text = np.array(self.names, dtype=str)
            self.size = np.char.str_len(text)
            self.chars = text.view(np.uint32).reshape(len(self.names), -1)  # zero where a word has ended
            self.text = "\0".join(map(str, self.names))
            self.starts = [0, *accumulate(len(str(name)) + 1 for name in self.names)]
        scores = np.zeros((len(toks), len(self.names)))
        size = np.array([len(t) for t in toks])
        if fuzzy:
            longest = np.maximum(size[:, None], self.size[None, :])
            same = np.zeros(scores.shape, np.int32)
            width = min(int(size.max()), self.chars.shape[1])
            codes = np.full((len(toks), width), -1 & 0xFFFFFFFF, np.uint32)  # what no word holds
            for i, t in enumerate(toks):
                codes[i, :min(len(t), width)] = np.frombuffer(t[:width].encode("utf-32-le", "surrogatepass"), np.uint32)
            for k in range(min(width, 16)):
                same += codes[:, k, None] == self.chars[:, k]
            for k in range(16, width):  # few are that long
                mine, other = np.flatnonzero(size > k), np.flatnonzero(self.size > k)
                same[np.ix_(mine, other)] += codes[mine, k, None] == self.chars[None, other, k]
            alike = (np.abs(size[:, None] - self.size[None, :]) <= 2) & (same / np.maximum(longest, 1) >= 0.6)
            scores[alike] = 0.6
        at, held = [], []
        for i, t in enumerate(toks):
            # words that hold the token are found in all words written one after another, words it holds by its pieces
            found = self._holding(t)
            found += [self.vocab[x] for a in range(len(t)) for b in range(a + 1, len(t) + 1) if (x := t[a:b]) in self.vocab]
            at += [i] * len(found)
            held += found
        scores[at, held] = 0.8
        if "" in self.vocab:
            scores[:, self.vocab[""]] = 0.8
        if fuzzy:
            scores[(size[:, None] < 3) | (self.size[None, :] < 3)] = 0.0  # too short for anything but equality
        codes = self.codes(toks)
        known = np.flatnonzero(codes >= 0)
        scores[known, codes[known]] = 1.0
        return scores

    def _holding(self, tok: str) -> list[int]:
        if not tok or "\0" in tok:
            return [i for i, name in enumerate(self.names) if tok in name]
        found, at = [], self.text.find(tok)
        while at >= 0:
            i = bisect_right(self.starts, at) - 1
            found.append(i)
            at = self.text.find(tok, self.starts[i + 1])
        return found

    def pair_score(self, tok: str, code: int) -> float:
        """The score of one token (which is not empty) against one vocabulary entry, as ``token_scores`` gives it with ``fuzzy``."""
        name = self.names[code]
        if tok == name:
            return 1.0
        if len(tok) < 3 or len(name) < 3:
            return 0.0
        if tok in name or name in tok:
            return 0.8
        alike = abs(len(tok) - len(name)) <= 2 and sum(map(eq, tok, name)) / max(len(tok), len(name)) >= 0.6
        return 0.6 if alike else 0.0

    def window_scores(self, toks: list[str], fuzzy: bool) -> np.ndarray:
        n = len(self.seq) - len(toks) + 1
        total = np.zeros(max(n, 0))
        if n > 0:
            for k, scores in enumerate(self.all_scores(toks, fuzzy)):
                total += scores[self.seq[k:k + n]]
        return total / max(len(toks), 1)


def _monotonic(chunk: _Chunk, sents: list[list[str]], context: bool):
    """Cursor rule: equal, >= .9, >= .85, then short sentences with neighbouring words."""
    cursor, size = 0, len(chunk.seq)

    def search(codes: np.ndarray, start: int, floors) -> tuple[int, float]:
        if start >= size:
            return -1, 0.0
        share = chunk.agreement(codes, start) / len(codes)
        for f in floors:
            i = _first(share >= f)
            if i >= 0:
                return start + i, float(share[i])
        return -1, 0.0

    def candidates(codes: np.ndarray):
        """What is searched for, from where, by which shares: the sentence, and if short also with neighbours."""
        yield codes, cursor, (1.0, 0.9, 0.85)
        if context and len(codes) <= 2:
            for stop in (cursor + 1, cursor + 2):
                yield np.concatenate([codes, chunk.seq[cursor:stop]]), cursor, (0.85,)
            low = max(0, cursor - 2)
            if low < cursor:
                yield np.concatenate([chunk.seq[low:cursor], codes]), low, (0.85,)

    for toks in sents:
        hits = ((*search(c, start, floors), len(c)) for c, start, floors in candidates(chunk.codes(toks))) if toks else ()
        at, conf, n = next((h for h in hits if h[0] >= 0), (-1, 0.0, 0))
        if at >= 0:
            cursor = at + n
        yield None if not toks else (at, at + n - 1, conf) if at >= 0 else (-1, -1, 0.0)


def _take(chunk: _Chunk, at: int, n: int, conf: float):
    chunk.used[at:at + n] = True
    return at, at + n - 1, conf


def _near_window(chunk: _Chunk, toks: list[str], free: np.ndarray) -> tuple[int, float] | None:
    """First free window that scores >= .9, else the best one, if it scores .8 or more.

    A token that is not equal scores .8 at most, so a window's equal tokens bound its score: those with fewer than half
    stay below .9, and once a window is found only those that could beat or equal it are scored.
    """
    n = len(toks)
    codes = chunk.codes(toks)
    agree = chunk.agreement(codes)

    def score(at: int) -> float:
        total = 0.0  # in the order of the tokens, as sums of doubles depend on it
        for tok, mine, code in zip(toks, codes.tolist(), chunk.seq[at:at + n].tolist()):
            total += 1.0 if mine == code else chunk.pair_score(tok, code)
        return total / n

    best = (-1, 0.0)
    near = free & (2 * agree >= n)
    for at in np.flatnonzero(near).tolist():
        got = score(at)
        if got >= 0.9 - 1e-12:
            return at, got
        best = max(best, (at, got), key=lambda x: x[1])
    if best[1] < 0.8:
        return None
    for at in np.flatnonzero(free & ~near & (0.8 * n + 0.2 * agree >= best[1] * n - 1e-6)).tolist():
        got = score(at)
        if got > best[1] or got == best[1] and at < best[0]:
            best = (at, got)
    return best


def _unused_robust(chunk: _Chunk, sents: list[list[str]]):
    """Free windows with partial token scores: first >= .9, else best >= .75."""
    for toks in sents:
        n = len(toks)
        if not n or n > len(chunk.seq):
            yield (-1, -1, 0.0)
            continue
        free = _free(chunk.used, n)
        near = _near_window(chunk, toks, free)
        if near is not None:
            yield _take(chunk, near[0], n, near[1])
            continue
        score = np.where(free, chunk.window_scores(toks, True), 0.0)
        at = int(score.argmax())
        yield _take(chunk, at, n, float(score[at])) if score[at] >= 0.75 - 1e-12 else (-1, -1, 0.0)


def _unused_share(floor: float, strict: bool):
    """Free windows by agreeing positions: an equal one first, else the best above ``floor``."""

    def fold(chunk: _Chunk, sents: list[list[str]]):
        for toks in sents:
            yield _best_share(chunk, toks, floor, strict, True)

    return fold


def _best_share(chunk: _Chunk, toks: list[str], floor: float, strict: bool, take: bool):
    n = len(toks)
    if not n or n > len(chunk.seq):
        return (-1, -1, 0.0)
    share = np.where(_free(chunk.used, n), chunk.agreement(chunk.codes(toks)) / n, 0.0)
    at = int(share.argmax())  # the first of the best ones; an equal window is a best one
    ok = share[at] > floor if strict else share[at] >= floor
    if not ok:
        return (-1, -1, 0.0)
    return _take(chunk, at, n, float(share[at])) if take else (at, at + n - 1, float(share[at]))


def _free_flexible(chunk: _Chunk, toks: list[str], floor: float = 0.6):
    """First-token to last-token span inside free words with the largest token share."""
    codes, best = chunk.codes(toks), (-1, -1, 0.0)
    firsts = np.flatnonzero((chunk.seq == codes[0]) & ~chunk.used)
    lasts = np.flatnonzero((chunk.seq == codes[-1]) & ~chunk.used)
    blocks = np.cumsum(chunk.used)
    for f in firsts:
        ends = lasts[(lasts > f) & (blocks[lasts] == blocks[f])]
        if not len(ends):
            continue
        inside = chunk.seq[f:ends[-1] + 1]
        early = [int(np.argmax(inside == c)) if (inside == c).any() else -1 for c in codes]
        found = [e for e in early if e >= 0]
        share = len(found) / len(codes)
        if share > best[2]:
            best = (int(f), int(ends[ends >= f + max(found)][0]), share)
    return best if best[2] >= floor else (-1, -1, 0.0)


def _best_sequence(chunk: _Chunk, sents: list[list[str]]):
    """Equal free window, else the best above .8; a flexible span if that is below .9 and the span is better."""
    for toks in sents:
        if not toks:
            yield None
            continue
        at = _best_share(chunk, toks, 0.8, True, False)
        if at[2] < 0.9:
            flex = _free_flexible(chunk, toks)
            if flex[2] > at[2]:
                at = flex
        if at[0] >= 0:
            chunk.used[at[0]:at[1] + 1] = True
        yield at


def _token_set(chunk: _Chunk, sents: list[list[str]]):
    """Free window with the sentence's tokens in order, else the window of n +- 2 words that shares most
    distinct tokens (at least .7)."""
    for toks in sents:
        if not toks:
            yield None
            continue
        best = _best_share(chunk, toks, 1.0, False, False)
        if best[0] < 0:
            best = _most_distinct(chunk, toks, range(max(1, len(toks) - 2), len(toks) + 3), 0.7)
        if best[0] >= 0:
            chunk.used[best[0]:best[1] + 1] = True
        yield best


def _most_distinct(chunk: _Chunk, toks: list[str], widths: range, floor: float):
    """Free window of one of the widths that holds most of the sentence's distinct tokens; the leftmost and then
    shortest of the best. The last word starts no window.

    An occurrence counts for the windows that reach it and start after the one before it, so each adds one
    stretch of window starts, and a running sum gives all windows of a width at once.
    """
    size, wanted = len(chunk.seq), np.unique(chunk.codes(toks))
    at = np.flatnonzero(np.isin(chunk.seq, wanted[wanted >= 0]))
    order = np.lexsort((at, chunk.seq[at]))
    before = np.full(len(at), -1)
    same = np.diff(chunk.seq[at][order]) == 0
    before[order[1:][same]] = at[order[:-1][same]]
    top, width = np.zeros(max(size - 1, 0), np.int64), np.zeros(max(size - 1, 0), np.int64)
    for w in widths:
        n = min(size - w + 1, size - 1)
        if n <= 0:
            break
        edge = np.zeros(size + 1, np.int64)
        np.add.at(edge, np.maximum(before, at - w) + 1, 1)
        np.add.at(edge, at + 1, -1)
        held = np.where(_free(chunk.used, w)[:n], np.cumsum(edge)[:n], 0)
        better = held > top[:n]
        top[:n][better], width[:n][better] = held[better], w
    if not len(top) or not top.any():
        return (-1, -1, 0.0)
    s = int(top.argmax())
    share = top[s] / len(set(toks))
    return (s, s + int(width[s]) - 1, float(share)) if share >= floor else (-1, -1, 0.0)


def _fuzzy_unused(floor: float):
    """First free window with at least ``floor`` agreeing positions."""

    def fold(chunk: _Chunk, sents: list[list[str]]):
        for toks in sents:
            n = len(toks)
            if not n or n > len(chunk.seq):
                yield (-1, -1, 0.0)
                continue
            share = np.where(_free(chunk.used, n), chunk.agreement(chunk.codes(toks)) / n, 0.0)
            at = _first(share >= floor)
            yield _take(chunk, at, n, float(share[at])) if at >= 0 else (-1, -1, 0.0)

    return fold


def _locate(chunk: _Chunk, sents: list[list[str]]):
    """Best window >= .7 where a contained token counts .8; sentences do not exclude each other."""
    for toks in sents:
        n = len(toks)
        if not n or n > len(chunk.seq):
            yield (-1, -1, 0.0)
            continue
        score = chunk.window_scores(toks, False)
        at = int(score.argmax())
        yield (at, at + n - 1, float(score[at])) if score[at] >= 0.7 - 1e-12 else (-1, -1, 0.0)


def _fold(sentences: DataFrame, words: DataFrame, form: str, kernel: Callable, keys: Sequence[str], toks: Column | None = None) -> DataFrame:
    """Run a kernel per (recording, chunk). Adds ``confidence, start_word_idx, end_word_idx, start_ms, end_ms``;
    unmatched sentences have -1 and null times, sentences the kernel skips are dropped."""
    keys = list(keys)
    norm, split = FORMS[form]
    left = words.select(*keys, "word_idx", norm(F.col("word")).alias("norm"), "start_ms", "end_ms")
    if form in ("hyphen", "plain"):
        left = left.filter("norm <> ''")
    right = sentences.select(*keys, "sent_idx", "text", (split(F.col("text")) if toks is None else toks).alias("toks"))
    # one shuffle and sort of words and sentences together, so that a worker reads chunk after chunk from one stream; a
    # fixed number of partitions, so that small inputs keep all cores (row sizes say little about the kernels' work)
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = lambda kind: F.lit(None).cast(kind)
    left = left.select(*keys, F.lit(False).alias("_sent"), F.col("word_idx").cast("bigint").alias("_at"), "norm",
                       F.col("start_ms").cast("bigint").alias("start_ms"), F.col("end_ms").cast("bigint").alias("end_ms"), none("array<string>").alias("toks"))
    right = right.select(*keys, F.lit(True).alias("_sent"), F.col("sent_idx").cast("bigint").alias("_at"), F.col("text").alias("norm"),
                         none("bigint").alias("start_ms"), none("bigint").alias("end_ms"), "toks")
    rows = left.unionByName(right).repartition(n, *keys).sortWithinPartitions(*keys, "_sent")
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + (
        ", sent_idx bigint, text string, start_ms bigint, end_ms bigint, confidence double,"
        " start_word_idx bigint, end_word_idx bigint, n_tokens int")

    names = [*keys, "sent_idx", "text", "start_ms", "end_ms", "confidence", "start_word_idx", "end_word_idx", "n_tokens"]

    def of_chunk(key: tuple, group) -> list[tuple]:
        cut = int(np.searchsorted(group["_sent"].to_numpy(zero_copy_only=False), True)) if group.num_rows else 0
        ws, ss = group.slice(0, cut), group.slice(cut)
        if not ws.num_rows or not ss.num_rows:
            return []
        idx = ws["_at"].to_numpy(zero_copy_only=False)
        order = np.argsort(idx, kind="stable")
        idx, begin, end = (ws[c].to_numpy(zero_copy_only=False)[order] for c in ("_at", "start_ms", "end_ms"))
        norms = ws["norm"].to_pylist()
        chunk = _Chunk([norms[i] for i in order])
        by = np.argsort(ss["_at"].to_numpy(zero_copy_only=False), kind="stable")
        toks_of, text_of, sent_of = (ss[c].to_pylist() for c in ("toks", "norm", "_at"))
        out = []
        for i, hit in zip(by, kernel(chunk, [toks_of[i] for i in by])):
            if hit is None:
                continue
            a, b, conf = hit
            found = (int(begin[a]), int(end[b]), float(conf), int(idx[a]), int(idx[b])) if a >= 0 else (None, None, 0.0, -1, -1)
            out.append((*key, sent_of[i], text_of[i], *found, len(toks_of[i])))
        return out

    def run(batches):
        import pyarrow as pa

        out, held, out_schema = [], [], None

        def table(rows: list[tuple]):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        def close() -> None:
            """The chunk whose rows are held has ended."""
            if held:
                key = tuple(held[0].column(k)[0].as_py() for k in keys)
                out.extend(of_chunk(key, held[0] if len(held) == 1 else pa.concat_batches(held)))
                held.clear()

        for batch in batches:
            if out_schema is None:
                out_schema = pa.schema([
                    *[batch.schema.field(k) for k in keys], ("sent_idx", pa.int64()), ("text", pa.string()), ("start_ms", pa.int64()),
                    ("end_ms", pa.int64()), ("confidence", pa.float64()), ("start_word_idx", pa.int64()), ("end_word_idx", pa.int64()),
                    ("n_tokens", pa.int32())])
            if not batch.num_rows:
                continue
            edges = [0, *_key_changes([batch.column(k) for k in keys]), batch.num_rows]
            if held and _key_changes([pa.chunked_array([held[-1].column(k).slice(held[-1].num_rows - 1), batch.column(k).slice(0, 1)]).combine_chunks()
                                      for k in keys]):
                close()
            for a, b in zip(edges, edges[1:]):
                if a:
                    close()
                held.append(batch.slice(a, b - a))
                if len(out) >= 4096:
                    yield table(out)
                    out.clear()
        close()
        if out:
            yield table(out)

    return rows.mapInArrow(run, schema).select(*names)


def _key_changes(columns: list) -> list[int]:
    """Places at which any of the columns has another value than in the row before; nulls are equal to each other."""
    import pyarrow.compute as pc

    changed = None
    for c in columns:
        before, after = c.slice(0, len(c) - 1), c.slice(1)
        other = pc.fill_null(pc.not_equal(before, after), pc.xor(pc.is_null(before), pc.is_null(after)))
        changed = other if changed is None else pc.or_(changed, other)
    return (np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist() if changed is not None else []


def align_monotonic(sentences: DataFrame, words: DataFrame, context: bool = True, keys: Sequence[str] = CHUNK) -> DataFrame:
    """Left-to-right alignment without overlaps; unmatched rows get null times (see ``timing.fallback_times``)."""
    return _fold(sentences, words, "align", lambda c, s: _monotonic(c, s, context), keys)


def align_unused_robust(sentences: DataFrame, words: DataFrame, keys: Sequence[str] = CHUNK) -> DataFrame:
    return _fold(sentences, words, "clean", _unused_robust, keys)


def align_unused_simple(sentences: DataFrame, words: DataFrame, keys: Sequence[str] = CHUNK) -> DataFrame:
    return _fold(sentences, words, "hyphen", _unused_share(0.8, False), keys)


def align_best_sequence(sentences: DataFrame, words: DataFrame, keys: Sequence[str] = CHUNK) -> DataFrame:
    return _fold(sentences, words, "plain", _best_sequence, keys)


def locate_range(sentences: DataFrame, words: DataFrame, keys: Sequence[str] = CHUNK) -> DataFrame:
    return _fold(sentences, words, "clean", _locate, keys)


def align_token_set(sentences: DataFrame, words: DataFrame, keys: Sequence[str] = CHUNK) -> DataFrame:
    return _fold(sentences, words, "plain", _token_set, keys)


def align_fuzzy_unused(sentences: DataFrame, words: DataFrame, floor: float = 0.8, keys: Sequence[str] = CHUNK) -> DataFrame:
    return _fold(sentences, words, "plain", _fuzzy_unused(floor), keys)


def align_contraction(sentences: DataFrame, words: DataFrame, keys: Sequence[str] = CHUNK) -> DataFrame:
    """Exact alignment in which ``what's`` meets ``what s`` and ``o clock`` meets ``o'clock``: words and sentences are
    compared by the parts of their normal forms, and a hit gives the words that hold its first and last part."""
    parts = 1 << 10  # a word's parts take their order from its index
    flat = words.select(*keys, "word_idx", "start_ms", "end_ms", F.posexplode(F.split(norm_align(F.col("word")), " ")).alias("_p", "word"))
    flat = flat.withColumn("word_idx", F.col("word_idx") * parts + F.col("_p"))
    toks = F.flatten(F.transform(align_tokens(F.col("text")), lambda t: F.split(t, " ")))
    out = _fold(sentences, flat, "align", _monotonic_exact, keys, toks)
    back = lambda c: F.when(F.col(c) < 0, F.col(c)).otherwise(F.expr(f"{c} div {parts}"))
    return out.withColumns({c: back(c) for c in ("start_word_idx", "end_word_idx")})


def _monotonic_exact(chunk: _Chunk, sents: list[list[str]]):
    for toks in sents:
        share = chunk.agreement(chunk.codes(toks))
        at = _first(share == len(toks)) if toks else -1
        yield (at, at + len(toks) - 1, 1.0) if at >= 0 else (-1, -1, 0.0)


def char_places(sentences: DataFrame, words: DataFrame, keys: Sequence[str] = CHUNK) -> DataFrame:
    """Each sentence's own place in the cleaned chunk text: the first run of whole free words that equals it, in order
    of the sentences; without one, free words that agree with it in 0.8 of the tokens. Places never overlap, so equal
    sentences take one occurrence after another; sentences without a place keep -1 and null times."""
    parts = 1 << 10  # a word may hold blanks; its parts take their order from its index
    flat = words.select(*keys, "word_idx", "start_ms", "end_ms", F.posexplode(tokens(clean_word(F.col("word")))).alias("_p", "word"))
    flat = flat.withColumn("word_idx", F.col("word_idx") * parts + F.col("_p"))
    out = _fold(sentences, flat, "cased", _own_places, keys, tokens(clean_case(F.col("text"))))
    back = lambda c: F.when(F.col(c) < 0, F.col(c)).otherwise(F.expr(f"{c} div {parts}"))
    return out.withColumns({c: back(c) for c in ("start_word_idx", "end_word_idx")})


def _own_places(chunk: _Chunk, sents: list[list[str]]):
    """Equal free windows for all sentences in turn, then the best agreeing ones for the rest."""
    found: list = [None] * len(sents)
    after: dict[tuple, list[int]] = {}  # of equal sentences, the windows not yet tried
    for i, toks in enumerate(sents):
        if not toks:
            continue
        key = tuple(toks)
        if key not in after:
            after[key] = np.flatnonzero(chunk.agreement(chunk.codes(toks)) == len(toks))[::-1].tolist()
        while after[key] and found[i] is None:
            at = after[key].pop()
            if not chunk.used[at:at + len(toks)].any():
                found[i] = _take(chunk, at, len(toks), 1.0)
    for i, toks in enumerate(sents):
        if toks:
            yield found[i] or _best_share(chunk, toks, 0.8, False, True)
        else:
            yield -1, -1, 0.0
