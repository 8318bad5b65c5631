"""Language identification by mixture inference: each document's language proportions by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices, texts_of
from .words import distinct_words, gram_codes, padded_bytes

GRAMS = (3, 4)
DIMS = 1 << 16
UNKNOWN = "und"
#: A word counts for no more than this ratio for one language against another.
FLOOR = 1e-4


@dataclass
class Model:
    """Log-probabilities of hashed byte n-grams by language: ``log_p[code, language]``."""

    languages: list[str]
    log_p: np.ndarray


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(word, code)`` of all n-grams of the words; each length has codes of its own."""
    data, starts = padded_bytes(words)
    parts = [gram_codes(data, starts, n, DIMS) for n in GRAMS]
    return np.concatenate([w for w, _ in parts]), np.concatenate([c + i * DIMS for i, (_, c) in enumerate(parts)])


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, code, n)``: n-gram counts of all given documents by their language, added up before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, t in totals.items():
                code = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(t[code])], ["lang", "code", "n"])
            totals.clear()

        for part in slices(batches, "text"):
            langs = np.array(column(part, "lang").to_pylist(), object)
            words, doc, word, count = distinct_words(texts_of(part))
            owner, code = word_grams(words)
            for lang in dict.fromkeys(langs):
                mine = (langs == lang)[doc]
                per_word = np.bincount(word[mine], count[mine], len(words))
                t = np.bincount(code, per_word[owner], len(GRAMS) * DIMS)
                totals[lang] = totals.get(lang, 0) + t.astype(np.int64)
            if len(totals) > 32:
                yield from flush()
        yield from flush()

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.1) -> Model:
    """The model of all documents with a language. What reaches the driver is a row per language and
    hashed n-gram that occurs, 2 * 65,536 a language at most, however large the input."""
    got = gram_counts(docs, text_col, lang_col).toPandas()
    languages = sorted(got["lang"].unique())
    counts = np.zeros((len(GRAMS) * DIMS, len(languages)))
    if languages:
        counts[got["code"].to_numpy(), np.searchsorted(np.array(languages, object), got["lang"].to_numpy(object))] = got["n"]
    log_p = np.empty_like(counts, np.float32)
    for i in range(len(GRAMS)):
        part = counts[i * DIMS : (i + 1) * DIMS] + smoothing
        log_p[i * DIMS : (i + 1) * DIMS] = np.log(part / part.sum(axis=0, keepdims=True))
    return Model(languages, log_p)


def proportions(q: np.ndarray, weight: np.ndarray, first: np.ndarray, mask: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of the mixtures of several documents at once: ``(shares, log-likelihood)``.

    ``q``: likelihood of each document's words by language, ``weight`` how often each occurs, ``first`` where each
    document's words begin; ``mask``: the languages a document may have.
    """
    rows = np.diff(first, append=len(q))
    n = np.add.reduceat(weight, first)
    pi = mask / mask.sum(axis=1, keepdims=True)
    for _ in range(steps):
        joint = q * np.repeat(pi, rows, axis=0)
        total = joint.sum(axis=1)
        new = np.add.reduceat(joint * (weight / total)[:, None], first, axis=0) / n[:, None]
        moved = np.abs(new - pi).max()
        pi = new
        if moved < 1e-3:
            break
    total = (q * np.repeat(pi, rows, axis=0)).sum(axis=1)
    return pi, np.add.reduceat(weight * np.log(np.maximum(total, 1e-300)), first)


def mixtures(q: np.ndarray, weight: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Language shares of each document, zero outside the language set of best penalised likelihood.

    All languages are fitted first. Those expected to hold half a word or more are candidates; the sets tried
    are the 1, 2, ... candidates of largest share, each fitted anew. A language more costs ``penalty`` times half
    the logarithm of the number of words.
    """
    n = np.add.reduceat(weight, first)
    pi, _ = proportions(q, weight, first, np.ones((len(first), q.shape[1])))
    rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1, kind="stable")
    size = np.maximum(1, (pi * n[:, None] >= 0.5).sum(axis=1))
    best = (rank == 0).astype(float)
    value = np.full(len(first), -np.inf)
    rows = np.diff(first, append=len(q))
    for k in range(1, int(size.max(initial=1)) + 1):
        some = np.flatnonzero((size >= k) & (size > 1))
        if not len(some):
            break
        at = np.repeat(np.isin(np.arange(len(first)), some), rows)
        sub_first = np.cumsum(rows[some]) - rows[some]
        p, ll = proportions(q[at], weight[at], sub_first, (rank[some] < k).astype(float))
        v = ll - penalty * (k - 1) * 0.5 * np.log(n[some] + 1)
        better = v > value[some]
        best[some[better]], value[some[better]] = p[better], v[better]
    return best


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 3.0) -> DataFrame:
    """One row per document: ``(id_col, lang_pred, score, languages, shares)`` from the whole text alone.

    ``languages`` are the languages of the document's set, largest share first, and ``shares`` their parts of its
    words; ``lang_pred`` and ``score`` are the first of each. A text that is null, empty or without letters, or a model
    without languages, gives ``und``, 0 and empty lists. Equal shares go to the language first in code-point
    order. Repeated rows come out as often as they come; other columns are not read.
    """
    names = np.array(model.languages, object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            langs, shares = [[]] * part.num_rows, [[]] * part.num_rows
            words, doc, word, count = distinct_words(texts_of(part))
            alpha = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in words), bool, len(words))
            doc, word, count = doc[alpha[word]], word[alpha[word]], count[alpha[word]]
            if len(doc) and len(names):
                owner, code = word_grams(words)
                ll = np.column_stack([np.bincount(owner, model.log_p[code, k], len(words)) for k in range(len(names))])
                q = np.maximum(np.exp(ll - ll.max(axis=1, keepdims=True)), FLOOR)
                has, first = np.unique(doc, return_index=True)
                pi = mixtures(q[word], count.astype(float), first, penalty)
                order = np.argsort(-pi, axis=1, kind="stable")
                for d, p, o in zip(has.tolist(), pi, order, strict=True):
                    o = o[p[o] > 0]
                    langs[d], shares[d] = names[o].tolist(), np.clip(p[o], 0, 1).tolist()
            cols = [column(part, "id"), pa.array([x[0] if x else UNKNOWN for x in langs], pa.string()), pa.array([x[0] if x else 0.0 for x in shares], pa.float64()),
                    pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "lang_pred", "score", "languages", "shares"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, languages array<string>, shares array<double>").withColumnRenamed("id", id_col)

