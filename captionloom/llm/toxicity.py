"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, slices, texts_of
from .words import distinct_words, gram_codes, padded_bytes

DIMS = 1 << 18
GRAM = 5


@dataclass
class Link:
    """One category: weights of hashed features, of the earlier categories' probabilities, and of 1."""

    name: str
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    links: list[Link]
    threshold: float


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words by text ``(doc, word)``, and hashed features by word ``(owner, code)``: the word itself and
    its byte 5-grams with the edges, so that inflected and compound forms share weight."""
    words, doc, word, _ = distinct_words(texts)
    return doc, word, *word_features(words)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, code)`` of the words' features."""
    owner, code = gram_codes(*padded_bytes(words), GRAM, DIMS)
    own = np.fromiter((zlib.crc32(w.encode()) % DIMS for w in words), np.int64, len(words))
    return np.concatenate([owner, np.arange(len(words))]).astype(np.int32), np.concatenate([code, own]).astype(np.int32)


def features_of_all(texts: list[str], step: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``features``, a few texts at a time; a word that comes again keeps its first number."""
    number: dict[str, int] = {}
    docs, words = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for lo in range(0, len(texts), step):
        found, doc, word, _ = distinct_words(texts[lo : lo + step])
        here = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found))
        docs.append((doc + lo).astype(np.int32))
        words.append(here[word])
    listed, owners, codes = list(number), [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    del number
    for lo in range(0, len(listed), 50_000):
        owner, code = word_features(listed[lo : lo + 50_000])
        owners.append(owner + np.int32(lo))
        codes.append(code)
    return np.concatenate(docs), np.concatenate(words), np.concatenate(owners), np.concatenate(codes)


def raw_scores(weights: np.ndarray, n: int, doc, word, owner, code) -> np.ndarray:
    """Sum of the feature weights of each text's distinct words."""
    by_word = np.bincount(owner, weights[code], int(owner.max(initial=-1)) + 1) if len(owner) else np.zeros(0)
    return np.bincount(doc, by_word[word], n) if len(doc) else np.zeros(n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(feats, extra: np.ndarray, y: np.ndarray, use: np.ndarray, l2: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with an L2 penalty by L-BFGS, on the rows where ``use``."""
    doc, word, owner, code = feats
    n, k = extra.shape
    words = int(owner.max(initial=-1)) + 1
    hit = use[doc]
    doc, word = doc[hit], word[hit]

    def cost(v: np.ndarray) -> tuple[float, np.ndarray]:
        by_word = np.bincount(owner, v[:DIMS][code], words)
        z = np.bincount(doc, by_word[word], n) + extra @ v[DIMS : DIMS + k] + v[-1]
        p = sigmoid(z)
        err = np.where(use, p - y, 0.0)
        loss = np.logaddexp(0, np.where(y > 0, -z, z))[use].sum() + l2 / 2 * (v[:-1] @ v[:-1])
        back = np.bincount(word, err[doc], words)
        grad = np.concatenate([np.bincount(code, back[owner], DIMS), extra.T @ err, [err.sum()]])
        grad[:-1] += l2 * v[:-1]
        return loss, grad

    v = np.zeros(DIMS + k + 1)
    rate = min(max(y[use].mean(), 1e-4), 1 - 1e-4)
    v[-1] = np.log(rate / (1 - rate))
    loss, grad = cost(v)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, back = grad.copy(), []
        for s, g, r in reversed(pairs):
            a = r * (s @ d)
            back.append(a)
            d -= a * g
        if pairs:
            s, g, _ = pairs[-1]
            d *= (s @ g) / (g @ g)
        else:
            d /= max(1.0, np.abs(grad).max())
        for (s, g, r), a in zip(pairs, reversed(back), strict=True):
            d += s * (a - r * (g @ d))
        slope, step = -(grad @ d), 1.0
        while True:
            new, new_grad = cost(v - step * d)
            if new <= loss + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, g = -step * d, new_grad - grad
        done = loss - new < 1e-5 * max(1.0, abs(loss))
        v, loss, grad = v + s, new, new_grad
        if s @ g > 1e-12:
            pairs = [*pairs[-7:], (s, g, 1 / (s @ g))]
        if done:
            break
    return v[:DIMS], v[DIMS : DIMS + k], float(v[-1])


def fit_chain(texts: list[str], labels: np.ndarray, names: list[str], folds: np.ndarray, l2: float = 1.0) -> Chain:
    """A chain over the label columns in order (NaN: not labelled).

    The probabilities a later category learns from are out of fold: each row's come from models that have not
    seen the row, so they err in training as they will on new texts. The threshold of the last category is the
    one of best F1 on its out-of-fold probabilities.
    """
    n = len(texts)
    feats = features_of_all(texts)
    held = np.zeros((n, 0))
    links, threshold = [], 0.5
    for k, name in enumerate(names):
        y, known = np.nan_to_num(labels[:, k]), ~np.isnan(labels[:, k])

        def fitted(use: np.ndarray, y=y, held=held) -> tuple[np.ndarray, np.ndarray, float]:
            if not use.any() or len(np.unique(y[use])) < 2:  # one class only: its smoothed rate
                rate = (y[use].sum() + 0.5) / (use.sum() + 1) if use.any() else 1e-6
                return np.zeros(DIMS), np.zeros(held.shape[1]), float(np.log(rate / (1 - rate)))
            return fit_linear(feats, held, y, use, l2)

        out = np.zeros(n)
        for f in np.unique(folds):
            w, e, b = fitted(known & (folds != f))
            out[folds == f] = sigmoid(raw_scores(w, n, *feats) + held @ e + b)[folds == f]
        w, e, b = fitted(known)
        links.append(Link(name, w.astype(np.float32), e, b))
        held = np.column_stack([held, out])
        if k == len(names) - 1 and known.any() and 0 < y[known].sum() < known.sum():
            order = np.argsort(-out[known], kind="stable")
            p, hits = out[known][order], np.cumsum(y[known][order])
            best = int(np.argmax(2 * hits / (np.arange(1, len(p) + 1) + hits[-1])))
            threshold = float((p[best] + (p[best + 1] if best + 1 < len(p) else 0.0)) / 2)
    return Chain(links, threshold)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = 10_000, max_bytes: int = 32 << 20, folds: int = 3, l2: float = 0.1, max_text: int = 1 << 20) -> Chain:
    """Fits the chain on a bounded sample: the ``max_rows`` labelled ids of least hash that ``docs`` has,
    as long as their texts hold ``max_bytes`` in all. Texts of over ``max_text`` bytes (or ``max_bytes``, if less)
    are no part of it and take no one's place; if that leaves none of the labelled documents, or ``docs`` has rows
    and none of them is labelled though labels exist, a ``ValueError`` says so. ``categories`` are 0/1 expressions
    over ``labels``, in chain order. An id labelled more than once counts once (its largest labels), and so does an
    id that ``docs`` repeats (its shortest text); null labels are unknown.
    """
    names = list(categories)
    each = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(c).cast("double").alias(n) for n, c in categories.items()])
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    sized = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    sized = sized.where(F.col("id").isNotNull() & (F.col("size") <= min(max_text, max_bytes)))
    ids = sized.groupBy("id").agg(F.min(F.struct("size", "mark")).alias("least")).join(each.withColumnRenamed("id", "labelled"), F.col("id") == F.col("labelled"))
    ids = ids.select("id", "least.size", "least.mark", *[F.col(n).alias(f"y{k}") for k, n in enumerate(names)])
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(max_rows).toPandas()
    chosen = chosen[chosen["size"].cumsum() <= max_bytes].sort_values("id")
    if not len(chosen):
        if not labels.where(F.col(id_col).isNotNull()).isEmpty() and not docs.isEmpty():
            raise ValueError(f"labels exist, but no labelled document has a text of {min(max_text, max_bytes)} bytes or less")
        return fit_chain([], np.zeros((0, len(names))), names, np.zeros(0, np.int64), l2)
    picked = docs.sparkSession.createDataFrame(chosen[["id", "size", "mark"]])
    got = sized.join(F.broadcast(picked), ["id", "size", "mark"]).groupBy("id").agg(F.min("text").alias("text")).toPandas().sort_values("id")
    part = np.array([zlib.crc32(str(i).encode()) % folds for i in got["id"]])
    known = chosen[[f"y{k}" for k in range(len(names))]].to_numpy(float)
    texts = [t or "" for t in got["text"]]
    del got  # one copy of the texts is enough
    return fit_chain(texts, known, names, part, l2)


def probabilities(texts: list[str], chain: Chain) -> np.ndarray:
    """Of each text and category, in chain order."""
    feats, probs = features(texts), np.zeros((len(texts), 0))
    for link in chain.links:
        z = raw_scores(link.weights, len(texts), *feats) + probs @ link.earlier + link.bias
        probs = np.column_stack([probs, sigmoid(z)])
    return probs


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id_col, p_<category>..., <last category> boolean)`` from the whole text.

    Each category's linear score takes the probabilities of the categories before it as features. Null and
    empty texts, and texts without letters, get what the biases alone give. Repeated rows come out as often
    as they come; an empty table gives an empty result; other columns are not read.
    """
    names = [link.name for link in chain.links]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            probs = probabilities(texts_of(part), chain)
            cols = [column(part, "id"), *[pa.array(probs[:, k]) for k in range(len(names))], pa.array(probs[:, -1] >= chain.threshold)]
            yield pa.RecordBatch.from_arrays(cols, ["id", *[f"p_{n}" for n in names], names[-1]])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"p_{n} double" for n in names) + f", {names[-1]} boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def default_categories() -> dict[str, Column]:
    """The label columns of ``labels``, as a chain: low quality first, toxic last."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The documents the chain does not reject, with all their columns; rows pass through, so nothing is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield part.filter(pa.array(probabilities(texts_of(part, text), chain)[:, -1] < chain.threshold))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of any kind
    text = f"c{docs.columns.index(text_col)}"
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
