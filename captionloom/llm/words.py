"""Words of a batch of texts, each distinct one once."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd

#: Runs of letters, cut where longer than 40 (scripts without spaces).
LETTERS = re.compile(r"[^\W\d_]{1,40}")


def distinct_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """``(words, doc, word, count)``: the distinct lower-case words, and how often each text has each of them."""
    found = [LETTERS.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    codes, words = pd.factorize(np.array(list(chain.from_iterable(found)), object))
    pair = np.repeat(np.arange(len(texts), dtype=np.int64), sizes) * max(1, len(words)) + codes
    pair.sort()
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    count = np.diff(first, append=len(pair))
    doc, word = np.divmod(pair[first], max(1, len(words)))
    return list(words), doc, word, count


def padded_bytes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words in UTF-8, each between two bytes 1, one after another; and where each begins, with the end."""
    parts = [w.encode() for w in words]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 2, out=starts[1:])
    joined = b"\x01" + b"\x01\x01".join(parts) + b"\x01" if parts else b""
    return np.frombuffer(joined, np.uint8), starts


def gram_codes(data: np.ndarray, starts: np.ndarray, n: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte ``n``-grams within the padded words: ``(word, code)`` by position."""
    size = np.diff(starts)
    per = np.maximum(size - n + 1, 0)
    word = np.repeat(np.arange(len(size)), per)
    at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + starts[word]
    code = np.full(len(at), 1469598103934665603 + n, np.uint64)
    for i in range(n):
        code = (code ^ data[at + i]) * np.uint64(1099511628211)
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return word, ((code >> np.uint64(32)) % np.uint64(dims)).astype(np.int64)
