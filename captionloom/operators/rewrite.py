"""Glossary rules by the hundred thousand: a trie with failure links finds the rules a text can meet."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from unicodedata import category

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Bytes a rule's letters take in the trie, about; its nodes dominate what a task holds.
NODE_BYTES = 48


def fold_char(c: str) -> str:
    """A character regardless of case: the lower case of its upper case, where both are one character. So folded
    texts keep their positions."""
    up = c.upper()
    up = up if len(up) == 1 else c
    low = up.lower()
    return low if len(low) == 1 else up


class Folding(dict):
    """Translation table for ``str.translate``, filled as characters come up."""

    def __missing__(self, code: int) -> str:
        self[code] = got = fold_char(chr(code))
        return got


def is_word(c: str) -> bool:
    return c == "_" or category(c)[0] in "LN"


class Words(dict):
    """Whether a character belongs to words, filled as characters come up."""

    def __missing__(self, c: str) -> bool:
        self[c] = got = is_word(c)
        return got


class Rewriter:
    """Rules in order, ready to be applied to texts.

    All terms stand in one trie with failure links, so one pass over a text finds every rule that occurs in it, whatever
    the number of rules. Rules are taken from a queue in their order. What a rule inserts can complete a term of a
    later rule; so after a rule has changed a text, the surroundings of the change, as far as the longest term
    reaches, go through the trie again, and later rules found there join the queue. Thus a text costs its own
    length and its own changes, and the outcome is that of all rules applied one after another.
    """

    def __init__(self, rules: Sequence[tuple[str, str]]):
        import ahocorasick

        self.folding, self.words = Folding(), Words()
        self.rules = [(t.translate(self.folding), r, r.translate(self.folding)) for t, r in rules]
        by_term: dict[str, list[int]] = {}
        for i, (term, _, _) in enumerate(self.rules):
            if term:
                by_term.setdefault(term, []).append(i)
        self.trie = ahocorasick.Automaton()
        for term, places in by_term.items():
            self.trie.add_word(term, (len(term), tuple(places)))
        self.any = bool(by_term)
        self.longest = max(map(len, by_term), default=0)
        if self.any:
            self.trie.make_automaton()

    def _whole(self, text: str, at: int, end: int) -> bool:
        """A word border on both sides of ``text[at:end]``."""
        word = self.words
        left = at > 0 and word[text[at - 1]]
        right = end < len(text) and word[text[end]]
        return left != word[text[at]] and right != word[text[end - 1]]

    def _found(self, text: str, low: int, high: int, after: int, queue: list[int], queued: set[int]) -> None:
        word, n = self.words, len(text)
        for last, (size, places) in self.trie.iter(text, low, high):
            # most hits lie inside words: the border behind them is looked at first
            end = last + 1
            if places[-1] <= after or (end < n and word[text[end]]) == word[text[last]] or places[-1] in queued and len(places) == 1:
                continue
            at = end - size
            if (at > 0 and word[text[at - 1]]) != word[text[at]]:
                for i in places:
                    if i > after and i not in queued:
                        queued.add(i)
                        heapq.heappush(queue, i)

    def __call__(self, text: str) -> str:
        if not text or not self.any:
            return text
        folded = text.translate(self.folding)
        queue: list[int] = []
        queued: set[int] = set()
        self._found(folded, 0, len(folded), -1, queue, queued)
        while queue:
            i = heapq.heappop(queue)
            term, new, new_folded = self.rules[i]
            places, at = [], folded.find(term)
            while at >= 0:
                end = at + len(term)
                if self._whole(folded, at, end):
                    places.append(at)
                    at = folded.find(term, end)
                else:
                    at = folded.find(term, at + 1)
            if not places:
                continue
            parts, folds, done, spans, shift = [], [], 0, [], 0
            for at in places:
                parts += [text[done:at], new]
                folds += [folded[done:at], new_folded]
                done = at + len(term)
                spans.append((at + shift, at + shift + len(new)))
                shift += len(new) - len(term)
            text, folded = "".join([*parts, text[done:]]), "".join([*folds, folded[done:]])
            reach = self.longest + 1  # a term that touches the change may have become a whole word
            low = high = None
            for a, b in spans:
                a, b = max(0, a - reach), min(len(folded), b + reach)
                if high is not None and a <= high:
                    high = b
                    continue
                if high is not None:
                    self._found(folded, low, high, i, queue, queued)
                low, high = a, b
            self._found(folded, low, high, i, queue, queued)
        return text


def _rewriting(rules: list[tuple[str, str]]):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = Rewriter(rules)
        for part in texts:
            yield pd.Series([t if t is None else rewrite(t) for t in part], dtype=object)

    return F.pandas_udf(run, "string")


def rule_parts(rules: DataFrame, max_bytes: int) -> Iterable[list[tuple[str, str]]]:
    """The rules in order, in lists whose trie takes at most ``max_bytes`` (one rule at least).

    A running sum of the rules' sizes, made in blocks of the sorted rules, cuts them before any reaches the driver, which
    then holds one list at a time.
    """
    rows = rules.select("ord", "term", "replacement").where("term is not null and replacement is not null").distinct()
    size = (F.char_length("term") * NODE_BYTES + F.char_length("term") + F.char_length("replacement") * 2 + 64).cast("bigint")
    order = ["ord", "term", "replacement"]
    rows = rows.withColumn("size", size).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows, "rules")
    inner = Window.partitionBy("part").orderBy("at")
    sums = rows.groupBy("part").agg(F.sum("size").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition of the sort
    sums = sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("skip"))
    start = F.col("skip") + F.sum("size").over(inner) - F.col("size")
    cut = rows.join(F.broadcast(sums), "part").withColumn("list", F.floor(start / max_bytes))
    cut = materialize(cut.select("list", "at", "term", "replacement"), "rule-lists")
    for n in [r[0] for r in cut.select("list").distinct().orderBy("list").collect()]:
        got = cut.where(F.col("list") == n).orderBy("at").select("term", "replacement").toPandas()
        yield list(zip(got["term"], got["replacement"], strict=True))


def apply_rules(df: DataFrame, rules: DataFrame, text: str = "text", max_bytes: int = 256 << 20) -> DataFrame:
    """Replace whole words, ignoring case, rule after rule in ``ord`` order, each on the result of those before it: what
    ``lookup.apply_glossary`` gives, for any number of rules.

    ``rules``: ``ord, term, replacement``; a rule given twice counts once, a null or empty term never occurs. All rules go
    through each text in one pass of one Python worker, without a table between. The trie is measured
    before it is shipped: rules whose trie would exceed ``max_bytes`` go in several passes, in order, still in
    one stage. Null texts stay null, other columns never leave the JVM.
    """
    for part in rule_parts(rules, max_bytes):
        df = df.withColumn(text, _rewriting(part)(F.col(text)))
    return df
