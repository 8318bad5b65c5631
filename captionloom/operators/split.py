"""Length-bounded splitting of sentences, inside the row and inside the JVM.

Every splitter takes a text column and returns ``array<string>``; a text that cannot be split
comes back as a one-element array. Texts are white-space collapsed first, so lengths of trimmed
pieces are plain integer arithmetic on match offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARK, MARK_END, PROTECTED, SPACE, collapse, explode_parts, split_on, strip, sub, unicode_regex
from .segment import pack_words

MAX_CHARS = 80

# fixed values: break patterns of the splitters
BALANCED = (
    r"\b(if|because|which|but|and|so|then|however|therefore|meanwhile|while|although|unless|since|like|when"
    r"|where|until|after|before|in|on|at|with|for)\b"
)
CONJUNCTIONS = r"\b(because|which|but|and|so|then|however|therefore|meanwhile|while|although|unless|since)\b"
GRAMMAR = (
    r"\b(and|but|or|so|because|since|while|although|however|therefore|meanwhile)\b",
    r"[,;:]",
    r"\.",
)
NATURAL = (
    r"\b(you know|I mean|like|well|okay|alright|actually|basically)\b",
    r"\b(and then|but then|so then|after that|next|later|meanwhile|finally)\b",
    r"\b(if I|when I|because I|so I|then I|now I)\b",
    r"(\. |! |\? )",
)
SAFE = (
    r"\b(and then|but then|so then)\b",
    r"\b(you know|I mean|actually|basically)\b",
    r"[,;] ",
)
SEMANTIC = (
    r"\b(and|but|so|then|well|like|you know|actually|honestly|really)\s+",
    r"\s+(that|which|who|where|when|while|since|because|if|unless|although)\s+",
    r"\b(funny story|by the way|speaking of|meanwhile|however|therefore|anyway)\s+",
    r"\b(here|there|now|then|after|before|during|while|when)\s+",
    r"\b(I mean|in other words|that is|for example|such as)\s+",
    r"(\w+)(\s+[^.!?]*?\s+)\1\b",
)

# the last one for collapsed texts, whose only white space is single blanks
REPEATED = r"(\w+)( [^.!?]*? )\1\b"


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _one(text: Column) -> Column:
    return F.array(text)


def _collapsed(text: Column, body, ready: bool) -> Column:
    """``body`` of the collapsed text; with ``ready`` the text is so already, as where one text goes through many tries."""
    return body(text) if ready else let(collapse(text), body)


def _multi(parts: Column, text: Column) -> Column:
    return let(parts, lambda p: F.when(F.size(p) > 1, p).otherwise(_one(text)))


def _char(text: Column, at: Column) -> Column:
    """1 when the character at offset ``at`` is a blank."""
    return F.when(F.substr(text, at + 1, F.lit(1)) == " ", 1).otherwise(0)


def spans(text: Column, pattern: str, edge: str = "") -> Column:
    """Offsets of all matches: ``array<struct<s,e>>``.

    With ``edge="s"`` also ``before`` and ``at_s``, 1 when the character before/at the start is a blank;
    with ``edge="e"`` the same for the end as ``last`` and ``at_e``.
    """
    pieces = F.split(sub(text, unicode_regex(pattern), f"{MARK}$0{MARK_END}"), MARK, -1)
    empty = F.expr("cast(array() as array<struct<s:int,e:int>>)")

    def offsets(ps: Column) -> Column:
        # every piece but the first is: match, end mark, text up to the next match
        return F.aggregate(
            F.slice(ps, F.lit(2), F.size(ps)),
            F.struct(F.length(F.get(ps, F.lit(0))).alias("pos"), empty.alias("out")),
            lambda acc, p: F.struct(
                (acc["pos"] + F.length(p) - 1).alias("pos"),
                F.array_append(acc["out"], F.struct(
                    acc["pos"].alias("s"), (acc["pos"] + F.locate(MARK_END, p) - 1).alias("e"))).alias("out")),
            lambda acc: acc["out"])

    found = let(pieces, offsets)
    if edge == "s":
        return F.transform(found, lambda m: F.struct(
            m["s"].alias("s"), m["e"].alias("e"),
            F.when(m["s"] > 0, _char(text, m["s"] - 1)).otherwise(0).alias("before"), _char(text, m["s"]).alias("at_s")))
    if edge == "e":
        return F.transform(found, lambda m: F.struct(
            m["s"].alias("s"), m["e"].alias("e"), _char(text, m["e"] - 1).alias("last"), _char(text, m["e"]).alias("at_e")))
    return found


def cut_at(text: Column, cuts: Column) -> Column:
    """Trimmed, non-empty pieces of ``text`` between ascending offsets."""
    edges = F.concat(F.array(F.lit(0)), cuts)
    nexts = F.concat(cuts, F.array(F.length(text)))
    pieces = F.zip_with(edges, nexts, lambda a, b: strip(F.substr(text, a + 1, b - a)))
    return F.filter(pieces, lambda p: p != "")


_NO_CUTS = "cast(array() as array<int>)"


# ------------------------------------------------------------------ punctuation

def split_terminal(text: Column) -> Column:
    """After ``.``, ``!``, ``?`` followed by white space."""
    parts = F.filter(F.transform(split_on(text, rf"([.!?])[{SPACE}]+", "$1"), strip), lambda p: p != "")
    return _multi(parts, text)


def split_commas(text: Column, min_len: int = 15) -> Column:
    """After commas; a part shorter than ``min_len`` takes in the next one."""
    raw = split_on(text, rf"(,)[{SPACE}]*", "$1")
    tidy = F.transform(raw, lambda p: F.when(
        F.endswith(p, F.lit(",")), F.concat(strip(F.substr(p, F.lit(1), F.length(p) - 1)), F.lit(","))).otherwise(strip(p)))
    merged = F.aggregate(
        F.filter(tidy, lambda p: p != ""),
        F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) < min_len),
            F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                           strip(F.concat_ws(" ", F.element_at(acc, -1), p)))
        ).otherwise(F.array_append(acc, p)))
    return F.when(text.contains(","), _multi(merged, text)).otherwise(_one(text))


def pack_punct(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """Pieces ending in ``.!?;:`` packed greedily up to ``max_chars`` (a longer piece stays whole)."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)[^.!?;:]*[.!?;:]|[^.!?;:]+\z"), F.lit(0))
    state = F.struct(F.lit("").alias("cur"), F.expr("cast(array() as array<string>)").alias("out"))
    folded = F.aggregate(
        pieces, state,
        lambda acc, p: F.when(
            F.length(acc["cur"]) + F.length(p) <= max_chars,
            F.struct(F.concat(acc["cur"], p).alias("cur"), acc["out"].alias("out"))
        ).otherwise(F.struct(p.alias("cur"), F.array_append(acc["out"], strip(acc["cur"])).alias("out"))),
        lambda acc: F.filter(F.array_append(acc["out"], strip(acc["cur"])), lambda p: p != ""))
    return F.when(text.rlike("[.!?;:]"), _multi(folded, text)).otherwise(_one(text))


# ------------------------------------------------------------------ pattern cuts

def split_balanced(text: Column, pattern: str = BALANCED, max_chars: int = MAX_CHARS) -> Column:
    """Cut before the match that balances both sides best, then go on with the right side while it is too long.

    Badness is the distance of the left length from half, plus 50 if a side has under 15 characters,
    plus 100 if the right side is still too long; the left side must fit.
    """

    def body(v: Column) -> Column:
        n, marks = F.length(v["t"]), v["m"]

        def best(cur: Column) -> Column:
            near = F.filter(marks, lambda m: (m["s"] > cur) & (m["s"] - cur - m["before"] <= max_chars)
                            & (m["s"] - cur - m["before"] > 0))

            def rated(m: Column) -> Column:
                left, right = m["s"] - cur - m["before"], n - m["s"]
                score = F.abs(left - F.floor((left + right) / 2))
                score = score + F.when((left < 15) | (right < 15), 50).otherwise(0)
                return F.struct((score + F.when(right > max_chars, 100).otherwise(0)).alias("k"), m["s"].alias("s"))

            return F.array_min(F.transform(near, rated))["s"]

        state = F.struct(F.lit(0).alias("cur"), F.expr(_NO_CUTS).alias("cuts"), F.lit(False).alias("done"))

        def step(acc: Column, _: Column) -> Column:
            def take(s: Column) -> Column:
                return F.when(s.isNull(), F.struct(acc["cur"].alias("cur"), acc["cuts"].alias("cuts"), F.lit(True).alias("done"))
                              ).otherwise(F.struct(
                                  s.alias("cur"), F.array_append(acc["cuts"], s).alias("cuts"),
                                  (n - s <= max_chars).alias("done")))
            return F.when(acc["done"], acc).otherwise(let(best(acc["cur"]), take))

        rounds = F.when(F.size(marks) > 0, F.sequence(F.lit(1), F.size(marks))).otherwise(F.expr(_NO_CUTS))
        cuts = F.aggregate(rounds, state, step, lambda acc: acc["cuts"])
        return cut_at(v["t"], cuts)

    t = collapse(text)
    return let(t, lambda x: let(F.struct(x.alias("t"), spans(x, pattern, "s").alias("m")), body))


def split_midpoint(text: Column, pattern: str, max_chars: int = MAX_CHARS, min_len: int = 20, ready: bool = False) -> Column:
    """One cut after the match nearest to the middle that leaves both sides within min_len..max_chars."""

    def body(v: Column) -> Column:
        n = F.length(v["t"])
        ok = F.filter(v["m"], lambda m: (m["e"] - m["last"]).between(min_len, max_chars)
                      & (n - m["e"] - m["at_e"]).between(min_len, max_chars))
        at = F.array_min(F.transform(ok, lambda m: F.struct(
            F.abs(m["e"] - F.floor(n / 2)).alias("k"), m["e"].alias("e"))))["e"]
        return let(at, lambda e: F.when(e.isNull(), _one(v["t"])).otherwise(cut_at(v["t"], F.array(e))))

    def fits(x: Column) -> Column:
        # a single cut cannot help a text of more than two full parts
        return F.when(F.length(x) > 2 * max_chars + 2, _one(x)).otherwise(
            let(F.struct(x.alias("t"), spans(x, pattern, "e").alias("m")), body))

    return _collapsed(text, fits, ready)


def _first_split(tries, text: Column) -> Column:
    """The first of the tries, made of the collapsed text, that splits; else the text as it is."""
    each = lambda t: F.coalesce(*[let(p, lambda x: F.when(F.size(x) > 1, x)) for p in tries(t)])
    return F.coalesce(let(collapse(text), each), _one(text))


def split_safe(text: Column, max_chars: int = MAX_CHARS, min_len: int = 15, only_protected: bool = False, ready: bool = False) -> Column:
    """First cut after a safe pattern that lies outside every protected phrase and leaves fitting sides.

    With ``only_protected`` a text without any protected phrase is left whole. The phrases are searched
    only where a cut would fit.
    """

    def fits(x: Column) -> Column:
        n = F.length(x)
        marks = F.filter(
            F.concat(*[spans(x, p, "e") for p in SAFE]),
            lambda m: (m["e"] - m["last"]).between(min_len, max_chars) & (n - m["e"] - m["at_e"]).between(min_len, max_chars))

        def outside(ok: Column) -> Column:
            def first(kept: Column) -> Column:
                free = F.filter(ok, lambda m: ~F.exists(kept, lambda r: (r["s"] <= m["e"]) & (m["e"] <= r["e"])))
                at = F.get(free, F.lit(0))["e"]
                cut = F.when(at.isNull(), _one(x)).otherwise(cut_at(x, F.array(at)))
                return F.when(F.size(kept) == 0, _one(x)).otherwise(cut) if only_protected else cut

            return F.when(F.size(ok) == 0, _one(x)).otherwise(let(F.concat(*[spans(x, p) for p in PROTECTED]), first))

        # a single cut cannot help a text of more than two full parts
        return F.when(n > 2 * max_chars + 2, _one(x)).otherwise(let(marks, outside))

    return _collapsed(text, fits, ready)


def split_grammar(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """Safe cut when a protected phrase is present, then natural breaks, then grammar points; first that splits."""

    def tries(t: Column) -> list[Column]:
        natural = [split_midpoint(t, p, max_chars, 15, ready=True) for p in NATURAL]
        grammar = [split_midpoint(t, p, max_chars, 20, ready=True) for p in GRAMMAR]
        return [split_safe(t, max_chars, only_protected=True, ready=True), *natural, *grammar]

    return _first_split(tries, text)


def split_greedy_before(text: Column, pattern: str = CONJUNCTIONS, max_chars: int = MAX_CHARS, min_len: int = 20,
                        ready: bool = False) -> Column:
    """Cut before every match whose left part has min_len..max_chars and leaves more than min_len."""

    def body(v: Column) -> Column:
        n = F.length(v["t"])
        state = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("pad"), F.expr(_NO_CUTS).alias("cuts"))

        def step(acc: Column, m: Column) -> Column:
            left = m["s"] - acc["cur"] - m["before"] - acc["pad"]
            ok = left.between(min_len, max_chars) & (n - m["s"] - m["at_s"] > min_len)
            return F.when(ok, F.struct(
                m["s"].alias("cur"), m["at_s"].alias("pad"), F.array_append(acc["cuts"], m["s"]).alias("cuts"))).otherwise(acc)

        return cut_at(v["t"], F.aggregate(v["m"], state, step, lambda acc: acc["cuts"]))

    return _collapsed(text, lambda x: let(F.struct(x.alias("t"), spans(x, pattern, "s").alias("m")), body), ready)


def split_greedy_after(text: Column, max_chars: int = MAX_CHARS, min_len: int = 20) -> Column:
    """Cut after matches of the first grammar pattern for which all parts fit; a too long part ends the try."""

    def one(x: Column, pattern: str) -> Column:
        def body(v: Column) -> Column:
            state = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("pad"), F.expr(_NO_CUTS).alias("cuts"), F.lit(False).alias("stop"))

            def step(acc: Column, m: Column) -> Column:
                left = m["e"] - acc["cur"] - m["last"] - acc["pad"]
                cut = F.struct(m["e"].alias("cur"), m["at_e"].alias("pad"),
                               F.array_append(acc["cuts"], m["e"]).alias("cuts"), F.lit(False).alias("stop"))
                halt = F.struct(acc["cur"].alias("cur"), acc["pad"].alias("pad"), acc["cuts"].alias("cuts"), F.lit(True).alias("stop"))
                return F.when(acc["stop"] | (left < min_len), acc).when(left <= max_chars, cut).otherwise(halt)

            return cut_at(v["t"], F.aggregate(v["m"], state, step, lambda acc: acc["cuts"]))

        parts = let(F.struct(x.alias("t"), spans(x, pattern, "e").alias("m")), body)
        return let(parts, lambda p: F.when(F.forall(p, lambda x: F.length(x) <= max_chars), p).otherwise(_one(text)))

    return _first_split(lambda x: [one(x, p) for p in GRAMMAR], text)


def split_semantic(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """First semantic break pattern that splits (the last one is a repeated word).

    The search for a repeated word starts anew at every character and may run to the end of the text. The first cut lies
    within ``max_chars``, so a text without a match that starts there needs no search of the rest.
    """
    near = unicode_regex(rf"(?s)\A.{{0,{max_chars + 2}}}?{REPEATED}")

    def tries(t: Column) -> list[Column]:
        repeated = F.when(t.rlike(near), split_greedy_before(t, REPEATED, max_chars, ready=True))
        return [*[split_greedy_before(t, p, max_chars, ready=True) for p in SEMANTIC[:-1]], repeated]

    return _first_split(tries, text)


# ------------------------------------------------------------------ cuts at word positions

def cut_words(toks: Column, cuts: Column) -> Column:
    """Texts of the token runs between ascending token offsets."""
    edges = F.concat(F.array(F.lit(0)), cuts)
    nexts = F.concat(cuts, F.array(F.size(toks)))
    runs = F.zip_with(edges, nexts, lambda a, b: F.array_join(F.slice(toks, a + 1, F.greatest(b - a, F.lit(0))), " "))
    return F.filter(runs, lambda p: p != "")


def split_at_bounds(toks: Column, bounds: Column, max_chars: int = MAX_CHARS, min_len: int = 15) -> Column:
    """Cut a token list at the given token offsets (recognizer boundaries) where the part has
    min_len..max_chars; if a part stays too long the text is left whole."""
    text = F.array_join(toks, " ")
    state = F.struct(F.lit(0).alias("cur"), F.expr(_NO_CUTS).alias("cuts"))

    def step(acc: Column, b: Column) -> Column:
        size = F.length(F.array_join(F.slice(toks, acc["cur"] + 1, F.greatest(b - acc["cur"], F.lit(0))), " "))
        return F.when(size.between(min_len, max_chars), F.struct(
            b.alias("cur"), F.array_append(acc["cuts"], b).alias("cuts"))).otherwise(acc)

    parts = cut_words(toks, F.aggregate(F.array_sort(bounds), state, step, lambda acc: acc["cuts"]))
    return let(parts, lambda p: F.when(
        (F.size(p) > 1) & F.forall(p, lambda x: F.length(x) <= max_chars), p).otherwise(_one(text)))


def split_at_bounds_merging(toks: Column, bounds: Column, max_chars: int = MAX_CHARS, min_len: int = 15) -> Column:
    """As ``split_at_bounds``, but a short part joins the part before it; a part that can neither stand
    alone nor join leaves the text whole. Every word is kept exactly once."""
    text = F.array_join(toks, " ")
    starts = F.concat(F.array(F.lit(0)), F.array_sort(bounds))
    ends = F.concat(F.array_sort(bounds), F.array(F.size(toks)))
    pieces = F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(toks, a + 1, F.greatest(b - a, F.lit(0))), " "))
    state = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(True).alias("ok"))

    def step(acc: Column, p: Column) -> Column:
        n, out = F.length(p), acc["out"]
        joined = F.concat_ws(" ", F.element_at(out, -1), p)
        alone = F.struct(F.array_append(out, p).alias("out"), acc["ok"].alias("ok"))
        together = F.struct(
            F.array_append(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), joined).alias("out"), acc["ok"].alias("ok"))
        fail = F.struct(out.alias("out"), F.lit(False).alias("ok"))
        return F.when(n == 0, acc).when(n.between(min_len, max_chars), alone).when(
            (F.size(out) > 0) & (n < min_len), together).otherwise(fail)

    res = F.aggregate(pieces, state, step)
    return let(res, lambda r: F.when(
        r["ok"] & (F.size(r["out"]) > 1) & F.forall(r["out"], lambda x: F.length(x) <= max_chars), r["out"]
    ).otherwise(_one(text)))


def split_by_pauses(ws: Column, max_gap_ms: int = 1000, min_len: int = 10, compat: bool = False) -> Column:
    """Cut a sentence's words (``array<struct<word,start_ms,end_ms>>``) at pauses inside it.

    A part under ``min_len`` characters joins its neighbour; with ``compat`` it is dropped, text and all.
    """
    toks = F.transform(ws, lambda w: w["word"])
    text = F.array_join(toks, " ")
    idx = F.when(F.size(ws) > 1, F.sequence(F.lit(1), F.size(ws) - 1)).otherwise(F.expr(_NO_CUTS))
    cuts = F.filter(idx, lambda i: F.get(ws, i)["start_ms"] - F.get(ws, i - 1)["end_ms"] > max_gap_ms)
    parts = cut_words(toks, cuts)
    if compat:
        return _multi(F.filter(parts, lambda p: F.length(p) >= min_len), text)
    merged = F.aggregate(
        parts, F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & ((F.length(p) < min_len) | (F.length(F.element_at(acc, -1)) < min_len)),
            F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                           F.concat_ws(" ", F.element_at(acc, -1), p))).otherwise(F.array_append(acc, p)))
    return _multi(merged, text)


# ------------------------------------------------------------------ cascades

def _cascade(text: Column, profile: str, max_chars: int, bounds: Column | None = None) -> Column:
    if profile == "a":
        tries = [split_terminal(text), split_commas(text), split_balanced(text, BALANCED, max_chars)]
        if bounds is not None:
            # only where punctuation gives no cut
            tries.insert(2, F.when(F.size(bounds) > 0, split_at_bounds(F.split(text, " "), bounds, max_chars)))
    elif profile == "b":
        tries = [split_grammar(text, max_chars)]
        if bounds is not None:
            tries.insert(0, F.when(F.size(bounds) > 0, split_at_bounds_merging(F.split(text, " "), bounds, max_chars)))
    elif profile == "c":
        tries = [split_greedy_after(text, max_chars)]
    elif profile == "d":
        tries = [split_greedy_before(text, CONJUNCTIONS, max_chars), pack_punct(text, max_chars), split_semantic(text, max_chars)]
    elif profile == "plain":
        tries = [split_terminal(text), split_commas(text)]
    else:
        raise ValueError(f"unknown profile {profile!r}")
    if profile in "bc":
        # these two accept a try only when every part fits
        tries = [let(t, lambda p: F.when(p.isNotNull() & F.forall(p, lambda x: F.length(x) <= max_chars), p).otherwise(_one(text))) for t in tries]
    return F.coalesce(*[let(t, lambda x: F.when(F.size(x) > 1, x)) for t in tries], pack_words(text, max_chars))


def enforce_length(
    df: DataFrame,
    text: str = "text",
    max_chars: int = MAX_CHARS,
    profile: str = "a",
    compat: bool = False,
    before: Column | None = None,
    bounds: Column | None = None,
) -> DataFrame:
    """Split every text longer than ``max_chars`` by the rules of a profile; adds ``part_idx`` and ``part``.

    ``a``: sentence ends, commas, balanced cut, words; applied twice. ``b``: recognizer boundaries,
    grammar, words. ``c``: greedy cuts after grammar points, words. ``d``: conjunctions, punctuation, semantic, words.
    ``plain``: sentence ends, commas, words; applied twice. ``before`` may give a first try as
    ``array<string>`` (cuts at pauses). ``bounds`` gives recognizer boundaries inside the text as token offsets;
    profile ``a`` cuts there after commas and before the balanced cut, in parts of the text as well, profile ``b`` before
    anything but ``before``. Parts that are still too long are finally packed by words, unless ``compat``.
    """
    source = strip(F.col(text))
    fits = F.length("_t") <= max_chars
    rows = df.withColumn("_t", source).filter("_t <> ''")
    if bounds is not None:
        rows = rows.withColumn("_b", F.coalesce(bounds, F.expr(_NO_CUTS)))
    first = _cascade(F.col("_t"), profile, max_chars, None if bounds is None else F.col("_b"))
    if before is not None:
        first = F.coalesce(F.when((F.size(before) > 1) & F.forall(before, lambda x: F.length(x) <= max_chars), before), first)
    rows = rows.withColumn("_p1", F.when(fits, _one(F.col("_t"))).otherwise(first))
    if bounds is None:
        rows = explode_parts(rows, "_p1", "_i1", "_q1").drop("_p1", "_t")
    else:
        # a part's tokens follow those of the parts before it, as long as the parts have the text's tokens
        count = lambda x: F.size(F.split(x, " "))
        whole = F.aggregate("_p1", F.lit(0), lambda n, p: n + count(p)) == count(F.col("_t"))
        rows = rows.withColumn("_n1", F.transform("_p1", count)).withColumn("_b", F.when(whole, F.col("_b")).otherwise(F.expr(_NO_CUTS)))
        rows = explode_parts(rows, "_p1", "_i1", "_q1")
        skip = F.aggregate(F.slice("_n1", F.lit(1), F.col("_i1")), F.lit(0), lambda n, k: n + k)
        rows = rows.withColumn("_skip", skip).withColumn("_b", F.filter(
            F.transform("_b", lambda b: b - F.col("_skip")), lambda b: (b > 0) & (b < count(F.col("_q1"))))).drop("_p1", "_t", "_n1", "_skip")
    again = _cascade(F.col("_q1"), profile, max_chars, None if bounds is None else F.col("_b")) if profile in ("a", "plain") else _one(F.col("_q1"))
    rows = rows.withColumn("_p2", F.when(F.length("_q1") <= max_chars, _one(F.col("_q1"))).otherwise(again))
    if not compat:
        rows = rows.withColumn("_p2", F.flatten(F.transform("_p2", lambda p: F.when(
            F.length(p) <= max_chars, _one(p)).otherwise(pack_words(p, max_chars)))))
    rows = explode_parts(rows, "_p2", "_i2", "part").drop("_p2", "_q1")
    # order of a part inside its text; first-level parts of a text number at most its length
    return rows.withColumn("part_idx", F.col("_i1") * F.lit(1 << 32) + F.col("_i2")).drop("_i1", "_i2", "_b")
