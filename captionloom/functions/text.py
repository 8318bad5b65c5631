"""Column functions on text: Unicode-aware cleaning, punctuation rules, response clean-up.

Java's ``\\w``, ``\\s`` and ``\\b`` are ASCII by default, so every class is spelled out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\p{Z}"
# a Unicode noncharacter, used to mark places inside a text while it is taken apart
MARK, MARK_END = "\ufdd0", "\ufdd1"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def unicode_regex(pattern: str) -> str:
    """Rewrite ``\\b``, ``\\w`` and ``\\s`` (outside brackets) to their Unicode meaning, ignoring case.

    A border at the very start or end of a pattern must stand beside a word character of the pattern.
    """
    if pattern.startswith(r"\b"):
        pattern = f"(?<![{WORD}])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?![{WORD}])"
    pattern = pattern.replace(r"\b", BOUNDARY).replace(r"\w", f"[{WORD}]").replace(r"\s", f"[{SPACE}]")
    return "(?iu)" + pattern


def sub(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def split_on(c: Column, pattern: str, keep: str = "") -> Column:
    """Split at matches of ``pattern``, leaving ``keep`` (such as ``$1``) at the end of the left piece.

    ``split`` compiles a regular expression anew for every row; marking the places with
    ``regexp_replace`` and splitting on one character does not.
    """
    return F.split(sub(c, pattern, keep + MARK), MARK, -1)


def strip(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return sub(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(c: Column) -> Column:
    return strip(sub(c, rf"[{SPACE}]+", " "))


def tokens(c: Column) -> Column:
    """White-space tokens as an array; blank text gives an empty array."""
    return F.filter(F.split(sub(c, rf"[{SPACE}]+", " "), " ", -1), lambda t: t != "")


def explode_parts(df: DataFrame, parts: Column | str, idx: str = "part_idx", name: str = "part", keep: Sequence[Column | str] = ("*",)) -> DataFrame:
    """One row per part, numbered from 0; rows without parts vanish.

    Spark puts a test for size and null below ``posexplode`` and moves it through the projections, so that costly parts
    would be made three times; the outer form has no such test, and what it adds is dropped afterwards.
    """
    return df.select(*keep, F.posexplode_outer(parts).alias(idx, name)).filter(F.col(idx).isNotNull())


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def _dashes(c: Column) -> Column:
    return F.translate(c, "—–", "--")


def _inner_apostrophe(c: Column, by: str) -> Column:
    # an apostrophe between two word characters; zero-width sides, so a'b'c is done in one pass
    return sub(c, rf"(?<=[{WORD}])'(?=[{WORD}])", by)


def _unless_plain(word: Column, full: Column, plain: Column) -> Column:
    """``full``, or the cheaper ``plain`` that equals it for words of ASCII letters and digits alone, as most are."""
    return F.when(word.rlike(r"^[A-Za-z0-9]+\z"), plain).otherwise(full)


def norm_align(word: Column) -> Column:
    """Normal form used by the monotonic aligner: ``Don't!`` -> ``don t``."""
    t = _inner_apostrophe(sub(_dashes(word), rf"[^{WORD}{SPACE}']", " "), " ")
    return _unless_plain(word, F.lower(collapse(sub(t, r"^'|'$", " "))), F.lower(word))


def norm_text(text: Column) -> Column:
    """``norm_align`` of every token, joined by blanks."""
    return F.array_join(F.filter(F.transform(tokens(_dashes(text)), norm_align), lambda t: t != ""), " ")


def norm_clean(word: Column) -> Column:
    """Normal form used by the non-monotonic aligner: ``Don't!`` -> ``dont``."""
    t = _inner_apostrophe(sub(word, rf"[^{WORD}{SPACE}']", ""), "")
    return _unless_plain(word, strip(F.lower(sub(t, r"^'|'$", ""))), F.lower(word))


def norm_tokens(text: Column) -> Column:
    return F.filter(F.transform(tokens(text), norm_clean), lambda t: t != "")


def align_tokens(text: Column) -> Column:
    """Tokens of a sentence in the monotonic aligner's normal form (empty ones dropped)."""
    return F.filter(F.transform(tokens(text), norm_align), lambda t: t != "")


def clean_case(text: Column) -> Column:
    """Drop punctuation but keep case, hyphens and apostrophes."""
    return collapse(sub(_dashes(text), rf"[^{WORD}{SPACE}'\-]", ""))


def clean_word(word: Column) -> Column:
    return _unless_plain(word, strip(sub(word, rf"[^{WORD}{SPACE}'\-]", "")), word)


def lower_hyphen_word(word: Column) -> Column:
    return _unless_plain(word, strip(F.lower(sub(word, rf"[^{WORD}{SPACE}'\-]", ""))), F.lower(word))


def lower_plain_word(word: Column) -> Column:
    return _unless_plain(word, strip(F.lower(sub(word, rf"[^{WORD}{SPACE}']", ""))), F.lower(word))


def finalize(text: Column) -> Column:
    """Trim and remove one trailing comma or full stop."""
    return sub(strip(text), "[,.，。]$", "")


def _capital(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def punctuate_rule(text: Column) -> Column:
    """Capital first letter, full stop at the end unless ``.``, ``!`` or ``?`` is there."""
    t = _capital(strip(text))
    return F.when(t == "", t).when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


# fixed values: punctuation mark per predicted label; labels 0 and 11-14 add none
LABEL_MARKS = {1: ".", 2: ",", 3: "?", 4: "!", 5: ";", 6: ":", 7: "'", 8: '"', 9: "-", 10: "..."}


def punctuate_labels(toks: Column, labels: Column) -> Column:
    """Append to each token the mark of its label; without labels fall back to the rule."""
    marks = F.create_map(*[F.lit(x) for pair in LABEL_MARKS.items() for x in pair])
    joined = F.array_join(F.zip_with(
        toks, F.slice(labels, 1, F.size(toks)),
        lambda t, k: F.concat_ws(" ", t, F.try_element_at(marks, F.coalesce(k, F.lit(0))))), " ")
    spaced = strip(sub(joined, rf"[{SPACE}]+([,.!?;:])", "$1"))
    rule = punctuate_rule(F.array_join(toks, " "))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) < 1, rule).otherwise(_capital(spaced))


def punct_plausible(text: Column, n_words: Column) -> Column:
    """Few enough marks for the word count: a third in total, a quarter as commas, one always allowed."""
    marks = F.length(text) - F.length(F.translate(text, ",.?!", ""))
    commas = F.length(text) - F.length(F.translate(text, ",", ""))
    total_ok = marks <= F.greatest(F.floor(n_words / 3), F.lit(1))
    comma_ok = commas <= F.greatest(F.floor(n_words / 4), F.lit(1))
    return ~is_blank(text) & (n_words > 0) & total_ok & comma_ok


# fixed values: phrases that must stay together
PROTECTED = (
    r"\bin the \w+", r"\bon the \w+", r"\bat the \w+", r"\bto the \w+", r"\bfrom the \w+",
    r"\w+ or \w+", r"\bif I \w+", r"\bI would \w+", r"\bI could \w+", r"\bhe would \w+",
    r"\bthat would \w+", r"\bit would \w+", r"\bone and a half\b", r"\btwo and a half\b", r"\bMLG water\b",
)


def has_protected(text: Column) -> Column:
    return text.rlike("|".join(unicode_regex(p) for p in PROTECTED))


def translatable(text: Column) -> Column:
    """Holds at least one word character."""
    return text.rlike(f"[{WORD}]")


def extract_code_block(response: Column) -> Column:
    """Content of the first fenced block without its language line; else the whole text, trimmed."""
    block = strip(F.get(F.split(response, "```", -1), F.lit(1)))
    first = F.substring_index(block, "\n", 1)
    rest = F.when(F.locate("\n", block) > 0, F.substr(block, F.length(first) + 2)).otherwise("")
    body = F.when(strip(first).rlike(r"^\p{Nd}+$"), block).otherwise(rest)
    return F.when(response.contains("```"), body).otherwise(strip(response))


def clean_srt_text(text: Column) -> Column:
    """Drop lines before the first index or time line, trim lines, shorten blank runs.

    A blank line inside the block is kept as it stands, so runs of blank lines survive; only
    the text before the first cue goes.
    """
    lines = F.transform(F.split(text, "\n", -1), strip)
    starts = F.transform(lines, lambda x: x.rlike(r"^\p{Nd}+$") | (x.contains("-->") & x.contains(":")))
    first = F.array_position(starts, F.lit(True))
    kept = F.slice(lines, F.when(first > 0, first).otherwise(1).cast("int"), F.size(lines))
    return F.when(first > 0, F.array_join(kept, "\n")).otherwise("")
