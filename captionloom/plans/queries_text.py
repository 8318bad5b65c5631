"""Queries on text: cleaning, punctuation, sentence splitting, packing, glossary and cache lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.models import model_column
from ..operators import lookup, segment, split
from ..operators.quality import length_profile
from ..session import materialize, spread
from ..sources.read import parse_glossary
from . import pipelines
from .fixtures import GLOSSARY_RULES, sql_with
from .registry import query
from .tables import Tables

W = r"\p{L}\p{N}_"
# the same patterns for the SQL check (a quote is doubled in SQL)
_NOT_WORD = rf"[^{W}\s'']"
_NOT_HYPHEN_WORD = rf"[^{W}\s''\-]"
_EDGE = "^''|''$"


def _docs(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text", "lang"))


def _apostrophes(column: str):
    return F.replace(F.col(column), F.lit("th"), F.lit("'"))


def _doc_tokens(t: Tables) -> DataFrame:
    # some letter pairs become apostrophes and dashes, so that the rules have something to do
    w = F.explode(tx.tokens(F.col("text")))
    return _docs(t).select(w.alias("w")).select(F.replace(_apostrophes("w"), F.lit("an"), F.lit("—")).alias("w"))


_DTOK = r"""dtok as (select replace(replace(w, 'th', ''''), 'an', '—') w from
 (select unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) w from documents) where w <> '')"""


def _vocab(t: Tables, norm) -> DataFrame:
    return _doc_tokens(t).select(norm(F.col("w")).alias("norm")).groupBy("norm").agg(F.count(F.lit(1)).alias("n"))


def _re(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"


def _strip(expr: str) -> str:
    return f"trim({expr}, ' ' || chr(9) || chr(10) || chr(13))"


def _inner(expr: str, by: str) -> str:
    once = rf"([{W}])''([{W}])"
    return _re(_re(expr, once, rf"\1{by}\2"), once, rf"\1{by}\2")


def _sql_norm_align(w: str) -> str:
    t = _inner(_re(f"translate({w}, '—–', '--')", _NOT_WORD, " "), " ")
    return f"lower(trim({_re(_re(t, _EDGE, ' '), '[ ]+', ' ')}))"


def _sql_norm_clean(w: str) -> str:
    return f"trim(lower({_re(_inner(_re(w, _NOT_WORD, ''), ''), _EDGE, '')}))"


def _vocab_sql(norm: str) -> str:
    return f"with {_DTOK} select {norm} norm, count(*) n from dtok group by 1"


query("norm_align", _vocab_sql(_sql_norm_align("w")))(lambda t: _vocab(t, tx.norm_align))
query("norm_clean", _vocab_sql(_sql_norm_clean("w")))(lambda t: _vocab(t, tx.norm_clean))
query("clean_words", _vocab_sql(f"trim({_re('w', _NOT_HYPHEN_WORD, '')})"))(lambda t: _vocab(t, tx.clean_word))
query("lower_hyphen_word", _vocab_sql(f"trim(lower({_re('w', _NOT_HYPHEN_WORD, '')}))"))(lambda t: _vocab(t, tx.lower_hyphen_word))
query("lower_plain_word", _vocab_sql(f"trim(lower({_re('w', _NOT_WORD, '')}))"))(lambda t: _vocab(t, tx.lower_plain_word))

_TOKS = r"list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


@query("norm_text", f"""select doc_id, array_to_string(list_filter(list_transform({_TOKS.replace('text', "replace(text, 'th', '''')")},
 lambda x: {_sql_norm_align('x')}), lambda x: x <> ''), ' ') norm from documents""")
def norm_text(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.norm_text(_apostrophes("text")).alias("norm"))


@query("norm_tokens", f"""select doc_id, len(x) n, array_to_string(x, ' ') toks from (select doc_id,
 list_filter(list_transform({_TOKS}, lambda x: {_sql_norm_clean('x')}), lambda x: x <> '') x from documents)""")
def norm_tokens(t: Tables) -> DataFrame:
    toks = _docs(t).select("doc_id", tx.norm_tokens(F.col("text")).alias("x"))
    return toks.select("doc_id", F.size("x").alias("n"), F.array_join("x", " ").alias("toks"))


@query("clean_case", "select doc_id, trim(regexp_replace(" + _re("translate(text, '—–', '--')", _NOT_HYPHEN_WORD, "") + r", '\s+', ' ', 'g')) as clean from documents")
def clean_case(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.clean_case(F.col("text")).alias("clean"))


# sentences of the documents, used by the splitters
def _sentences(t: Tables) -> DataFrame:
    return tx.explode_parts(_docs(t), segment.sentences_by_rule(F.col("text")), "sent_idx", "text", ["doc_id"])


_SENT_LIST = (r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), "
              f"lambda x: {_strip('x')}), lambda x: x <> '')")
_SENTS = f"""sents as (select doc_id, generate_subscripts(a, 1) - 1 sent_idx, unnest(a) as text
 from (select doc_id, {_SENT_LIST} a from documents))"""


@query("sentences_by_rule", f"with {_SENTS} select * from sents")
def sentences_by_rule(t: Tables) -> DataFrame:
    return _sentences(t)


@query("sentences_by_rule_caps", f"""select doc_id, sent_idx, case when right(x, 1) in ('.', '!', '?') then x else x || '.' end as text
 from (select doc_id, generate_subscripts(a, 1) - 1 sent_idx, unnest(a) x from (select doc_id,
 list_filter(list_transform(string_split(regexp_replace(text, '[.!?]+\\s+([A-Z])', chr(1) || '\\1', 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') a
 from documents))""")
def sentences_by_rule_caps(t: Tables) -> DataFrame:
    return tx.explode_parts(_docs(t), segment.sentences_by_rule_caps(F.col("text")), "sent_idx", "text", ["doc_id"])


@query("sentences_by_segment", sql_with("segments", "select rec_id, chunk_id, seg_idx sent_idx, text as sentence from segments where trim(text) <> ''"))
def sentences_by_segment(t: Tables) -> DataFrame:
    return pipelines.sentences(t.words, t.segments, "segments").withColumnRenamed("text", "sentence")


@query("sentences_by_model")
def sentences_by_model(t: Tables) -> DataFrame:
    """The model slot, filled with a stand-in that cuts at full stops."""

    def load():
        return lambda texts: [[p.strip() + "." for p in x.split(".") if p.strip()] for x in texts]

    cut = model_column(load, "array<string>")
    return tx.explode_parts(_docs(t), cut(F.col("text")), "sent_idx", "text", ["doc_id"])


@query("finalize", f"with {_SENTS} select doc_id, sent_idx, regexp_replace(text, '[,.，。]$', '') as final from sents")
def finalize(t: Tables) -> DataFrame:
    return _sentences(t).select("doc_id", "sent_idx", tx.finalize(F.col("text")).alias("final"))


# German sharp s differs under upper-casing between engines, so it never stands first here
@query("punctuate_rule", f"""with {_SENTS} select doc_id, sent_idx,
 case when right(u, 1) in ('.', '!', '?') then u else u || '.' end as punctuated
 from (select doc_id, sent_idx, upper(left(x, 1)) || substr(x, 2) u from (select doc_id, sent_idx, 'a' || replace(text, '.', ';') x from sents))""")
def punctuate_rule(t: Tables) -> DataFrame:
    return _sentences(t).select("doc_id", "sent_idx", tx.punctuate_rule(F.expr("'a' || replace(text, '.', ';')")).alias("punctuated"))


@query("punctuate_labels", f"""with {_SENTS}, tk as (select doc_id, sent_idx, list_filter(string_split(regexp_replace('a' || text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') a from sents),
 jn as (select doc_id, sent_idx, array_to_string(list_transform(a, lambda x, i: x || (case ((i - 1) * 7 + length(x)) % 15
 when 1 then ' .' when 2 then ' ,' when 3 then ' ?' when 4 then ' !' when 5 then ' ;' when 6 then ' :' when 7 then ' ''' when 8 then ' "'
 when 9 then ' -' when 10 then ' ...' else '' end)), ' ') s from tk),
 sp as (select doc_id, sent_idx, trim(regexp_replace(s, '\\s+([,.!?;:])', '\\1', 'g')) s from jn)
 select doc_id, sent_idx, upper(left(s, 1)) || substr(s, 2) as punctuated from sp""")
def punctuate_labels(t: Tables) -> DataFrame:
    toks = _sentences(t).withColumn("tk", tx.tokens(F.expr("'a' || text")))
    labels = F.transform("tk", lambda x, i: (i * 7 + F.length(x)) % 15)
    return toks.select("doc_id", "sent_idx", tx.punctuate_labels(F.col("tk"), labels).alias("punctuated"))


@query("punct_plausible", f"""with {_SENTS}, c as (select doc_id, sent_idx, text, len(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) n,
 length(text) - length(translate(text, ',.?!', '')) m, length(text) - length(replace(text, ',', '')) k from sents)
 select doc_id, sent_idx, n > 0 and m <= greatest(n // 3, 1) and k <= greatest(n // 4, 1) ok from c""")
def punct_plausible(t: Tables) -> DataFrame:
    n = F.size(tx.tokens(F.col("text")))
    return _sentences(t).select("doc_id", "sent_idx", tx.punct_plausible(F.col("text"), n).alias("ok"))


def _marked(expr: str) -> str:
    """Put chr(1) on both sides of every word, which gives RE2 Unicode word borders."""
    return rf"regexp_replace({expr}, '([{W}]+)', chr(1) || '\1' || chr(1), 'g')"


_PROTECTED_SQL = "|".join([
    *[rf"\x01{p} the\x01 \x01".replace(" the", r"\x01 \x01the", 1) for p in ("in", "on", "at", "to", "from")],
    r"\x01 \x01or\x01 \x01", r"\x01if\x01 \x01I\x01 \x01", r"\x01I\x01 \x01would\x01 \x01", r"\x01I\x01 \x01could\x01 \x01",
    r"\x01he\x01 \x01would\x01 \x01", r"\x01that\x01 \x01would\x01 \x01", r"\x01it\x01 \x01would\x01 \x01",
    r"\x01one\x01 \x01and\x01 \x01a\x01 \x01half\x01", r"\x01two\x01 \x01and\x01 \x01a\x01 \x01half\x01", r"\x01MLG\x01 \x01water\x01",
])


@query("has_protected", f"with {_SENTS} select doc_id, sent_idx, regexp_matches({_marked('text')}, '(?i){_PROTECTED_SQL}') protected from sents")
def has_protected(t: Tables) -> DataFrame:
    return _sentences(t).select("doc_id", "sent_idx", tx.has_protected(F.col("text")).alias("protected"))


@query("translatable", f"with {_SENTS} select doc_id, sent_idx, text from sents where not regexp_full_match(text, '[^{W}]*')")
def translatable(t: Tables) -> DataFrame:
    return _sentences(t).filter(tx.translatable(F.col("text")))


# model responses made from the documents: fenced, fenced with a language line, plain
_RESP = """case when doc_id % 3 = 0 then 'Here:' || chr(10) || '```srt' || chr(10) || text || chr(10) || '```' || chr(10) || 'bye'
 when doc_id % 3 = 1 then '```' || chr(10) || '1' || chr(10) || text || '```' else text end"""


@query("extract_code_block", f"""with r as (select doc_id, {_RESP} x from documents),
 b as (select doc_id, x, {_strip("string_split(x, '```')[2]")} b from r)
 select doc_id, case when not contains(x, '```') then {_strip('x')} when regexp_full_match({_strip("string_split(b, chr(10))[1]")}, '[0-9]+') then b
 else array_to_string(string_split(b, chr(10))[2:], chr(10)) end as body from b""")
def extract_code_block(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.extract_code_block(F.expr(_RESP)).alias("body"))


_SRT_RESP = "text || chr(10) || case when doc_id % 4 = 0 then '' else '1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || ' ' || text || ' ' || chr(10) end"


@query("clean_srt_text", f"""with l as (select doc_id, list_transform(string_split({_SRT_RESP}, chr(10)), lambda x: {_strip('x')}) a from documents),
 p as (select doc_id, a, list_position(list_transform(a, lambda x: regexp_full_match(x, '[0-9]+') or (contains(x, '-->') and contains(x, ':'))), true) k from l)
 select doc_id, case when k > 0 then array_to_string(a[k:], chr(10)) else '' end as clean from p""")
def clean_srt_text(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.clean_srt_text(F.expr(_SRT_RESP)).alias("clean"))


# ------------------------------------------------------------------ splitters

def _sql_pack(x: str, n: int = 80) -> str:
    words = rf"list_transform(list_filter(string_split(trim(regexp_replace({x}, '\s+', ' ', 'g')), ' '), lambda y: y <> ''), lambda y: [y])"
    return (f"list_reduce({words}, lambda a, b: case when length(a[-1]) + 1 + length(b[1]) <= {n} "
            "then a[1:len(a)-1] || [a[-1] || ' ' || b[1]] else a || b end)")


def _sql_terminal(x: str) -> str:
    return _SENT_LIST.replace("text", x)


def _sql_commas(x: str) -> str:
    frags = (rf"list_filter(list_transform(string_split(regexp_replace({x}, ',\s*', ',' || chr(1), 'g'), chr(1)), "
             rf"lambda y: case when right(y, 1) = ',' then {_strip('left(y, length(y) - 1)')} || ',' else {_strip('y')} end), lambda y: y <> '')")
    merged = (f"list_reduce(list_transform({frags}, lambda y: [y]), lambda a, b: case when length(a[-1]) < 15 "
              "then a[1:len(a)-1] || [a[-1] || ' ' || b[1]] else a || b end)")
    return f"case when contains({x}, ',') and len({merged}) > 1 then {merged} else [{x}] end"


def _sql_punct(x: str, n: int) -> str:
    pieces = f"list_transform(regexp_extract_all({x}, '[^.!?;:]*[.!?;:]|[^.!?;:]+$'), lambda y: [y])"
    packed = (f"list_reduce({pieces}, lambda a, b: case when length(a[-1]) + length(b[1]) <= {n} "
              "then a[1:len(a)-1] || [a[-1] || b[1]] else a || b end)")
    return f"case when regexp_matches({x}, '[.!?;:]') then list_filter(list_transform({packed}, lambda y: {_strip('y')}), lambda y: y <> '') else [{x}] end"


def _parts(df: DataFrame, parts, *keys: str) -> DataFrame:
    return tx.explode_parts(df, parts, keep=keys)


def _parts_sql(source: str, keys: str, parts: str) -> str:
    return f"select {keys}, generate_subscripts(p, 1) - 1 part_idx, unnest(p) part from (select {keys}, {parts} p from {source})"


@query("pack_words", _parts_sql(f"(select * from documents where text <> '')", "doc_id", _sql_pack("text")))
def pack_words(t: Tables) -> DataFrame:
    return _parts(_docs(t), segment.pack_words(F.col("text")), "doc_id")


@query("split_terminal", _parts_sql("(select * from documents where trim(text) <> '')", "doc_id", _sql_terminal("text")))
def split_terminal(t: Tables) -> DataFrame:
    return _parts(_docs(t), split.split_terminal(F.col("text")), "doc_id")


@query("split_commas", f"with {_SENTS} " + _parts_sql("sents", "doc_id, sent_idx", _sql_commas("text")))
def split_commas(t: Tables) -> DataFrame:
    return _parts(_sentences(t), split.split_commas(F.col("text")), "doc_id", "sent_idx")


@query("pack_punct", _parts_sql("(select doc_id, replace(replace(text, ',', ';'), chr(10), ' ') t from documents)", "doc_id", _sql_punct("t", 80)))
def pack_punct(t: Tables) -> DataFrame:
    return _parts(_docs(t).withColumn("t", F.expr("replace(replace(text, ',', ';'), chr(10), ' ')")), split.pack_punct(F.col("t")), "doc_id")


_MID = f"""with {_SENTS}, s as (select doc_id, sent_idx, trim(regexp_replace(text, '\\s+', ' ', 'g')) x from sents),
 c as (select doc_id, sent_idx, x, length(x) n, unnest(list_filter(range(1, length(x) + 1), lambda i: x[i] in (',', ';', ':'))) e from s),
 ok as (select *, trim(left(x, e)) l, trim(substr(x, e + 1)) r from c),
 b as (select doc_id, sent_idx, arg_min([l, r], abs(e - n // 2) * 1000000 + e) p from ok
  where length(l) between 20 and 80 and length(r) between 20 and 80 group by 1, 2)
 select doc_id, sent_idx, generate_subscripts(p, 1) - 1 part_idx, unnest(p) part
 from (select s.doc_id, s.sent_idx, coalesce(b.p, [s.x]) p from s left join b using (doc_id, sent_idx))"""


@query("split_midpoint", _MID)
def split_midpoint(t: Tables) -> DataFrame:
    return _parts(_sentences(t), split.split_midpoint(F.col("text"), split.GRAMMAR[1]), "doc_id", "sent_idx")


def _round(source: str, x: str, keys: str, out: str) -> str:
    tries = (f"case when length({x}) <= 80 then [{x}] when len({_sql_terminal(x)}) > 1 then {_sql_terminal(x)} "
             f"when len({_sql_commas(x)}) > 1 then {_sql_commas(x)} else {_sql_pack(x)} end")
    return f"{out} as (select {keys}, generate_subscripts(p, 1) i, unnest(p) q from (select {keys}, {tries} p from {source}))"


_PLAIN = (f"with {_SENTS}, " + _round("sents", "text", "doc_id, sent_idx", "r1") + ", "
          + _round("(select doc_id, sent_idx, i j, q from r1)", "q", "doc_id, sent_idx, j", "r2") + ", "
          + "r3 as (select doc_id, sent_idx, j, i k, generate_subscripts(p, 1) m, unnest(p) part from "
          + f"(select doc_id, sent_idx, j, i, case when length(q) <= 80 then [q] else {_sql_pack('q')} end p from r2)) "
          + "select doc_id, sent_idx, row_number() over (partition by doc_id, sent_idx order by j, k, m) - 1 part_idx, part from r3")


def _numbered(parts: DataFrame) -> DataFrame:
    from pyspark.sql import Window
    w = Window.partitionBy("doc_id", "sent_idx").orderBy("part_idx")
    return parts.withColumn("part_idx", (F.row_number().over(w) - 1).cast("bigint")).select("doc_id", "sent_idx", "part_idx", "part")


@query("enforce_length", _PLAIN)
def enforce_length(t: Tables) -> DataFrame:
    return _numbered(split.enforce_length(_sentences(t), profile="plain"))


for _p in "abcd":
    query(f"enforce_length_{_p}")(lambda t, p=_p: _numbered(split.enforce_length(_sentences(t), profile=p)))

query("split_balanced")(lambda t: _parts(_sentences(t), split.split_balanced(F.col("text")), "doc_id", "sent_idx"))
query("split_grammar")(lambda t: _parts(_sentences(t), split.split_grammar(F.col("text")), "doc_id", "sent_idx"))
query("split_safe")(lambda t: _parts(_sentences(t), split.split_safe(F.col("text")), "doc_id", "sent_idx"))
query("split_greedy_before")(lambda t: _parts(_sentences(t), split.split_greedy_before(F.col("text")), "doc_id", "sent_idx"))
query("split_greedy_after")(lambda t: _parts(_sentences(t), split.split_greedy_after(F.col("text")), "doc_id", "sent_idx"))
query("split_semantic")(lambda t: _parts(_sentences(t), split.split_semantic(F.col("text")), "doc_id", "sent_idx"))


@query("length_profile", _PLAIN.replace("select doc_id, sent_idx, row_number()", """, parts as (select doc_id, count(*) n_out, max(length(part)) longest,
 bool_and(length(part) <= 80) all_fit from r3 group by 1), ins as (select doc_id, count(*) n_in, cast(sum(case when length(text) > 80 then 1 else 0 end) as bigint) n_split
 from sents group by 1) select * from ins join parts using (doc_id) --""", 1).replace(" , parts", ", parts"))
def length_profile_query(t: Tables) -> DataFrame:
    sents = materialize(_sentences(t), "sentences")
    return length_profile(split.enforce_length(sents, profile="plain"), sents, 80, ["doc_id"])


# ------------------------------------------------------------------ lookups on text

def _sql_rule(x: str, term: str, to: str) -> str:
    pattern = r"\x01" + term.replace(" ", r"\x01 \x01") + r"\x01"
    return f"replace(regexp_replace({_marked(x)}, '(?i){pattern}', '{to}', 'g'), chr(1), '')"


def _sql_glossary(x: str) -> str:
    for kind, _, term, to in GLOSSARY_RULES:
        if kind == "exact_replace":
            x = _sql_rule(x, term, to)
    return x


@query("apply_glossary", f"select doc_id, {_sql_glossary('text')} as text from documents")
def apply_glossary(t: Tables) -> DataFrame:
    return lookup.apply_glossary(_docs(t).select("doc_id", "text"), t.glossary.filter("kind = 'exact_replace'"))


@query("pretranslate", f"""with {_SENTS}, d as (select item_id, text as term, upper(left(text, 1)) || ':' || item_id replacement from benchmark)
 select doc_id, sent_idx, coalesce(any_value(d.replacement), s.text) as translated from
 (select doc_id, sent_idx, case when doc_id % 5 = 0 then (select any_value(text) from benchmark where item_id = doc_id % (select count(*) from benchmark)) else text end as text from sents) s
 left join d on s.text = d.term group by doc_id, sent_idx, s.text""")
def pretranslate(t: Tables) -> DataFrame:
    bench = t.benchmark
    n = bench.count()
    some = bench.select((F.col("item_id") * 1).alias("_i"), F.col("text").alias("_b"))
    sents = _sentences(t).withColumn("_i", F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % n))
    sents = sents.join(lookup.beside(some, 100_000), "_i", "left").select(
        "doc_id", "sent_idx", F.when(F.col("doc_id") % 5 == 0, F.col("_b")).otherwise(F.col("text")).alias("text"))
    terms = bench.select(F.col("text").alias("term"), F.expr("upper(left(text, 1)) || ':' || item_id").alias("replacement"))
    return lookup.pretranslate(sents, terms).select("doc_id", "sent_idx", "translated")


@query("read_glossary", """select source, 'exact_replace' kind, lower(k) term, v replacement from
 (select source, lang || '-' || doc_id k, text v from documents)
 union all select source, 'pre_translate', k, v from (select source, 'T' || doc_id k, lang v from documents)""")
def read_glossary(t: Tables) -> DataFrame:
    """Glossary JSON texts, one per document source, built from the documents and parsed again."""
    rows = t.documents.select("source", "doc_id", "lang", F.col("text").alias("v"))
    # a source may hold any share of the documents, so its texts are cut into pages of ids
    texts = rows.groupBy("source", F.expr("doc_id div 1000").alias("page")).agg(F.to_json(F.struct(
        F.map_from_entries(F.collect_list(F.struct(F.concat("lang", F.lit("-"), "doc_id"), "v"))).alias("exact_replace"),
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("T"), "doc_id"), "lang"))).alias("pre_translate"))).alias("value"))
    return parse_glossary(texts).select("source", "kind", "term", "replacement")


_CACHE_KEY = "sha256(text) || '_large_' || left(md5(lang || '_80_true'), 8)"


@query("cached_lookup", f"""with todo as (select doc_id, {_CACHE_KEY} as key from documents),
 cache as (select key, min(doc_id) as value, max(timestamp '2024-01-31 00:00:00' - to_days(cast(doc_id % 14 as int))) modified from
 (select doc_id, {_CACHE_KEY} as key from documents) where doc_id % 3 > 0 group by key),
 fresh as (select * from cache where floor((epoch(timestamp '2024-01-31 00:00:00') - epoch(modified)) / 86400) < 7)
 select todo.doc_id, fresh.value is not null hit, fresh.value as value from todo left join fresh using (key)""")
def cached_lookup(t: Tables) -> DataFrame:
    key = lookup.cache_key(F.col("text"), F.lit("large"), [F.col("lang"), F.lit("80"), F.lit("true")])
    todo = _docs(t).select("doc_id", key.alias("key"))
    age = F.expr("timestamp_ntz '2024-01-31 00:00:00' - make_dt_interval(cast(doc_id % 14 as int))").cast("timestamp")
    cache = todo.filter("doc_id % 3 > 0").groupBy("key").agg(F.min("doc_id").alias("value"), F.max(age).alias("modified"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    hits, misses = lookup.cached_lookup(todo, cache, now)
    return hits.select("doc_id", F.lit(True).alias("hit"), "value").unionByName(
        misses.select("doc_id", F.lit(False).alias("hit"), F.lit(None).cast("bigint").alias("value")))
