"""Queries on alignment and the pipelines built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, quality
from . import pipelines
from .fixtures import sql_with
from .queries_text import W, _sql_norm_align
from .registry import query
from .tables import Tables

CHUNK = ["rec_id", "chunk_id"]

# sentence tokens, words with normal forms, and votes for window starts
_VOTES = f"""wn as (select rec_id, chunk_id, word_idx, start_ms, end_ms, {_sql_norm_align('word')} tok from words),
 lim as (select rec_id, chunk_id, min(word_idx) lo, max(word_idx) hi from wn group by 1, 2),
 st as (select rec_id, chunk_id, sent_idx, list_filter(list_transform(string_split(text, ' '), lambda x: {_sql_norm_align('x')}), lambda x: x <> '') a from sentences_edited),
 sk as (select rec_id, chunk_id, sent_idx, len(a) n, generate_subscripts(a, 1) - 1 k, unnest(a) tok from st),
 votes as (select sk.rec_id, sk.chunk_id, sk.sent_idx, sk.n, wn.word_idx - sk.k s, count(*) c from sk join wn on wn.rec_id = sk.rec_id
  and wn.chunk_id = sk.chunk_id and wn.tok = sk.tok group by all),
 win as (select v.*, v.c / v.n sim from votes v join lim using (rec_id, chunk_id) where s >= lo and s + n - 1 <= hi)"""


@query("align_windows", sql_with("words sentences_edited", f"""with {_VOTES} select rec_id, chunk_id, sent_idx, n, s start_word_idx, s + n - 1 end_word_idx,
 round(sim, 6) similarity from win where c >= 0.85 * n - 1e-9"""))
def align_windows(t: Tables) -> DataFrame:
    return align.exact_and_fuzzy(t.sentences_edited, t.words).withColumn("similarity", F.round("similarity", 6))


for _name, _th in {"align_exact": 1.0, "align_fuzzy_90": 0.9, "align_fuzzy_85": 0.85}.items():
    query(_name, sql_with("words sentences_edited", f"""with {_VOTES} select rec_id, chunk_id, sent_idx, min(s) start_word_idx, min(s) + any_value(n) - 1 end_word_idx,
 round(arg_min(sim, s), 6) similarity from win where c >= {_th} * n - 1e-9 group by 1, 2, 3"""))(
        lambda t, th=_th: align.align_fuzzy(t.sentences_edited, t.words, th).withColumn("similarity", F.round("similarity", 6)))


_MONO = sql_with("words sentences_edited", f"""with {_VOTES},
 sr as (select rec_id, chunk_id, sent_idx, len(a) n, row_number() over (partition by rec_id, chunk_id order by sent_idx) k from st where len(a) > 0),
 r as (select rec_id, chunk_id, 0::bigint k, lo as cur, -1::bigint sent_idx, -1::bigint s, -1::bigint e, 0::double sim from lim
  union all select r.rec_id, r.chunk_id, r.k + 1, case when h.b is null then r.cur else h.b.s + sr.n end, sr.sent_idx,
   coalesce(h.b.s, -1), coalesce(h.b.s + sr.n - 1, -1), coalesce(h.b.sim, 0)
  from r join sr on sr.rec_id = r.rec_id and sr.chunk_id = r.chunk_id and sr.k = r.k + 1,
  lateral (select coalesce(
    (select arg_min({{'s': s, 'sim': sim}}, s) from win w where w.rec_id = r.rec_id and w.chunk_id = r.chunk_id and w.sent_idx = sr.sent_idx and s >= r.cur and c = w.n),
    (select arg_min({{'s': s, 'sim': sim}}, s) from win w where w.rec_id = r.rec_id and w.chunk_id = r.chunk_id and w.sent_idx = sr.sent_idx and s >= r.cur and c >= 0.9 * w.n - 1e-9),
    (select arg_min({{'s': s, 'sim': sim}}, s) from win w where w.rec_id = r.rec_id and w.chunk_id = r.chunk_id and w.sent_idx = sr.sent_idx and s >= r.cur and c >= 0.85 * w.n - 1e-9)) b) h)
 select rec_id, chunk_id, sent_idx, s start_word_idx, e end_word_idx, round(sim, 6) confidence from r where k > 0""", recursive=True)


@query("align_monotonic", _MONO)
def align_monotonic(t: Tables) -> DataFrame:
    out = align.align_monotonic(t.sentences_edited, t.words, context=False)
    return out.select(*CHUNK, "sent_idx", "start_word_idx", "end_word_idx", F.round("confidence", 6).alias("confidence"))


@query("align_monotonic_context")
def align_monotonic_context(t: Tables) -> DataFrame:
    return pipelines._fallback(align.align_monotonic(t.sentences_edited, t.words), t.words, "a")


def _plain(x: str) -> str:
    return rf"trim(lower(regexp_replace({x}, '[^{W}\s'']', '', 'g')))"


@query("align_flexible", sql_with("words sentences_edited", f"""with wp as (select rec_id, chunk_id, word_idx, {_plain('word')} tok from words),
 sp as (select rec_id, chunk_id, sent_idx, list_filter(list_transform(string_split(text, ' '), lambda x: {_plain('x')}), lambda x: x <> '') a from sentences_edited),
 fl as (select sp.*, f.word_idx f, l.word_idx l from sp join wp f on f.rec_id = sp.rec_id and f.chunk_id = sp.chunk_id and f.tok = a[1]
  join wp l on l.rec_id = sp.rec_id and l.chunk_id = sp.chunk_id and l.tok = a[-1] and l.word_idx > f.word_idx),
 wide as (select rec_id, chunk_id, sent_idx, any_value(a) a, min(f) f, max(l) l from fl group by 1, 2, 3),
 body as (select wide.rec_id, wide.chunk_id, sent_idx, wide.a, wide.f, list(distinct tok) toks from wide join wp on wp.rec_id = wide.rec_id and wp.chunk_id = wide.chunk_id
  and wp.word_idx between wide.f and wide.l group by all),
 best as (select rec_id, chunk_id, sent_idx, a, f, list_filter(a, lambda x: list_contains(toks, x)) found from body),
 far as (select b.rec_id, b.chunk_id, b.sent_idx, max(p) reach from (select best.rec_id, best.chunk_id, sent_idx, wp.tok, min(word_idx) p from best join wp
  on wp.rec_id = best.rec_id and wp.chunk_id = best.chunk_id and word_idx >= f and list_contains(found, tok) group by all) b group by all)
 select best.rec_id, best.chunk_id, best.sent_idx, best.f start_word_idx, min(fl.l) end_word_idx, round(len(any_value(found)) / len(any_value(best.a)), 6) confidence
 from best join far using (rec_id, chunk_id, sent_idx) join fl on fl.rec_id = best.rec_id and fl.chunk_id = best.chunk_id and fl.sent_idx = best.sent_idx
  and fl.f = best.f and fl.l >= far.reach where len(found) / len(best.a) >= 0.6 group by best.rec_id, best.chunk_id, best.sent_idx, best.f"""))
def align_flexible(t: Tables) -> DataFrame:
    return align.flexible_spans(t.sentences_edited, t.words).withColumn("confidence", F.round("confidence", 6))


@query("align_by_chars", sql_with("words segments", rf"""with c as (select rec_id, chunk_id, word_idx, trim(regexp_replace(word, '[^{W}\s''\-]', '', 'g')) w from words),
 k as (select * from c where w <> ''),
 o as (select *, sum(length(w) + 1) over (partition by rec_id, chunk_id order by word_idx) - length(w) - 1 b from k),
 ref as (select rec_id, chunk_id, string_agg(w, ' ' order by word_idx) r from k group by 1, 2),
 s as (select rec_id, chunk_id, seg_idx sent_idx, trim(regexp_replace(regexp_replace(text, '[^{W}\s''\-]', '', 'g'), '\s+', ' ', 'g')) x from segments),
 hit as (select s.*, strpos(r, x) - 1 p from s join ref using (rec_id, chunk_id) where x <> '' and strpos(r, x) > 0)
 select hit.rec_id, hit.chunk_id, hit.sent_idx, max(word_idx) filter (where b <= p) start_word_idx, max(word_idx) filter (where b <= p + length(x) - 1) end_word_idx
 from hit join o on o.rec_id = hit.rec_id and o.chunk_id = hit.chunk_id group by all"""))
def align_by_chars(t: Tables) -> DataFrame:
    return align.char_spans(t.segments.withColumnRenamed("seg_idx", "sent_idx"), t.words)


for _name in ("align_unused_robust", "align_unused_simple", "align_best_sequence", "locate_range", "align_token_set",
              "align_fuzzy_unused", "align_contraction"):
    query(_name)(lambda t, fn=getattr(align, _name): fn(t.sentences_edited, t.words).drop("text"))


@query("alignment_report", _MONO.replace(
    "select rec_id, chunk_id, sent_idx, s start_word_idx, e end_word_idx, round(sim, 6) confidence from r where k > 0",
    """select rec_id, count(*) total, count(*) filter (where s >= 0) matched, count(*) filter (where sim >= 0.95) ge_095,
 count(*) filter (where sim >= 0.9 and sim < 0.95) ge_090, count(*) filter (where sim >= 0.85 and sim < 0.9) ge_085,
 count(*) filter (where sim > 0 and sim < 0.85) lt_085, count(*) filter (where sim = 0) zero, count(*) filter (where s >= 0) / count(*) rate
 from r where k > 0 group by 1"""))
def alignment_report(t: Tables) -> DataFrame:
    return quality.match_report(align.align_monotonic(t.sentences_edited, t.words, context=False), ["rec_id"])


# ------------------------------------------------------------------ pipelines

query("captions_rule")(lambda t: pipelines.captions(t.words, t.segments, "rule"))
query("captions_segments")(lambda t: pipelines.captions(t.words, t.segments, "segments"))
query("pause_captions")(lambda t: pipelines.pause_captions(t.words))
query("simple_captions")(lambda t: pipelines.simple_captions(t.words))
query("char_captions")(lambda t: pipelines.char_captions(t.words))
query("captions_fallback_full")(lambda t: pipelines.captions_fallback(t.segments, None, depth=1))
query("captions_fallback_words")(lambda t: pipelines.captions_fallback(t.segments, t.words, depth=1))


@query("reprocess")
def reprocess(t: Tables) -> DataFrame:
    return pipelines.reprocess(t.cues, t.words, t.glossary, t.chunk_timing, "1-2")


# a batch with a time before zero can't be written as captions: it fails and keeps its source
_ECHO = """with k as (select *, row_number() over (partition by rec_id order by chunk_id, cue_idx) k from cues where start_ms < end_ms and trim(content) <> ''),
 b as (select *, min(start_ms) over (partition by rec_id, (k - 1) // 5) as lowest from k)
 select rec_id, k cue_idx, start_ms, end_ms, case when lowest < 0 or contains(content, chr(10)) then content else content || chr(10) || content end as content from b"""


@query("translate_batches", sql_with("cues", _ECHO))
def translate_batches(t: Tables) -> DataFrame:
    """With a stand-in client that repeats the captions of its prompt."""

    def client(prompt: str):
        body = prompt.removeprefix(pipelines.REQUEST[0]).removesuffix(pipelines.REQUEST[1])
        return "```srt\n" + body + "```"

    from ..operators.merge import drop_invalid
    return pipelines.translate_batches(drop_invalid(t.cues), client).select("rec_id", "cue_idx", "start_ms", "end_ms", "content")


@query("run_recordings")
def run_recordings(t: Tables) -> DataFrame:
    """All cues of a run, placeholders included, each with the state of its chunk; chunks without a row in the table of
    starts have no state."""
    cues, runs = pipelines.run_recordings(t.words, t.segments, t.chunk_timing)
    return cues.join(runs, CHUNK, "left").select(*CHUNK, "cue_idx", "start_ms", "end_ms", "content", "status", "n_cues", "duration_ms")


_RUNS = """select rec_id, chunk_id, case when n > 0 then 'ok' else 'error' end status, coalesce(n, 0) n_chunks, duration_ms from chunk_timing
 left join (select rec_id, chunk_id, count(distinct chunk_id) n from segments where trim(text) <> '' group by 1, 2) using (rec_id, chunk_id)"""


@query("run_status", sql_with("segments chunk_timing", _RUNS))
def run_status(t: Tables) -> DataFrame:
    """The state of every chunk of a run; of its cues, whether there are any."""
    runs = pipelines.run_recordings(t.words, t.segments, t.chunk_timing)[1]
    return runs.select(*CHUNK, "status", F.least("n_cues", F.lit(1).cast("bigint")).alias("n_chunks"), "duration_ms")
