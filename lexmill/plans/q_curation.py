"""Filters with reasons, segmentation, ordered operators (survey 2.3, 2.4, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import text as t
from lexmill.operators import curation as c
from lexmill.plans import sql as s
from lexmill.plans.registry import query

_SHIELD = r"regexp_replace(text, '(^|[^\p{L}\p{N}_])([A-ZƏÇĞİÖŞÜ])\.(\s*)([A-ZƏÇĞİÖŞÜ])', '\1\2' || chr(57344) || '\3\4', 'g')"
_FALLBACK = s.segments("clean_document", "document_id", "text")


def _words(x: str) -> str:
    return s.words(x)


_LETTERS = r"regexp_replace(s, '[^\p{L}\p{Nl}\p{No}]', '', 'g')"
_SHARE = rf"length(regexp_replace({_LETTERS}, '[^{c.ALPHABET}]', '', 'g'))::DOUBLE / nullif(length({_LETTERS}), 0)"
_BAD = r"<[^>]+>|https?://|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|[\x00-\x08\x0e-\x1f\x{fffd}]"
_REASON = rf"""CASE WHEN len({_words('s')}) NOT BETWEEN 4 AND 80 OR length(s) > 1000 THEN 'length'
  WHEN NOT regexp_matches(s, '[.!?]$') THEN 'missing_terminal_punctuation'
  WHEN regexp_matches(s, '{_BAD}') OR NOT regexp_matches(s, '^[“«"(]*[A-ZƏÇĞİÖŞÜ]') THEN 'markup_contact_or_fragment'
  WHEN {_SHARE} < 0.98 OR NOT list_has_any({_words('s')}, [{', '.join(f"'{w}'" for w in c.FUNCTION_WORDS)}]) THEN 'language_heuristic' END"""


@query("segment_fallback", f"SELECT document_id, seq, s AS segment FROM {_FALLBACK}")
def segment_fallback(q):
    return c.segment_fallback(q.clean_document)


@query("position_ids", f"SELECT document_id || ':' || seq AS id, length(s) AS n FROM {_FALLBACK} WHERE regexp_matches(s, '[.!?]$')")
def position_ids(q):
    """Ids count rejected segments too."""
    seg = c.segment_fallback(q.clean_document).where(F.rlike("segment", F.lit(r"[.!?]$")))
    return seg.select(F.concat("document_id", F.lit(":"), "seq").alias("id"), F.length("segment").cast("long").alias("n"))


@query("segment_news")
def segment_news(q):
    """The oracle engine has no look-behind to shield initials with; tested against Python's `re`."""
    return c.segment_news(q.clean_document)


@query("paragraphs", rf"""
SELECT document_id, seq, paragraph, length(paragraph) >= 40 AS keyed FROM (
  SELECT document_id, unnest(range(0, len(p)))::INT AS seq, {s.collapse('unnest(p)')} AS paragraph
  FROM (SELECT document_id, string_split(regexp_replace(text, '\n\s*\n', chr(1), 'g'), chr(1)) AS p FROM clean_document WHERE text IS NOT NULL))
WHERE paragraph <> ''""")
def paragraphs(q):
    return c.paragraphs(q.clean_document)


def _reason_query(name: str, condition: str, sql: str) -> None:
    query(name, f"SELECT document_id, seq FROM {_FALLBACK} WHERE {sql}")(
        lambda q: c.segment_fallback(q.clean_document).where(F.expr(condition)).select("document_id", "seq")
    )


@query("filter_len_words", f"SELECT document_id, seq FROM {_FALLBACK} WHERE len({_words('s')}) BETWEEN 4 AND 80 AND length(s) <= 1000")
def filter_len_words(q):
    seg = c.segment_fallback(q.clean_document)
    return seg.where(F.size(t.words(F.col("segment"))).between(4, 80) & (F.length("segment") <= 1000)).select("document_id", "seq")


_reason_query("filter_terminal", "segment RLIKE '[.?!]$'", "regexp_matches(s, '[.?!]$')")
_reason_query("filter_unit_len", "length(segment) BETWEEN 20 AND 2000", "length(s) BETWEEN 20 AND 2000")


@query("filter_markup_contact", f"""SELECT document_id, seq FROM {_FALLBACK} WHERE NOT regexp_matches(s, '{_BAD}') AND regexp_matches(s, '^[“«"(]*[A-ZƏÇĞİÖŞÜ]')""")
def filter_markup_contact(q):
    seg = c.segment_fallback(q.clean_document)
    return seg.where(~F.rlike("segment", F.lit(c.BAD)) & F.rlike("segment", F.lit(rf"^[“«\"(]*[{c.CAPITAL}]"))).select("document_id", "seq")


@query("filter_language", f"SELECT document_id, seq FROM {_FALLBACK} WHERE {_SHARE} >= 0.98 AND list_has_any({_words('s')}, [{', '.join(f'{chr(39)}{w}{chr(39)}' for w in c.FUNCTION_WORDS)}])")
def filter_language(q):
    seg = c.segment_fallback(q.clean_document)
    known = F.arrays_overlap(t.words(F.col("segment")), F.array(*map(F.lit, c.FUNCTION_WORDS)))
    return seg.where((c.alphabet_share(F.col("segment")) >= 0.98) & known).select("document_id", "seq")


@query("filter_source_allow", "SELECT document_id, CASE WHEN source IN ('xeber-arxiv', 'xeber-ofis', 'resmi-arxiv') AND text IS NOT NULL THEN 'accepted' ELSE 'unapproved_source_or_invalid_text' END AS reason FROM clean_document")
def filter_source_allow(q):
    ok = F.col("source").isin("xeber-arxiv", "xeber-ofis", "resmi-arxiv") & F.col("text").isNotNull()
    return q.clean_document.select("document_id", F.when(ok, "accepted").otherwise("unapproved_source_or_invalid_text").alias("reason"))


@query("reject_histogram", f"SELECT coalesce({_REASON}, 'accepted') AS reason, count(*) AS n FROM {_FALLBACK} GROUP BY 1")
def reject_histogram(q):
    return c.reject_histogram(c.segment_fallback(q.clean_document).withColumn("reason", c.reject_reason(F.col("segment"))))


@query("filter_paragraph_quality", rf"""
WITH line AS (SELECT document_id, unnest(range(0, len(p))) AS seq, {s.collapse('unnest(p)')} AS s
  FROM (SELECT document_id, string_split(text, chr(10)) AS p FROM clean_document WHERE text IS NOT NULL)),
word AS (SELECT *, regexp_extract_all(s, '{s.WORD}') AS w FROM line),
good AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS rank FROM word
  WHERE length(s) BETWEEN 90 AND 1600 AND len(w) >= 15 AND regexp_matches(s, '[.!?]["”»)]?$')
    AND len(list_distinct(list_transform(w, lambda x: {s.lower('x')})))::DOUBLE / len(w) >= 0.35
    AND {_SHARE} >= 0.97 AND len(regexp_extract_all(s, '[əıçğöşüƏÇĞÖŞÜ]')) >= 2 AND NOT regexp_matches(s, 'https?://|<[^>]*>|\[\d+\]'))
SELECT document_id, rank::INT AS rank, s AS paragraph FROM good WHERE rank <= 2""")
def filter_paragraph_quality(q):
    return c.paragraph_quality(q.clean_document)


@query("filter_eligible_word")
def filter_eligible_word(q):
    return c.eligible_words(q.data_row, "id", "target", "protected_terms")


@query("source_cap", "SELECT source, within, count(*) AS n FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY document_id) <= 75 AS within FROM clean_document) GROUP BY ALL")
def source_cap(q):
    """A source may have a quarter of a target of 300."""
    return c.source_cap(q.clean_document.select("source", "document_id"), "source", ["document_id"], 0.25, 300).groupBy("source", "within").agg(F.count("*").alias("n"))


@query("chunk_tokens", f"SELECT document_id, seq AS chunk, array_to_string(list_slice(w, seq * 96 + 1, seq * 96 + 96), ' ') AS tokens FROM (SELECT document_id, w, unnest(range(0, (len(w) + 95) // 96))::INT AS seq FROM (SELECT document_id, {_words('text')} AS w FROM clean_document WHERE text IS NOT NULL))")
def chunk_tokens(q):
    w = q.clean_document.where("text IS NOT NULL").select("document_id", t.words(F.col("text")).alias("w")).where("size(w) > 0")
    parts = w.select("document_id", "w", F.explode(F.sequence(F.lit(0), F.expr("cast((size(w) - 1) div 96 as int)"))).alias("chunk"))
    return parts.select("document_id", "chunk", F.array_join(F.slice("w", F.col("chunk") * 96 + 1, F.lit(96)), " ").alias("tokens"))


@query("overlap_windows", f"""SELECT document_id, seq AS win, array_to_string(list_slice(w, greatest(seq * 80 - 7, 1), seq * 80 + 96 - 8), ' ') AS tokens
FROM (SELECT document_id, w, unnest(range(0, (len(w) + 79) // 80))::INT AS seq FROM (SELECT document_id, {_words('text')} AS w FROM clean_document WHERE text IS NOT NULL))""")
def overlap_windows(q):
    """Eighty tokens a window, with eight tokens of context on either side."""
    w = q.clean_document.where("text IS NOT NULL").select("document_id", t.words(F.col("text")).alias("w")).where("size(w) > 0")
    parts = w.select("document_id", "w", F.explode(F.sequence(F.lit(0), F.expr("cast((size(w) - 1) div 80 as int)"))).alias("win"))
    lo = F.greatest(F.col("win") * 80 - 7, F.lit(1))
    return parts.select("document_id", "win", F.array_join(F.slice("w", lo, F.col("win") * 80 + 88 - lo + 1), " ").alias("tokens"))


_TOKENS = f"(SELECT document_id, seq, unnest(range(0, len(w)))::INT AS pos, unnest(w) AS word FROM (SELECT document_id, seq, {_words('s')} AS w FROM {_FALLBACK}))"


def _tokens(q):
    return c.segment_fallback(q.clean_document).select("document_id", "seq", F.posexplode(t.words(F.col("segment"))).alias("pos", "word"))


@query("lag_lead_tokens", f"""SELECT prev, word, nxt, count(*) AS n FROM (SELECT lag(word) OVER w AS prev, word, lead(word) OVER w AS nxt FROM {_TOKENS}
WINDOW w AS (PARTITION BY document_id, seq ORDER BY pos)) GROUP BY ALL""")
def lag_lead_tokens(q):
    """Neighbours within the sentence, from the sentence's own array: no window is sorted."""
    w = c.segment_fallback(q.clean_document).select(t.words(F.col("segment")).alias("w"))
    seq = F.sequence(F.lit(0), F.size("w") - 1)
    near = F.transform(seq, lambda i: F.struct(F.get("w", i - 1).alias("prev"), F.get("w", i).alias("word"), F.get("w", i + 1).alias("nxt")))
    return w.where("size(w) > 0").select(F.inline(near)).groupBy("prev", "word", "nxt").agg(F.count("*").alias("n"))


@query("sentence_counter", r"""SELECT event_id, user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS sentence FROM events""")
def sentence_counter(q):
    """A running count of boundary events per key, in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return q.events.select("event_id", "user_id", F.sum((F.col("event_type") == "error").cast("long")).over(w).alias("sentence"))


@query("running_reported_flag", "SELECT event_id, max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS reported FROM events")
def running_reported_flag(q):
    """A sticky flag that is reset with each day."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return q.events.select("event_id", F.max((F.col("event_type") == "purchase").cast("int")).over(w).alias("reported"))


@query("neighbour_counts", """SELECT event_id, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 16 FOLLOWING) AS following,
count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS preceding FROM events""")
def neighbour_counts(q):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    click = F.when(F.col("event_type") == "click", 1)
    return q.events.select("event_id", F.count(click).over(w.rowsBetween(1, 16)).alias("following"), F.count(click).over(w.rowsBetween(-12, -1)).alias("preceding"))


@query("progress_counters", "SELECT d, n, sum(n) OVER (ORDER BY d)::BIGINT AS so_far FROM (SELECT ts::DATE::VARCHAR AS d, count(*) AS n FROM events GROUP BY 1)")
def progress_counters(q):
    """Cumulative counts per day: one row a day goes through the unpartitioned window."""
    daily = q.events.groupBy(F.to_date("ts").cast("string").alias("d")).agg(F.count("*").alias("n"))
    return daily.select("d", "n", F.sum("n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"))
