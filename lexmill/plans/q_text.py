"""Normalisation, tokens and keys (survey 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import features, text as t
from lexmill.plans import sql as s
from lexmill.plans.registry import query


def _value(expression: str) -> str:
    return f"SELECT document_id, {expression} AS value FROM clean_document"


def _text(name: str, function, expression: str) -> None:
    query(name, _value(expression))(lambda q: q.clean_document.select("document_id", function(F.col("text")).alias("value")))


_text("az_lower", t.az_lower, s.lower("text"))
_text("normalize_ws", t.normalize_ws, s.collapse("nfc_normalize(text)"))
_text("norm_ci", t.norm_ci, s.collapse(s.lower("nfc_normalize(text)")))
_text("fold_diacritics", t.fold_diacritics, s.fold("text"))
_text("fold_qx", t.fold_qx, f"translate({s.lower('text')}, 'əçğıöşüqx', 'ecgiosukh')")
_DIGRAPHS = "replace(replace(replace(%s, 'sh', 'ş'), 'ch', 'ç'), 'gh', 'ğ')"
_text("normalize_digraphs", t.normalize_digraphs, _DIGRAPHS % "text")
_text("skeleton", t.skeleton, f"regexp_replace({s.fold(_DIGRAPHS % s.lower('text'))}, '[aeiou]', '', 'g')")
_text("norm_number_class", t.norm_number_class, rf"array_to_string(regexp_extract_all(regexp_replace({s.fold('text')}, '\d+', ' <n> ', 'g'), '[a-z]+|<n>'), ' ')")
_text("norm_alnum", t.norm_alnum, f"trim(regexp_replace({s.fold('text')}, '[^a-z0-9]+', ' ', 'g'))")
_text("words", lambda x: F.array_join(t.words(x), "|"), f"array_to_string({s.words('text')}, '|')")
_text("lm_tokens", lambda x: F.coalesce(F.size(t.lm_tokens(x)), F.lit(0)).cast("long"), f"coalesce(len({s.words('text')}), 0)::BIGINT")
_text("ws_tokens", lambda x: F.array_join(t.ws_tokens(x), "|"), r"array_to_string(regexp_extract_all(text, '\S+'), '|')")
_text("letter_words", lambda x: F.array_join(t.letter_words(x), "|"), r"array_to_string(regexp_extract_all(text, '\p{L}+(?:[-’'']\p{L}+)*'), '|')")
_text("sentence_key", t.sentence_key, f"sha256(array_to_string({s.words('text')}, ' '))")
_text("literal_spans", lambda x: F.array_join(t.literal_spans(x), "|"), "array_to_string(list_transform(regexp_extract_all(text, '" + t.LITERAL + r"'), lambda v: regexp_replace(v, '[.,;:!?)\]]+$', '')), '|')")
_text("has_structure", t.has_structure, r"regexp_matches(text, '(?m)^#{1,6} |^ *[-*+] |^ *\d+[.)] |^\|.*\|\s*$|```|</?[a-zA-Z][^>]*>')")


@query("html_visible_text", r"""
SELECT document_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(h, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '</?[a-zA-Z][^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS value
FROM (SELECT document_id, '<div class="x"><script>var a = 1;</script><p>' || text || '</p><!-- c --></div>' AS h FROM clean_document)""")
def html_visible_text(q):
    page = F.concat(F.lit('<div class="x"><script>var a = 1;</script><p>'), "text", F.lit("</p><!-- c --></div>"))
    return q.clean_document.select("document_id", t.html_visible_text(page).alias("value"))


_SUFFIX_SQL = "CASE " + " ".join(f"WHEN ends_with(word, '{x}') AND length(word) > {len(x) + 2} THEN '<suffix:{x}>'" for x in t.SUFFIXES) + " ELSE '<unk>' END"


@query("suffix_class", f"SELECT word, {_SUFFIX_SQL} AS class, count(*) AS n FROM (SELECT unnest({s.words('target')}) AS word FROM data_row) GROUP BY word")
def suffix_class(q):
    word = q.data_row.select(F.explode(t.words(F.col("target"))).alias("word"))
    return word.groupBy("word").agg(F.count("*").alias("n")).select("word", t.suffix_class(F.col("word")).alias("class"), "n")


@query("case_label", rf"""
SELECT word, CASE WHEN word = {s.lower('word')} THEN 0 WHEN word = upper(translate(word, 'ıi', 'Iİ')) THEN 2
  WHEN left(word, 1) <> left({s.lower('word')}, 1) AND word[2:] = {s.lower('word[2:]')} THEN 1 ELSE 3 END AS label, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(target, '{s.WORD}')) AS word FROM data_row) GROUP BY word""")
def case_label(q):
    word = q.data_row.select(F.explode(F.regexp_extract_all("target", F.lit(t.WORD), 0)).alias("word"))
    return word.groupBy("word").agg(F.count("*").alias("n")).select("word", t.case_label(F.col("word")).alias("label"), "n")


@query("pair_seed", "SELECT id, document_id, ('0x' || substr(sha256('42:' || id || ':' || split), 1, 16))::UBIGINT::VARCHAR AS seed FROM data_row WHERE split IS NOT NULL")
def pair_seed(q):
    return q.data_row.where("split IS NOT NULL").select("id", "document_id", t.pair_seed(F.lit("42"), F.col("id"), F.col("split")).cast("string").alias("seed"))


@query("word_ngrams", f"SELECT document_id, unnest({s.ngrams('w', 3)}) AS gram FROM (SELECT document_id, {s.words('text')} AS w FROM clean_document WHERE text IS NOT NULL)")
def word_ngrams(q):
    w = q.clean_document.where("text IS NOT NULL").select("document_id", t.words(F.col("text")).alias("w"))
    return w.select("document_id", F.explode(t.word_ngrams(F.col("w"), 3)).alias("gram"))


@query("token_bigrams", f"SELECT document_id, unnest(CASE WHEN len(w) >= 2 THEN {s.ngrams('w', 2)} ELSE list_distinct(w) END) AS gram FROM (SELECT document_id, {s.words('text')} AS w FROM clean_document WHERE text IS NOT NULL)")
def token_bigrams(q):
    w = q.clean_document.where("text IS NOT NULL").select("document_id", t.words(F.col("text")).alias("w"))
    return w.select("document_id", F.explode(t.token_bigrams(F.col("w"))).alias("gram"))


@query("typed_keys", f"""
SELECT id, key_type, key FROM (
  SELECT id, 0 AS key_type, sha256(array_to_string(w, ' ')) AS key FROM (SELECT id, {s.words('target')} AS w FROM data_row WHERE target IS NOT NULL)
  UNION ALL
  SELECT id, 1, sha256(unnest({s.ngrams('w', 8)})) FROM (SELECT id, {s.words('target')} AS w FROM data_row WHERE target IS NOT NULL))""")
def typed_keys(q):
    w = q.data_row.where("target IS NOT NULL").select("id", t.words(F.col("target")).alias("w"))
    return w.select("id", F.inline(t.typed_keys(F.col("w"))))


@query("deletions", "SELECT DISTINCT word, unnest(list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))))) AS key FROM (SELECT DISTINCT unnest(" + s.words("target") + ") AS word FROM data_row)")
def deletions(q):
    word = q.data_row.select(F.explode(t.words(F.col("target"))).alias("word")).distinct()
    return word.select("word", F.explode(t.deletions(F.col("word"))).alias("key"))


@query("word_spans")
def word_spans(q):
    return q.clean_document.select("document_id", F.inline(t.word_spans("text")))


@query("tokenize_sent")
def tokenize_sent(q):
    return q.clean_document.select("document_id", F.inline(t.tokenize_sent("text")))


@query("protected_spans")
def protected_spans(q):
    return q.data_row.select("id", F.inline(t.protected_spans("target", "protected_terms")))


@query("char_vector")
def char_vector(q):
    return q.data_row.select(F.explode(t.words(F.col("target"))).alias("word")).distinct().select("word", features.char_vector("word").alias("vector"))


@query("hash_bins")
def hash_bins(q):
    return q.data_row.where("target IS NOT NULL").select("id", features.hash_bins(t.words(F.col("target"))).alias("bins"))
