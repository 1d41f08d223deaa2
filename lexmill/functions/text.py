"""Text as columns: normal forms, tokens, keys. All but `nfc` and the span functions stay inside the JVM.

A null text gives a null (or, of tokens, a null array); an empty one gives an empty text or array.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space beyond ASCII, suffix classes in the order they are tried.
SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SUFFIXES = (
    "lardan", "lərdən", "larının", "lərinin", "ları", "ləri", "ların", "lərin", "lara", "lərə",
    "dan", "dən", "da", "də", "lar", "lər", "dır", "dir", "dur", "dür",
)
WORD = r"[\p{L}\p{Nl}\p{No}]+"


@F.arrow_udf(T.StringType())
def _nfc(v: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in v.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Unicode normal form C, by an Arrow UDF: Spark has no such function."""
    return _nfc(text)


def az_lower(text: Column) -> Column:
    """Lower case in which I is ı and İ is i."""
    return F.lower(F.translate(text, "Iİ", "ıi"))


def collapse_ws(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_ws(text: Column) -> Column:
    """NFC with collapsed white space."""
    return collapse_ws(nfc(text))


def norm_ci(text: Column) -> Column:
    """NFC, Azerbaijani lower case, collapsed white space."""
    return collapse_ws(az_lower(nfc(text)))


def fold_diacritics(text: Column) -> Column:
    """Azerbaijani lower case without diacritics."""
    return F.translate(az_lower(text), "əıçğöşü", "eicgosu")


def fold_qx(text: Column) -> Column:
    """As `fold_diacritics`, with q as k and x as h: the candidate index's key."""
    return F.translate(az_lower(text), "əçğıöşüqx", "ecgiosukh")


def normalize_digraphs(text: Column) -> Column:
    """sh, ch, gh as ş, ç, ğ."""
    return F.replace(F.replace(F.replace(text, F.lit("sh"), F.lit("ş")), F.lit("ch"), F.lit("ç")), F.lit("gh"), F.lit("ğ"))


def skeleton(text: Column) -> Column:
    """Folded consonants: digraphs resolved first, vowels dropped."""
    return F.regexp_replace(fold_diacritics(normalize_digraphs(az_lower(text))), "[aeiou]", "")


def norm_number_class(text: Column) -> Column:
    """Folded words and `<n>` for each number, joined by one space."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(fold_diacritics(text), r"\d+", " <n> "), F.lit("[a-z]+|<n>"), 0), " ")


def norm_alnum(text: Column) -> Column:
    """Folded, everything but a-z and digits as one space."""
    return F.trim(F.regexp_replace(fold_diacritics(text), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    """Runs of letters in Azerbaijani lower case."""
    return F.regexp_extract_all(az_lower(text), F.lit(WORD), 0)


def spaced_words(text: Column) -> Column:
    """`words` joined by one space, worked out without the array."""
    return F.trim(F.regexp_replace(az_lower(text), rf"[^{WORD[1:]}", " "))


def lm_tokens(text: Column) -> Column:
    """The words a language model reads; the same runs as `words`."""
    return words(text)


def ws_tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), 0)


def letter_words(text: Column) -> Column:
    """Letters with inner hyphens or apostrophes."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}+(?:[-’']\p{L}+)*"), 0)


def suffix_class(word: Column) -> Column:
    """`<suffix:x>` for the first suffix with more than two letters before it, else `<unk>`."""
    out = F.lit("<unk>")
    for s in reversed(SUFFIXES):
        out = F.when(F.endswith(word, F.lit(s)) & (F.length(word) > len(s) + 2), f"<suffix:{s}>").otherwise(out)
    return F.when(word.isNotNull(), out)


def case_label(word: Column) -> Column:
    """0 lower, 1 title, 2 upper, 3 mixed."""
    low, up = az_lower(word), F.upper(F.translate(word, "ıi", "Iİ"))
    rest = F.substring(word, 2, 1 << 30)
    return F.when(word == low, 0).when(word == up, 2).when((F.left(word, F.lit(1)) != F.left(low, F.lit(1))) & (rest == az_lower(rest)), 1).when(word.isNotNull(), 3)


def sentence_key(text: Column) -> Column:
    """SHA-256 of the space-joined words."""
    return F.sha2(F.array_join(words(text), " "), 256)


def word_ngrams(tokens: Column, n: int) -> Column:
    """The set of n-word shingles, joined by a space; empty where there are fewer than n tokens."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda at: F.array_join(F.slice(tokens, at, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(grams)).when(tokens.isNotNull(), F.array().cast("array<string>"))


def token_bigrams(tokens: Column) -> Column:
    """The set of bigrams, or of the tokens where there are fewer than two."""
    return F.when(F.size(tokens) >= 2, word_ngrams(tokens, 2)).otherwise(F.array_distinct(tokens))


def typed_keys(tokens: Column, n: int = 8) -> Column:
    """`array<struct<key_type, key>>` of a column of tokens: 0 with the sentence's hash, 1 with each n-gram's. As in `word_ngrams`, the tokens
    should be a column of their own: an expression would be worked out again for every n-gram."""
    grams = F.transform(word_ngrams(tokens, n), lambda g: F.struct(F.lit(1).alias("key_type"), F.sha2(g, 256).alias("key")))
    return F.concat(F.array(F.struct(F.lit(0).alias("key_type"), F.sha2(F.array_join(tokens, " "), 256).alias("key"))), grams)


def pair_seed(*parts: Column, sep: str = ":") -> Column:
    """The first eight bytes of SHA-256 over the parts, as DECIMAL(20, 0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of SHA-256 over the parts: the seeded draw of all generators."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def deletions(word: Column) -> Column:
    """The word and each word with one letter less, as a set."""
    n = F.length(word)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), F.when(n > 0, one).otherwise(F.array().cast("array<string>"))))


#: URLs, e-mail addresses and inline code.
LITERAL = r"`[^`\n]+`|https?://[^\s<>\"]+|www\.[^\s<>\"]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


def literal_spans(text: Column) -> Column:
    """Values of code, URL and e-mail spans, without trailing punctuation."""
    return F.transform(F.regexp_extract_all(text, F.lit(LITERAL), 0), lambda v: F.regexp_replace(v, r"[.,;:!?)\]]+$", ""))


def has_structure(text: Column) -> Column:
    """Whether a text holds Markdown headings, lists, tables or fences, or HTML tags."""
    return F.rlike(text, F.lit(r"(?m)^#{1,6} |^ *[-*+] |^ *\d+[.)] |^\|.*\|\s*$|```|</?[a-zA-Z][^>]*>"))


def html_visible_text(text: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space collapsed; five named entities resolved."""
    bare = F.regexp_replace(text, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    bare = F.regexp_replace(bare, r"</?[a-zA-Z][^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


_SPAN = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_LETTERS = re.compile(r"[^\W\d_]+")


@F.udf(_SPAN, useArrow=True)
def word_spans(text: str | None):
    """The words of the NFC text with their places in code points. An Arrow UDF: Spark has no match positions."""
    if text is None:
        return None
    return [(m.group(), m.start(), m.end()) for m in _LETTERS.finditer(unicodedata.normalize("NFC", text))]


_SENT = T.ArrayType(T.StructType([*_SPAN.elementType.fields, T.StructField("sentence", T.IntegerType())]))
_TOKEN = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")


@F.udf(_SENT, useArrow=True)
def tokenize_sent(text: str | None):
    """Letter words with places and the number of the sentence, which grows where a gap has `.`, `!`, `?` or a line break."""
    if text is None:
        return None
    out, at, sentence = [], 0, 0
    for m in _TOKEN.finditer(text):
        if out and any(c in ".!?\n" for c in text[at : m.start()]):
            sentence += 1
        out.append((m.group(), m.start(), m.end(), sentence))
        at = m.end()
    return out


_RANGE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_PROTECT = re.compile(r"```[\s\S]*?```|`[^`\n]+`|https?://\S+|www\.\S+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|</?[A-Za-z][^>]*>|\d+(?:[.,:/-]\d+)*%?")


@F.udf(_RANGE, useArrow=True)
def protected_spans(text: str | None, terms: list[str] | None):
    """Spans that no edit may touch: code, addresses, tags, numbers, given terms, words in capitals or with one inside a sentence; sorted, joined where they overlap."""
    if text is None:
        return None
    found = [m.span() for m in _PROTECT.finditer(text)]
    for term in terms or ():
        if term:
            found += [m.span() for m in re.finditer(re.escape(term), text)]
    for m in _LETTERS.finditer(text):
        w = m.group()
        first = not text[: m.start()].strip() or bool(re.search(r"[.!?]\s*[«“\"(]*$", text[: m.start()][-8:]))
        if len(w) > 1 and w.isupper() or w[0].isupper() and not first:
            found.append(m.span())
    out: list[list[int]] = []
    for lo, hi in sorted(found):
        if out and lo < out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]
