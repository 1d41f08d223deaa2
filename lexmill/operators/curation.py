"""Segmentation and filters with counted reject reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import text as t

# Capitals that may open a sentence, common words of running Azerbaijani text, what running text has not.
CAPITAL = "A-ZƏÇĞİÖŞÜ"
FUNCTION_WORDS = (
    "və", "ilə", "üçün", "bu", "bir", "həmin", "üzrə", "kimi", "sonra", "hər", "də", "da", "deyil", "daha", "o", "həm", "isə", "ancaq",
    "çünki", "belə", "artıq", "çox", "hansı", "ki", "olan", "olub", "olduğu",
)
BAD = r"<[^>]+>|https?://|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|[\x{00}-\x{08}\x{0e}-\x{1f}\x{fffd}]"
ALPHABET = "a-zA-ZƏəÇçĞğİıÖöŞşÜü"


def _segmented(docs: DataFrame, key: str, text: str, parts: Column) -> DataFrame:
    trimmed = F.transform(parts, lambda x: t.collapse_ws(x))
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.filter(trimmed, lambda x: x != "")).alias("seq", "segment"))


def segment_fallback(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """`(key, seq, segment)`: a text cut after `.`, `!` or `?` before a capital, and at blank lines; blank segments are dropped, white
    space collapses, `seq` counts from 0. Null texts have none."""
    return _segmented(docs, key, text, F.split(text, rf"(?<=[.!?])\s+(?=[{CAPITAL}])|\n\s*\n"))


def segment_news(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """As `segment_fallback`, but initials (`X.` before a capital) end nothing and an opening quote or bracket may stand before the capital."""
    shield = F.regexp_replace(text, rf"\b([{CAPITAL}])\.(?=\s*[{CAPITAL}])", "$1")
    parts = F.split(shield, rf"(?<=[.!?])\s+(?=[“«\"(]*[{CAPITAL}])|\n\s*\n")
    return _segmented(docs, key, text, F.transform(parts, lambda x: F.replace(x, F.lit(""), F.lit("."))))


def paragraphs(docs: DataFrame, key: str = "document_id", text: str = "text", least: int = 40) -> DataFrame:
    """`(key, seq, paragraph, keyed)`: the blocks between blank lines; those of at least `least` characters take part in matching."""
    out = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("seq", "paragraph"))
    return out.select(key, "seq", t.collapse_ws(F.col("paragraph")).alias("paragraph")).where("paragraph != ''").withColumn("keyed", F.length("paragraph") >= least)


def alphabet_share(text: Column) -> Column:
    """Share of the letters that belong to the alphabet; null without letters."""
    letters = F.regexp_replace(text, r"[^\p{L}\p{Nl}\p{No}]", "")
    return F.try_divide(F.length(F.regexp_replace(letters, f"[^{ALPHABET}]", "")), F.length(letters))


def reject_reason(text: Column) -> Column:
    """Why a sentence is turned down, in the order the tests are made; null if it is accepted."""
    w = t.words(text)
    n = F.size(w)
    return (
        F.when(~n.between(4, 80) | (F.length(text) > 1000), "length")
        .when(~F.rlike(text, F.lit(r"[.!?]$")), "missing_terminal_punctuation")
        .when(F.rlike(text, F.lit(BAD)) | ~F.rlike(text, F.lit(rf"^[“«\"(]*[{CAPITAL}]")), "markup_contact_or_fragment")
        .when((alphabet_share(text) < 0.98) | ~F.arrays_overlap(w, F.array(*map(F.lit, FUNCTION_WORDS))), "language_heuristic")
    )


def judged_segments(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """`(key, seq, segment, reason)` of every news segment."""
    return segment_news(docs, key, text).withColumn("reason", reject_reason(F.col("segment")))


def reject_histogram(judged: DataFrame) -> DataFrame:
    """`(reason, n)`, accepted segments as `accepted`."""
    return judged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def paragraph_quality(docs: DataFrame, key: str = "document_id", text: str = "text", keep: int = 2) -> DataFrame:
    """`(key, rank, paragraph)`: a document's first `keep` lines that read like an article's paragraph: 90 to 1600 characters, 15
    words or more, closed, varied, in the alphabet, with native letters and without addresses or tags."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("seq", "line"))
    lines = lines.select(key, "seq", t.collapse_ws(F.col("line")).alias("paragraph"))
    w = F.regexp_extract_all("paragraph", F.lit(t.WORD), 0)
    good = lines.withColumn("w", w).where(
        F.length("paragraph").between(90, 1600)
        & (F.size("w") >= 15)
        & F.rlike("paragraph", F.lit(r"[.!?][\"”»)]?$"))
        & (F.size(F.array_distinct(F.transform("w", t.az_lower))) / F.size("w") >= 0.35)
        & (alphabet_share(F.col("paragraph")) >= 0.97)
        & (F.regexp_count("paragraph", F.lit("[əıçğöşüƏÇĞÖŞÜ]")) >= 2)
        & ~F.rlike("paragraph", F.lit(r"https?://|<[^>]*>|\[\d+\]"))
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    return good.withColumn("rank", rank).where(F.col("rank") <= keep).select(key, "rank", "paragraph")


def eligible_words(rows: DataFrame, key: str, text: str, terms: str) -> DataFrame:
    """`(key, word, start)` of words that may be altered: 2 to 32 letters of the alphabet, not within a protected span."""
    both = rows.where(F.col(text).isNotNull()).select(key, t.word_spans(text).alias("w"), t.protected_spans(text, terms).alias("p"))
    free = F.filter("w", lambda w: F.length(w["word"]).between(2, 32) & F.rlike(w["word"], F.lit(f"^[{ALPHABET}]+$")) & ~F.exists("p", lambda p: (w["start"] < p["end"]) & (w["end"] > p["start"])))
    return both.select(key, F.explode(free).alias("f")).select(key, F.col("f.word").alias("word"), F.col("f.start").alias("start"))


def source_cap(rows: DataFrame, source: str, order: list[str], share: float, target: int) -> DataFrame:
    """Rows with `within`: whether a row is among the first `share * target` of its source, by `order`. Rows are flagged, not
    dropped, so the number over the cap can be reported. A source's rows are ranked in one task: give it rows without texts."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return rows.withColumn("within", rank <= int(share * target))
