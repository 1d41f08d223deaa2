"""Problem 7: text statistics per document, and an ordered rule list that tells running prose from the rest.

A text is cut into stretches: pieces of at most `STRETCH` words of a line. Statistics of stretches and texts are built-in
column expressions. Two rule lists are induced from the reviewed documents by incremental reduced-error pruning: one over
stretches (each labelled as its document is, weighted by its characters), one over documents, whose statistics include the
share of characters in stretches that the first list calls no prose. Both lists become SQL CASE expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut

#: Words of a stretch; most labelled documents and stretches the rules are fitted on; thresholds tried per statistic.
STRETCH, LABELLED, SAMPLE, STEPS = 20, 20_000, 200_000, 48

_SPACE = r"[\s\p{Z}]+"


def _share(count: Column, of: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(count.cast("double"), of), F.lit(0.0)), 4)


def _left(text: str, drop: str) -> Column:
    """Characters of `text` but those that match."""
    return F.length(F.regexp_replace(text, drop, ""))


def common_words(function_word: DataFrame) -> list[str]:
    """The function words in lower case; the table is fixed (some hundred rows)."""
    return sorted({r["word"].strip().lower() for r in function_word.where("word IS NOT NULL").select("word").distinct().collect()})


def _lower(text: Column) -> Column:
    return F.lower(F.translate(text, "Iİ", "ıi"))


def stretches(texts: DataFrame, keys: list[str], size: int = STRETCH) -> DataFrame:
    """`(*keys, line_no, stretch, words, repeated)`: pieces of at most `size` words of every line with a word; `repeated` tells a line that
    came before in its text. Null and blank texts have none."""
    clean = texts.select(*keys, F.regexp_replace("text", r"\p{Cf}+", "").alias("text")).where("text IS NOT NULL")
    lines = clean.select(*keys, F.transform(F.split("text", r"[\r\n\u0085\u2028\u2029]+"), lambda s: F.trim(F.regexp_replace(s, _SPACE, " "))).alias("lines"))
    lines = lines.select(*keys, F.filter("lines", lambda s: s != "").alias("lines"))
    lines = lines.select(*keys, F.posexplode("lines").alias("line_no", "line"), "lines")
    lines = lines.select(*keys, "line_no", F.split("line", " ").alias("all"), (F.array_position("lines", F.col("line")) <= F.col("line_no")).cast("double").alias("repeated"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(size)), lambda at: F.slice("all", at, size))
    cutted = lines.select(*keys, "line_no", "repeated", (F.size("all") / 1.0).alias("line_words"), F.explode(pieces).alias("words"))
    return cutted.select(*keys, "line_no", "repeated", "line_words", "words", F.array_join("words", " ").alias("stretch"))


#: The statistics of a stretch that rules may speak of.
STRETCH_STATS = (
    "repeated", "line_words", "n_words", "mean_word", "letters", "digits", "upper", "signs", "closed", "marked", "keyed", "barred", "distinct", "common", "lowered", "numbers", "odd_words",
    "ended_words", "top_end",
)


def stretch_statistics(pieces: DataFrame, keys: list[str], common: list[str]) -> DataFrame:
    """`(*keys, chars, *STRETCH_STATS)` of stretches: shares of letters, digits, capitals and other signs among the characters
    without spaces, and of the words that are numbers, distinct, common, lower case, marked at their end or hardly pronounceable."""
    s = "stretch"

    def count(column: str, pattern: str) -> Column:
        return F.regexp_count(column, F.lit(pattern))

    n = F.size("words").cast("double")
    base = pieces.select(
        *keys, "repeated", "line_words", s, n.alias("n"), F.length(s).alias("chars"), (F.length(s) - n + 1).alias("solid"), _lower(F.col(s)).alias("low"),
        (F.length(s) - _left(s, r"[\p{L}\p{M}]+")).alias("letters"),
    ).withColumn("plain", F.regexp_extract_all("low", F.lit(r"[\p{L}\p{M}\p{N}]+"), 0))
    known = F.size(F.filter("plain", lambda w: w.isin(*common))) if common else F.lit(0)
    return base.select(
        *keys,
        "chars",
        "repeated", "line_words",
        F.col("n").alias("n_words"),
        F.round(F.col("solid") / F.col("n"), 2).alias("mean_word"),
        _share(F.col("letters"), F.col("solid")).alias("letters"),
        _share(F.length(s) - _left(s, r"\p{N}+"), F.col("solid")).alias("digits"),
        _share(count(s, r"\p{Lu}"), F.col("letters")).alias("upper"),
        _share(count(s, r"[\p{S}*&%#@\\/_{}]"), F.col("solid")).alias("signs"),
        F.rlike(s, F.lit(r"[.!?…。！？।؟][\p{Pf}\p{Pe}\p{Pi}\"']*$")).cast("double").alias("closed"),
        F.rlike(s, F.lit(r"^(?:[-–—•*·▪◦]|\(?\d+[.)]|[a-zA-Z][.)])(?: |$)")).cast("double").alias("marked"),
        _share(count(s, r"\p{L}\"? ?(?::=|=>|=|: ?[\p{L}\p{N}\"])"), F.col("n")).alias("keyed"),
        _share(count(s, r"[|;·»,<>{}\[\]]"), F.col("n")).alias("barred"),
        _share(F.size(F.array_distinct("plain")), F.size("plain").cast("double")).alias("distinct"),
        _share(known, F.col("n")).alias("common"),
        _share(count(s, r"(?:^| )[^\p{L} ]?\p{Ll}"), F.col("n")).alias("lowered"),
        _share(count(s, r"[^ \p{N}]*\p{N}[^ ]*"), F.col("n")).alias("numbers"),
        _share(count("low", r"[bcçdfgğhjklmnpqrsştvwxyzбвгджзйклмнпрстфхцчшщ]{4}|[aeəıioöuü]{3}|qx|xq"), F.col("n")).alias("odd_words"),
        _share(count(s, r"[.!?…。！？।؟:;,][\p{Pf}\p{Pe}\"']*(?: |$)"), F.col("n")).alias("ended_words"),
        _share(F.size(F.array_distinct(F.transform("plain", lambda w: F.right(w, F.lit(2))))), F.size("plain").cast("double")).alias("top_end"),
    )


#: The statistics of a document that rules may speak of.
DOCUMENT_STATS = ("junk", "junk_words", "lines", "words", "mean_line", "distinct_lines", "digits", "signs", "closed", "common", "distinct", "repeated", "letters", "numbers")


def document_statistics(stats: DataFrame, keys: list[str]) -> DataFrame:
    """`(*keys, chars, *DOCUMENT_STATS)` from stretches with `is_junk`: means weighted by the stretches' characters."""
    c = F.col("chars").cast("double")

    def mean(name: str) -> Column:
        return F.round(F.sum(F.col(name) * c) / F.sum(c), 4).alias(name)

    return stats.groupBy(*keys).agg(
        F.sum("chars").alias("chars"),
        F.round(F.sum(F.when(F.col("is_junk"), c).otherwise(0.0)) / F.sum(c), 4).alias("junk"),
        F.round(F.sum(F.when(F.col("is_junk"), F.col("n_words")).otherwise(0.0)) / F.sum("n_words"), 4).alias("junk_words"),
        F.sum(F.col("n_words") / F.col("line_words")).alias("lines"),
        F.sum("n_words").alias("words"),
        F.round(F.sum("n_words") / F.sum(F.col("n_words") / F.col("line_words")), 2).alias("mean_line"),
        F.round(F.sum(F.when(F.col("repeated") == 0, c).otherwise(0.0)) / F.sum(c), 4).alias("distinct_lines"),
        *(mean(x) for x in ("digits", "signs", "closed", "common", "distinct", "repeated", "letters", "numbers")),
    )


@dataclass(frozen=True)
class Rule:
    """All conditions `(statistic, sign, threshold)` together mean: no prose. `precision` is that on the pruning set."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float

    def sql(self) -> str:
        return " AND ".join(f"`{s}` {sign} {t!r}D" for s, sign, t in self.conditions)


def case_expression(rules: list[Rule]) -> str:
    """The rule list as a CASE: the first rule that holds decides, else it is prose."""
    whens = " ".join(f"WHEN {r.sql()} THEN true" for r in rules)
    return f"CASE {whens} ELSE false END" if rules else "false"


def _covers(x: dict[str, np.ndarray], conditions, n: int) -> np.ndarray:
    hit = np.ones(n, dtype=bool)
    for s, sign, t in conditions:
        hit &= (x[s] <= t) if sign == "<=" else (x[s] >= t)
    return hit


def _steps(v: np.ndarray) -> np.ndarray:
    """Thresholds to try: quantiles of the values and of the distinct values."""
    if not len(v):
        return v
    at = np.linspace(0, 1, STEPS)
    return np.unique(np.r_[np.quantile(v, at, method="nearest"), np.quantile(np.unique(v), at, method="nearest")])


def induce(x: dict[str, np.ndarray], positive: np.ndarray, weight: np.ndarray, seed: int = 7, most: int = 60) -> list[Rule]:
    """An ordered rule list by incremental reduced-error pruning: a rule is grown on two thirds of what is left by the best
    information gain until it covers no negative, its last conditions are pruned where the other third likes it better
    without, and what it covers is taken away; the first rule that is wrong more often than right on that third ends the list.
    """
    rng = np.random.default_rng(seed)
    left = np.arange(len(positive))
    steps = {s: _steps(v) for s, v in x.items()}
    rules: list[Rule] = []
    failed = 0
    while len(rules) < most and failed < 3 and positive[left].any():
        order = rng.permutation(left)
        third = len(order) // 3
        prune, grow = order[:third], order[third:]
        if not positive[grow].any():
            break
        inside, conditions = grow, []
        while len(conditions) < 6:
            p0, n0 = weight[inside][positive[inside]].sum(), weight[inside][~positive[inside]].sum()
            if n0 <= 0.002 * p0:
                break
            base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
            pos, w = positive[inside], weight[inside]
            for s, v in x.items():
                at = np.searchsorted(steps[s], v[inside], side="left")
                p = np.bincount(at, w * pos, len(steps[s]))
                n = np.bincount(at, w * ~pos, len(steps[s]))
                for sign, cp, cn in (("<=", p.cumsum(), n.cumsum()), (">=", p[::-1].cumsum()[::-1], n[::-1].cumsum()[::-1])):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(cp > 0, cp * (np.log2(cp / (cp + cn)) - base), -1.0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0] + 1e-9:
                        beside = min(max(k + (1 if sign == "<=" else -1), 0), len(steps[s]) - 1)  # half way to the next value
                        best = (gain[k], (s, sign, float(np.round((steps[s][k] + steps[s][beside]) / 2, 5))))
            if best[1] is None:
                break
            conditions.append(best[1])
            s, sign, t = best[1]
            inside = inside[(x[s][inside] <= t) if sign == "<=" else (x[s][inside] >= t)]
        part = {s: v[prune] for s, v in x.items()}

        def worth(k: int) -> tuple[float, float]:
            hit = _covers(part, conditions[:k], len(prune))
            p, n = weight[prune][hit & positive[prune]].sum(), weight[prune][hit & ~positive[prune]].sum()
            return ((p - n) / (p + n) if p + n else -1.0, p / (p + n) if p + n else 0.0)

        if not conditions:
            break
        keep = max(range(1, len(conditions) + 1), key=lambda k: (round(worth(k)[0], 3), -k))
        value, precision = worth(keep)
        if value <= 0.0:
            failed += 1
            continue
        failed = 0
        rules.append(Rule(tuple(conditions[:keep]), round(float(precision), 4)))
        left = left[~_covers({s: v[left] for s, v in x.items()}, conditions[:keep], len(left))]
    return rules


def labelled(prose_label: DataFrame, most: int = LABELLED) -> DataFrame:
    """`(document_id, is_prose)` of at most `most` reviewed documents, taken by a hash; null labels and contradictions are left out."""
    clear = prose_label.where("is_prose IS NOT NULL AND document_id IS NOT NULL").groupBy("document_id").agg(F.min("is_prose").alias("is_prose"), F.max("is_prose").alias("other"))
    return clear.where("is_prose = other").select("document_id", "is_prose").orderBy(F.xxhash64("document_id"), "document_id").limit(most)


def _arrays(rows: DataFrame, names) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    pdf = rows.toPandas()
    return {s: pdf[s].to_numpy(float) for s in names}, ~pdf["is_prose"].to_numpy(bool), pdf["chars"].to_numpy(float)


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[Rule], list[Rule]]:
    """Stretch rules and document rules from the stretch statistics `(document_id, ...)` of labelled documents. The driver sees at
    most `sample` stretches and as many documents as there are labels (at most LABELLED)."""
    known = cut(stats.join(F.broadcast(labels), "document_id"), "labelled")
    some = known.orderBy(F.xxhash64("document_id", "line_words", "chars")).limit(sample)
    by_stretch = induce(*_arrays(some.select("is_prose", "chars", *STRETCH_STATS), STRETCH_STATS))
    docs = document_statistics(known.withColumn("is_junk", F.expr(case_expression(by_stretch))), ["document_id", "is_prose"])
    x, positive, _ = _arrays(docs.select("is_prose", "chars", *DOCUMENT_STATS), DOCUMENT_STATS)
    return by_stretch, induce(x, positive, np.ones(len(positive)))


def judged(clean_document: DataFrame, prose_label: DataFrame, function_word: DataFrame) -> DataFrame:
    """`(document_id, chars, *DOCUMENT_STATS, no_prose)` of every document with a word; others are no prose and absent here."""
    stats = cut(stretch_statistics(stretches(clean_document.select("document_id", "text"), ["document_id"]), ["document_id"], common_words(function_word)), "stretches")
    by_stretch, by_document = fit(stats, labelled(prose_label))
    docs = document_statistics(stats.withColumn("is_junk", F.expr(case_expression(by_stretch))), ["document_id"])
    return docs.withColumn("no_prose", F.expr(case_expression(by_document)))


def found(clean_document: DataFrame, prose_label: DataFrame, function_word: DataFrame) -> DataFrame:
    """`(document_id)` of the documents that the rules call no prose. Null and blank texts are no cases."""
    return judged(clean_document, prose_label, function_word).where("no_prose").select("document_id")


def statistics(clean_document: DataFrame, function_word: DataFrame) -> DataFrame:
    """`(document_id, source, n_words, mean_word_len, symbol_ratio, closed_lines, common_words, distinct_words)` of each row's whole text.

    Words are runs of letters and digits; symbols are neither letter, digit nor white space; a line is closed if it ends in a
    mark, maybe followed by a quote or bracket; common words are those of `function_word`. Shares are null where there is nothing to divide by; a
    null text counts as an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(_lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
    lines = F.filter(F.split(text, "\n"), lambda s: F.rlike(s, F.lit(r"[^ \t\r]")))
    common = common_words(function_word)
    base = clean_document.select(
        "document_id", "source", text.alias("text"), words.alias("w"), F.size(lines).alias("n_lines"),
        F.size(F.filter(lines, lambda s: F.rlike(s, F.lit(r"[.!?…。！？।؟][»”\"')\]]*[ \t\r]*\z")))).alias("n_closed"),
    )
    n = F.size("w")
    return base.select(
        "document_id",
        "source",
        n.cast("long").alias("n_words"),
        F.round(F.try_divide(F.length(F.array_join("w", "")), n), 6).alias("mean_word_len"),
        F.round(F.try_divide(F.length(F.regexp_replace("text", r"[\p{L}\p{N} \t\r\n]", "")), F.length("text")), 6).alias("symbol_ratio"),
        F.round(F.try_divide(F.col("n_closed"), F.col("n_lines")), 6).alias("closed_lines"),
        F.round(F.try_divide(F.size(F.filter("w", lambda x: x.isin(*common))) if common else F.lit(0), n), 6).alias("common_words"),
        F.round(F.try_divide(F.size(F.array_distinct("w")), n), 6).alias("distinct_words"),
    )


def by_source(clean_document: DataFrame, prose_label: DataFrame, function_word: DataFrame) -> DataFrame:
    """`(source, documents, n_words, mean_word_len, symbol_ratio, closed_lines, common_words, prose_share)`: means of the documents' statistics
    and the share of running prose. Sources compare without letter case and padding; a null source is one of its own; a text
    without a word is no prose."""
    stats = statistics(clean_document, function_word)
    prose = judged(clean_document, prose_label, function_word).select("document_id", (~F.col("no_prose")).alias("prose"))
    each = stats.join(prose, "document_id", "left").withColumn("source", F.replace(F.lower(F.trim("source")), F.lit("_"), F.lit("-")))
    return each.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum("n_words").alias("n_words"),
        *(F.round(F.avg(c), 4).alias(c) for c in ("mean_word_len", "symbol_ratio", "closed_lines", "common_words")),
        F.round(F.avg(F.coalesce("prose", F.lit(False)).cast("double")), 4).alias("prose_share"),
    )
