"""Kneser-Ney trigram model as tables: fit, probabilities, perplexity, pruning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions.text import suffix_class

START, END, UNKNOWN = "<s>", "</s>", "<unk>"


def word_counts(sentences: DataFrame, tokens: str = "w") -> DataFrame:
    """`(word, n)` over all sentences; partial counts are summed map-side."""
    return sentences.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(sentences: DataFrame, least: int = 3) -> DataFrame:
    """`(word)` of the words seen `least` times or more."""
    return word_counts(sentences).where(F.col("n") >= least).select("word")


def mapped_tokens(sentences: DataFrame, words: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """`(id, pos, word)` of sentences `(id, w)` with their end mark; words outside the vocabulary become their suffix class. With `classes (word)`,
    the outputs a model has seen, a class it hasn't becomes `<unk>`, as in scoring."""
    raw = sentences.select("id", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "word"))
    known = raw.join(words.select("word", F.lit(True).alias("known")), "word", "left")
    out = known.withColumn("as", F.when(F.col("known") | (F.col("word") == END), F.col("word")).otherwise(suffix_class(F.col("word"))))
    if classes is not None:
        seen = out.join(classes.select(F.col("word").alias("as"), F.lit(True).alias("seen")), "as", "left")
        out = seen.withColumn("as", F.when(F.col("seen") | F.col("known") | (F.col("word") == END), F.col("as")).otherwise(UNKNOWN))
    return out.select("id", "pos", F.col("as").alias("word"))


def trigram_rows(tokens: DataFrame) -> DataFrame:
    """`(id, pos, a, b, c)`: each output with its two predecessors, `<s>` before the start; `<s>` itself is no output."""
    w = Window.partitionBy("id").orderBy("pos")
    return tokens.select("id", "pos", F.coalesce(F.lag("word", 2).over(w), F.lit(START)).alias("a"), F.coalesce(F.lag("word", 1).over(w), F.lit(START)).alias("b"), F.col("word").alias("c"))


@dataclass
class Model:
    """The model's tables. `discount` lies in (0, 1)."""

    trigrams: DataFrame  # a, b, c, n
    contexts3: DataFrame  # a, b, total3, types3
    continuation2: DataFrame  # a, b, n: distinct left contexts of (a, b)
    contexts2: DataFrame  # a, total2, types2
    continuation1: DataFrame  # word, n: distinct left contexts of word
    discount: float


def fit(rows: DataFrame, discount: float = 0.75) -> Model:
    """The model of trigram rows `(a, b, c)`; an empty table gives empty tables."""
    if not 0 < discount < 1:
        raise ValueError("the discount must lie between 0 and 1")
    tri = rows.groupBy("a", "b", "c").agg(F.count("*").alias("n"))
    cont2 = tri.groupBy(F.col("b").alias("a"), F.col("c").alias("b")).agg(F.count("*").alias("n"))
    bigrams = tri.groupBy("b", "c").agg(F.sum("n").alias("n"))
    return Model(
        tri,
        tri.groupBy("a", "b").agg(F.sum("n").alias("total3"), F.count("*").alias("types3")),
        cont2,
        cont2.groupBy("a").agg(F.sum("n").alias("total2"), F.count("*").alias("types2")),
        bigrams.groupBy(F.col("c").alias("word")).agg(F.count("*").alias("n")),
        discount,
    )


def _smoothed(n: Column, total: Column, types: Column, lower: Column, discount: float) -> Column:
    seen = F.greatest(F.coalesce(n, F.lit(0)) - discount, F.lit(0.0)) / total
    return F.when(total.isNull(), lower).otherwise(seen + discount * types / total * lower)


def probabilities(rows: DataFrame, model: Model) -> DataFrame:
    """`rows (a, b, c, ...)` with `p1`, `p2`, `p3`: the unigram is the share of continuations (0 for unseen words), an unseen context
    falls back to the order below."""
    total = model.continuation1.agg(F.sum("n").alias("total1"))
    one = model.continuation1.join(F.broadcast(total)).select(F.col("word").alias("c"), (F.col("n") / F.col("total1")).alias("_p1"))
    x = rows.join(one, "c", "left").withColumn("p1", F.coalesce("_p1", F.lit(0.0)))
    x = x.join(model.contexts2.withColumnRenamed("a", "b"), "b", "left")
    x = x.join(model.continuation2.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("n2")), ["b", "c"], "left")
    x = x.withColumn("p2", _smoothed(F.col("n2"), F.col("total2"), F.col("types2"), F.col("p1"), model.discount))
    x = x.join(model.contexts3, ["a", "b"], "left").join(model.trigrams.select("a", "b", "c", F.col("n").alias("n3")), ["a", "b", "c"], "left")
    x = x.withColumn("p3", _smoothed(F.col("n3"), F.col("total3"), F.col("types3"), F.col("p2"), model.discount))
    return x.select(*rows.columns, "p1", "p2", "p3")


def perplexity(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`(examples, zero, perplexity)`: exp of the mean negative log of `p3`; null where any probability is 0 or there is none."""
    zero = F.sum((F.col("p3") <= 0).cast("long"))
    log = F.sum(F.when(F.col("p3") > 0, F.log("p3")))
    return scored.groupBy(*(by or [])).agg(F.count("*").alias("examples"), F.coalesce(zero, F.lit(0)).alias("zero"), F.when((zero == 0) & (F.count("*") > 0), F.round(F.exp(-log / F.count("*")), 4)).alias("perplexity"))


def pruned(counts: DataFrame, totals: DataFrame, context: list[str], word: str, limit: int, discount: float) -> tuple[DataFrame, DataFrame]:
    """`(entries, contexts)`: the `limit` most frequent n-grams at their discounted share of all, and each kept context's `backoff`, the mass not kept."""
    top = counts.orderBy(F.desc("n"), *context, word).limit(limit)
    entries = top.join(totals, context).select(*context, word, ((F.col("n") - discount) / F.col("total")).alias("p"))
    return entries, entries.groupBy(*context).agg((1 - F.sum("p")).alias("backoff"))


def pruned_probability(rows: DataFrame, p1: DataFrame, two: tuple[DataFrame, DataFrame], three: tuple[DataFrame, DataFrame]) -> DataFrame:
    """`rows (a, b, c, ...)` with `p`: P3 + b3 (P2 + b2 P1); what was not kept has probability 0 and back-off 1."""
    e2, c2 = two
    e3, c3 = three
    x = rows.join(p1.select(F.col("word").alias("c"), F.col("p").alias("q1")), "c", "left")
    x = x.join(e2.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("p").alias("q2")), ["b", "c"], "left").join(c2.select(F.col("a").alias("b"), F.col("backoff").alias("b2")), "b", "left")
    x = x.join(e3.select("a", "b", "c", F.col("p").alias("q3")), ["a", "b", "c"], "left").join(c3.select("a", "b", F.col("backoff").alias("b3")), ["a", "b"], "left")
    zero, one = F.lit(0.0), F.lit(1.0)
    p = F.coalesce("q3", zero) + F.coalesce("b3", one) * (F.coalesce("q2", zero) + F.coalesce("b2", one) * F.coalesce("q1", zero))
    return x.select(*rows.columns, p.alias("p"))
