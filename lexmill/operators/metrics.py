"""Evaluation: quality, reliability, bootstrap, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import distance, text as t

# Fixed value: the 97.5 % quantile of the normal distribution.
Z = 1.959963984540054


def wilson_lower(correct: Column, total: Column) -> Column:
    """Lower bound of the 95 % Wilson interval; null without cases."""
    n = total.cast("double")
    p = correct / n
    return F.when(total > 0, (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n))


def exactness(rows: DataFrame, category: str) -> DataFrame:
    """`(category, rows, exact, identity, identity_changed, accuracy)` of rows `(input, target, actual)`, per category and over all
    (category null), by grouping sets. Rows with a null text are left out; a null category counts as `(none)`."""
    ok = rows.where("input IS NOT NULL AND target IS NOT NULL AND actual IS NOT NULL").select(F.coalesce(category, F.lit("(none)")).alias("category"), "input", "target", "actual")
    same = F.col("input") == F.col("target")
    return ok.rollup("category").agg(
        F.count("*").alias("rows"),
        F.sum((F.col("actual") == F.col("target")).cast("long")).alias("exact"),
        F.sum(same.cast("long")).alias("identity"),
        F.sum((same & (F.col("actual") != F.col("target"))).cast("long")).alias("identity_changed"),
        F.round(F.avg((F.col("actual") == F.col("target")).cast("double")), 6).alias("accuracy"),
    )


def quality(rows: DataFrame, by: list[str]) -> DataFrame:
    """Micro-averaged quality of rows `(input, target, actual)`: character and word error rates, precision, recall and F0.5 of edit spans,
    summed before they are divided; a rate with nothing below is null. Rows too long to align are counted in `unaligned`."""
    ok = rows.where("input IS NOT NULL AND target IS NOT NULL AND actual IS NOT NULL").withColumn("_counts", distance.quality_counts("input", "target", "actual"))
    s = {c: F.sum(f"_counts.{c}") for c in ("word_errors", "words", "tp", "fp", "fn")}
    chars = F.sum(F.levenshtein("actual", "target"))
    tp, fp, fn = s["tp"], s["fp"], s["fn"]
    return ok.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.sum(F.col("_counts").isNull().cast("long")).alias("unaligned"),
        F.round(F.try_divide(chars, F.sum(F.length("target"))), 6).alias("cer"),
        F.round(F.try_divide(s["word_errors"], s["words"]), 6).alias("wer"),
        F.round(F.try_divide(tp, tp + fp), 6).alias("precision"),
        F.round(F.try_divide(tp, tp + fn), 6).alias("recall"),
        F.round(F.try_divide(1.25 * tp, 1.25 * tp + 0.25 * fn + fp), 6).alias("f05"),
    )


def reliability_bins(rows: DataFrame, bins: int = 5) -> DataFrame:
    """`(bin, n, mean_score, accuracy, brier)` of rows `(score in [0, 1], correct)`; the last bin is closed. Null scores are left out."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    hit = F.col("correct").cast("double")
    return rows.where("score IS NOT NULL AND correct IS NOT NULL").groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg((F.col("score") - hit) ** 2), 6).alias("brier")
    )


def group_reliability(rows: DataFrame, group: str) -> DataFrame:
    """`(groups, all_correct, wilson_low)`: groups whose accepted rows are all correct."""
    per = rows.groupBy(group).agg(F.min(F.col("correct").cast("int")).alias("ok"))
    return per.agg(F.count("*").alias("groups"), F.coalesce(F.sum("ok"), F.lit(0)).alias("all_correct")).withColumn("wilson_low", F.round(wilson_lower(F.col("all_correct"), F.col("groups")), 6))


def shapley(outcomes: DataFrame, by: str) -> DataFrame:
    """`(by, model, contribution)` of rows `(by, mask, exact)`, one per mask 0..7 of three switches: each switch's mean gain over all orders
    of switching on; the three add up to the gain of all over none."""
    wide = outcomes.groupBy(by).agg(*(F.sum(F.when(F.col("mask") == m, F.col("exact"))).alias(f"m{m}") for m in range(8)))
    parts = []
    for name, bit in (("first", 4), ("second", 2), ("third", 1)):
        gains = [(1 / 6 if bin(m).count("1") == 1 else 1 / 3) * (F.col(f"m{m | bit}") - F.col(f"m{m}")) for m in range(8) if not m & bit]
        parts.append(F.struct(F.lit(name).alias("model"), F.round(sum(gains[1:], gains[0]), 6).alias("contribution")))
    return wide.select(by, F.inline(F.array(*parts)))


def zero_error_threshold(rows: DataFrame) -> DataFrame:
    """`(threshold, accepted)`: the lowest score above which every row `(score, correct)` is right, and how many those are."""
    worst = rows.where("NOT correct").agg(F.max("score").alias("worst"))
    ok = rows.join(F.broadcast(worst)).where(F.col("worst").isNull() | (F.col("score") > F.col("worst")))
    return ok.agg(F.min("score").alias("threshold"), F.count("*").alias("accepted"))


def bootstrap(rows: DataFrame, cluster: str, value: str, rounds: int = 200, seed: str = "20261007") -> DataFrame:
    """`(mean, low, high)`: the ratio estimate and the 2.5 and 97.5 % quantiles over Poisson bootstrap rounds that draw whole clusters.

    Each cluster gets a hash-seeded Poisson(1) weight per round; sums are formed per round, so only `rounds` rows are sorted.
    """
    sums = rows.where(F.col(value).isNotNull() & F.col(cluster).isNotNull()).groupBy(cluster).agg(F.sum(value).cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    u = t.unit_hash(F.lit(seed), F.col("round").cast("string"), F.col(cluster).cast("string"))
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        steps.append(total)
        p /= k + 1
    weight = sum(((u >= c).cast("int") for c in steps[1:]), (u >= steps[0]).cast("int"))
    drawn = sums.select(cluster, "s", "n", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("k", weight)
    per = drawn.groupBy("round").agg(F.try_divide(F.sum(F.col("k") * F.col("s")), F.sum(F.col("k") * F.col("n"))).alias("m"))
    bounds = per.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))
    whole = sums.agg(F.round(F.try_divide(F.sum("s"), F.sum("n")), 6).alias("mean"))
    return whole.join(F.broadcast(bounds)).select("mean", "low", "high")


def nearest_rank(rows: DataFrame, by: str, value: str) -> DataFrame:
    """`(by, n, mean, p50, p95, low, high)` with nearest-rank quantiles."""
    q = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}`)"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)")
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), q[0].alias("p50"), q[1].alias("p95"), F.min(value).alias("low"), F.max(value).alias("high"))


def top_per_group(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first `k` rows per group with `rank`; partial ranks are cut before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
