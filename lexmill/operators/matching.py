"""Keyed matching: first occurrences, owners, leaks, aligned pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as t


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`(*keys, *order of the first row, n)`: the first row of each key by `order` and how many share the key. One map-side
    combined aggregation: no key's rows are gathered in one task. Null keys form a key of their own."""
    first = F.min(F.struct(*order)).alias("first")
    return rows.groupBy(*keys).agg(first, F.count("*").alias("n")).select(*keys, "first.*", "n")


def flag_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`rows` with `is_first`: whether a row is its key's first by `order` (ties: all equal rows are). Rows without key are first."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(first, key, "left").withColumn("is_first", F.col("_first").isNull() | (F.struct(*order) == F.col("_first"))).drop("_first")


def contamination(rows: DataFrame, reference: DataFrame, key: str, text: str, reference_text: str, n: int = 8) -> DataFrame:
    """`(key, same_sentence, shared_ngrams)` of the rows that share their whole word sequence or an n-gram with the reference.

    The reference's keys are made distinct first; whether they are broadcast is left to the planner, which knows their size.
    Null texts share nothing.
    """
    keys = reference.where(F.col(reference_text).isNotNull()).select(t.words(F.col(reference_text)).alias("w")).select(F.inline(t.typed_keys(F.col("w"), n))).distinct()
    own = rows.where(F.col(text).isNotNull()).select(key, t.words(F.col(text)).alias("w")).select(key, F.inline(t.typed_keys(F.col("w"), n)))
    hit = own.join(keys, ["key_type", "key"], "left_semi")
    return hit.groupBy(key).agg(F.max((F.col("key_type") == 0).cast("int")).alias("same_sentence"), F.sum((F.col("key_type") == 1).cast("long")).alias("shared_ngrams"))


def owner_collisions(keyed: DataFrame, order: str, split: str = "split") -> DataFrame:
    """`(key_type, key, owner, collisions)` of keys whose records lie in another split than the first record's, for
    `keyed (key_type, key, order, split)`."""
    owner = keyed.groupBy("key_type", "key").agg(F.min_by(split, F.struct(order, split)).alias("owner"))
    per_split = keyed.groupBy("key_type", "key", split).agg(F.countDistinct(order).alias("records"))
    return per_split.join(owner, ["key_type", "key"]).where(F.col(split) != F.col("owner")).groupBy("key_type", "key", "owner").agg(F.sum("records").alias("collisions"))


def classify_collisions(keyed: DataFrame) -> DataFrame:
    """`(key_type, key, clean_splits, clean_collision, affected)` for `keyed (key_type, key, side, split, row)`, side clean or noisy: a key
    with two or more clean splits collides cleanly; else its noisy rows outside the clean split are affected. A row of a key is reduced to its
    splits, a key to one record a split: no key's rows are gathered in one task."""
    at = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("split"))).alias(side)
    per_row = keyed.groupBy("key_type", "key", "row").agg(at("clean"), at("noisy"))
    # a row is counted at its noisy split or, with several of them, at none: then it is outside any one clean split
    record = lambda split, clean, n: F.struct(split.alias("split"), clean.cast("int").alias("clean"), n.cast("int").alias("n"))
    counted, several = F.col("row").isNotNull(), F.size("noisy") > 1
    parts = [
        F.transform("clean", lambda s: record(s, F.lit(1), F.lit(0))), F.transform("noisy", lambda s: record(s, F.lit(0), counted & ~several)),
        F.when(several, F.array(record(F.lit(None).cast("string"), F.lit(0), counted))).otherwise(F.array()),
    ]
    per_split = per_row.select("key_type", "key", F.inline(F.concat(*parts))).groupBy("key_type", "key", "split").agg(F.max("clean").alias("clean"), F.sum("n").alias("n"))
    outside = F.sum(F.when(F.col("clean") == 0, F.col("n")).otherwise(0)).alias("outside")
    per_key = per_split.groupBy("key_type", "key").agg(F.sum("clean").alias("clean_splits"), F.count("split").alias("splits"), outside).where("splits > 1")
    collides = F.col("clean_splits") > 1
    return per_key.select("key_type", "key", "clean_splits", collides.alias("clean_collision"), F.when(collides, F.lit(0)).otherwise(F.col("outside")).alias("affected"))


def guard_pairs(pairs: DataFrame, keyed: DataFrame, id: str = "id") -> DataFrame:
    """Pairs with affected rows made harmless: their input becomes the target, their category `identity`; `guarded` tells which."""
    clean = F.when(F.col("side") == "clean", F.col("split"))
    owner = keyed.groupBy("key_type", "key").agg(F.countDistinct(clean).alias("clean_splits"), F.min(clean).alias("owner"), F.countDistinct("split").alias("splits")).where("splits > 1 AND clean_splits <= 1")
    hit = keyed.where("side = 'noisy'").join(owner, ["key_type", "key"]).where("owner IS NULL OR split != owner").select(F.col("row").alias(id)).distinct().withColumn("guarded", F.lit(True))
    out = pairs.join(hit, id, "left").withColumn("guarded", F.coalesce("guarded", F.lit(False)))
    return out.withColumn("input", F.when(F.col("guarded"), F.col("target")).otherwise(F.col("input"))).withColumn("category", F.when(F.col("guarded"), "identity").otherwise(F.col("category")))


def misaligned(clean: DataFrame, noisy: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """`(id, problem)`: ids missing on one side, or whose `columns` differ; nulls are equal to nulls. Ids must be unique on each side."""
    a = clean.select(id, F.struct(*columns).alias("a"))
    b = noisy.select(id, F.struct(*columns).alias("b"))
    both = a.join(b, id, "full_outer")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra")
    for c in columns:
        problem = problem.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), f"differs:{c}")
    return both.select(id, problem.alias("problem")).where("problem IS NOT NULL")


def crossing(rows: DataFrame, key: str, split: str) -> DataFrame:
    """`(key, splits, n)` of keys in more than one split; null keys and splits are left out."""
    seen = rows.where(F.col(key).isNotNull() & F.col(split).isNotNull())
    return seen.groupBy(key).agg(F.countDistinct(split).alias("splits"), F.count("*").alias("n")).where("splits > 1")


def split_pairs_shared(rows: DataFrame, key: str, split: str) -> DataFrame:
    """`(split_a, split_b, shared)`: keys that two splits share, for each pair of splits. Keys are reduced to their few splits first."""
    per_key = rows.where(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = per_key.groupBy("s").agg(F.count("*").alias("n")).select("n", F.explode("s").alias("split_a"), "s").select("n", "split_a", F.explode("s").alias("split_b"))
    return pairs.where("split_a < split_b").groupBy("split_a", "split_b").agg(F.sum("n").alias("shared"))


def paired_status(before: Column, after: Column) -> Column:
    """fixed, regressed, retained-correct or open, from two verdicts."""
    return F.when(~before & after, "fixed").when(before & ~after, "regressed").when(before & after, "retained-correct").otherwise("open")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: str, cap: int, order: str) -> DataFrame:
    """`old` after the rows of `new`: a known key takes the new values but keeps its `keep` column; the newest `cap` rows by `order` stay."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("o"))
    b = new.select(*keys, F.struct(*values).alias("n"))
    joined = a.join(b, keys, "full_outer")
    merged = joined.select(*keys, *(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c == keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values))
    return merged.orderBy(F.desc(order), *keys).limit(cap)
