"""Deterministic splits, samples and orders: every draw is a hash of a seed and an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import text as t


def norm_split(split: Column) -> Column:
    """train, validation or test from any spelling; other values in lower case."""
    s = F.lower(F.trim(split))
    return F.when(s.isin("dev", "valid", "val"), "validation").otherwise(s)


def source_split(sources: DataFrame, source: str, seed: str = "42") -> DataFrame:
    """`(source, split)`: sources in the order of a hash, eighty percent train, ten validation, the rest test, each at least one;
    with fewer than three sources no split is possible and all are null. Sources are few: they go through one window."""
    distinct = sources.where(F.col(source).isNotNull()).select(source).distinct()
    w = Window.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(source)), 256))
    ranked = distinct.select(source, F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    train = F.least(F.col("n") - 2, F.greatest(F.lit(1), F.floor(F.col("n") * 0.8)))
    validation = F.least(F.col("n") - train - 1, F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)))
    split = F.when(F.col("n") < 3, None).when(F.col("r") <= train, "train").when(F.col("r") <= train + validation, "validation").otherwise("test")
    return ranked.select(source, split.alias("split"))


def hash_split(key: Column, prefix: str = "split-v1:") -> Column:
    """train below .8 of the unit interval of a hash, validation below .9, else test."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(prefix), key), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.when(key.isNull(), None).when(u < 0.8, "train").when(u < 0.9, "validation").otherwise("test")


def cluster_split(members: DataFrame, id: str, root: str) -> DataFrame:
    """`(id, split)`: all ids of a cluster in one split, drawn from a digest of its members. The digest is an order-free sum of the members' hashes, so no
    cluster is gathered in one task."""
    h = F.conv(F.substring(F.sha2(F.col(id), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    digest = members.groupBy(root).agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(h).cast("string")).alias("digest"))
    return members.join(digest, root).select(id, hash_split(F.col("digest")).alias("split"))


def mod_split(number: Column, of: int = 10) -> Column:
    """Below two test, two validation, else train, by the remainder."""
    r = F.pmod(number, F.lit(of))
    return F.when(r < 2, "test").when(r == 2, "validation").otherwise("train")


def sample_fixed(rows: DataFrame, id: str, limit: int, seed: str = "42") -> DataFrame:
    """The `limit` rows with the smallest hash of seed and id (all if there are no more): a top-k, not a sort."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")), 256), id).limit(limit)


def shuffle_order(rows: DataFrame, id: str, seed: str = "42") -> DataFrame:
    """`rows` in a seeded order that loses none: range-partitioned by a hash."""
    return rows.orderBy(t.pair_seed(F.lit(seed), F.col(id).cast("string")), id)


def stable_rotation(rows: DataFrame, group: str, changed: str, id: str, cap: int, seed: str = "42") -> DataFrame:
    """`(group, id, rank)`: per group the changed rows first, then the others in the order of a hash, at most `cap` (the feature's limit)."""
    w = Window.partitionBy(group).orderBy((~F.col(changed)).cast("int"), F.sha2(F.concat_ws(":", F.lit(seed), F.col(group), F.col(id)), 256), id)
    return rows.select(group, id, F.row_number().over(w).alias("rank")).where(F.col("rank") <= cap)
