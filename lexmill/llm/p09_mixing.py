"""Problem 9: a mix of sources in which each has its target share of all tokens.

Tokens are summed per source, repetition rates follow from them, and each document comes out floor(rate) times plus once more
if a hash of the seed and its id, as a number in [0, 1), is below the fraction. Nothing is shuffled but the sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm import tokens
from lexmill.session import cut


def source_key(source: Column) -> Column:
    """A source's name without letter case, padding and `_` for `-`."""
    return F.replace(F.lower(F.trim(source)), F.lit("_"), F.lit("-"))


def rates(sums: dict[str, int], weights: dict[str, tuple[float, int | None]], size: float | None = None) -> dict[str, float]:
    """How often each source's documents are to be used, for token sums and weights `(share, cap)`.

    Shares are those among the sources that have tokens, made to sum to one. Without a `size` the mix is the largest in which no cap binds
    (with no cap at all: as many tokens as there are). With a `size`, sources at their cap stay there and what they
    lack is spread over the others by share; if all are at their cap, the mix is smaller than asked for.
    """
    live = {s: (w, cap) for s, (w, cap) in weights.items() if w > 0 and sums.get(s, 0) > 0 and (cap is None or cap > 0)}
    if not live:
        return {}
    whole = sum(w for w, _ in live.values())
    share = {s: w / whole for s, (w, _) in live.items()}
    most = {s: math.inf if cap is None else float(cap * sums[s]) for s, (_, cap) in live.items()}
    if size is None:
        size = min(most[s] / share[s] for s in live)
        if math.isinf(size):
            size = float(sum(sums[s] for s in live))
    want, free, left = {}, set(live), float(size)
    while free:
        part = sum(share[s] for s in free)
        full = {s for s in free if left * share[s] / part > most[s] * (1 + 1e-12)}
        if not full:
            want |= {s: left * share[s] / part for s in free}
            break
        for s in full:
            want[s] = most[s]
            left -= most[s]
        free -= full
    out = {}
    for s, tokens_wanted in want.items():
        rate = tokens_wanted / sums[s]
        cap = live[s][1]
        out[s] = float(cap) if cap is not None and rate > cap * (1 - 1e-12) else rate
    return out


def weight_table(source_weight: DataFrame) -> dict[str, tuple[float, int | None]]:
    """`source -> (share, cap)`; a source named twice has the sum of its shares and its smallest cap. One row per source in the table."""
    rows = source_weight.where("source IS NOT NULL AND target_share IS NOT NULL").groupBy(source_key(F.col("source")).alias("source"))
    return {r["source"]: (float(r["share"]), r["cap"]) for r in rows.agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")).collect()}


def sized(documents: DataFrame, folder: str = tokens.FOLDER, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """`(doc_id, source, n_tokens)` with the source's key; whole texts are measured."""
    return documents.select("doc_id", source_key(F.col("source")).alias("source"), tokens.token_count(F.col("text"), folder, vocabulary).alias("n_tokens"))


def mix(items: DataFrame, weights: dict[str, tuple[float, int | None]], size: float | None = None, seed: int = 42) -> DataFrame:
    """`(doc_id, source, n_tokens, copy_no)`: one row per use of an item `(doc_id, source, n_tokens)`, copies from 0. Items of a source
    without weight, and those without a source, are not used."""
    names = F.col("source").isin(*weights)
    sums = {r["source"]: int(r["n"]) for r in items.where(names).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()} if weights else {}
    by_source = rates(sums, weights, size)
    if not by_source:
        return items.select("doc_id", "source", "n_tokens", F.lit(0).alias("copy_no")).limit(0)
    rate = F.element_at(F.create_map(*(F.lit(x) for pair in sorted(by_source.items()) for x in pair)), F.col("source"))
    unit = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    used = items.where(F.col("source").isin(*by_source)).withColumn("rate", rate)
    copies = (F.floor("rate") + F.when(unit < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    many = used.withColumn("copies", copies).where("copies > 0")
    return many.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy_no"))


def mixed(documents: DataFrame, source_weight: DataFrame, size: float | None = None, folder: str = tokens.FOLDER) -> DataFrame:
    """The mix of all documents by the table's weights."""
    return mix(cut(sized(documents, folder), "sizes"), weight_table(source_weight), size)


def shares(documents: DataFrame, source_weight: DataFrame, size: float | None = None, folder: str = tokens.FOLDER) -> DataFrame:
    """`(source, target_share, reached_share, available_tokens, used_tokens, max_copies, max_repeats)` for every source of either
    table; a source without documents reaches nothing, one without weight has the target 0."""
    items = cut(sized(documents, folder), "sizes")
    weights = weight_table(source_weight)
    have = items.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    used = mix(items, weights, size).groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), (F.max("copy_no") + 1).alias("max_copies"))
    whole = used.agg(F.sum("used_tokens")).first()[0] or 0
    wanted = documents.sparkSession.createDataFrame([(s, w, cap) for s, (w, cap) in sorted(weights.items())], "source string, target_share double, max_repeats int")
    every = have.join(wanted, have["source"].eqNullSafe(wanted["source"]), "full_outer").select(F.coalesce(have["source"], wanted["source"]).alias("source"), "available_tokens", "target_share", "max_repeats")
    out = every.join(used, "source", "left")
    return out.select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.round(F.coalesce(F.try_divide(F.col("used_tokens"), F.lit(whole)), F.lit(0.0)), 5).alias("reached_share"),
        F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.coalesce("max_copies", F.lit(0)).alias("max_copies"),
        "max_repeats",
    )
