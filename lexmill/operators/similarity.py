"""Exact set similarity: self-join by prefix filter, novelty against a reference set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.session import cut


def representatives(sets: DataFrame, id: str, grams: str) -> tuple[DataFrame, DataFrame]:
    """`(reps, members)`: one row `(id, grams, n)` per distinct set, under its smallest id, and `(id, rep)` of every row. Sets are compared sorted; null sets are left out."""
    rows = sets.select(id, F.array_sort(F.array_distinct(grams)).alias("g"))
    # nulls go after the cut: before it, the planner would push the test down and work the grams out twice
    keyed = cut(rows.select(id, "g", F.sha2(F.array_join("g", "\x01"), 256).alias("h")), "sets").where("h IS NOT NULL")
    reps = keyed.groupBy("h").agg(F.min(id).alias("rep"), F.min_by("g", id).alias("grams"))
    members = keyed.select(id, "h").join(reps.select("h", "rep"), "h").select(id, "rep")
    return reps.select(F.col("rep").alias("id"), "grams", F.size("grams").alias("n")), members


def jaccard_pairs(reps: DataFrame, threshold: float = 0.8, least: int = 1) -> DataFrame:
    """`(id_a, id_b, shared, jaccard)` of all pairs of distinct sets `(id, grams, n)` with at least `least` members and a Jaccard
    similarity of `threshold` or more; none is lost.

    Grams are ordered by document frequency, rarest first; two such sets share one of the first n - ceil(t n) + 1 of each. Only those are
    joined, with the lengths' bound, and the candidates' whole sets are compared.
    """
    reps = cut(reps.where(F.col("n") >= max(1, least)), "reps")
    grams = reps.select("id", "n", F.explode("grams").alias("gram"))
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    known = grams.join(df.where("df > 1"), "gram", "left")  # a gram of one set can't be shared, but holds a place
    ordered = known.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), F.col("gram")))).alias("o"))
    size = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1
    prefix = ordered.select("id", "n", F.explode(F.filter(F.slice("o", F.lit(1), size.cast("int")), lambda x: x["df"] > 1)).alias("p")).select("id", "n", F.col("p.gram").alias("gram"))
    a = prefix.select(F.col("id").alias("id_a"), F.col("n").alias("na"), "gram")
    b = prefix.select(F.col("id").alias("id_b"), F.col("n").alias("nb"), "gram")
    near = a.join(b, "gram").where((F.col("id_a") < F.col("id_b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9))
    pairs = cut(near.select("id_a", "id_b").distinct(), "pairs")
    full = pairs.join(reps.select(F.col("id").alias("id_a"), F.col("grams").alias("ga")), "id_a").join(reps.select(F.col("id").alias("id_b"), F.col("grams").alias("gb")), "id_b")
    shared = full.select("id_a", "id_b", F.size(F.array_intersect("ga", "gb")).cast("long").alias("shared"), (F.size("ga") + F.size("gb")).alias("sum"))
    return shared.select("id_a", "id_b", "shared", F.round(F.col("shared") / (F.col("sum") - F.col("shared")), 6).alias("jaccard")).where((F.col("sum") - F.col("shared")) * threshold - 1e-9 <= F.col("shared"))


def novelty(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """`(id, score, nearest)`: of each query's gram set the highest Jaccard similarity with any reference set and the smallest id that
    reaches it, for `(id, grams)` on both sides; 0 and null where no gram is shared. Queries are the small side; each shared
    gram is one row, counted map-side per pair. Both sides are cut first: the shingles are then worked out once."""
    queries, reference = cut(queries.select("id", "grams"), "queries"), cut(reference.select("id", "grams"), "reference")
    q = queries.select(F.col("id").alias("qid"), F.size("grams").alias("nq"), F.explode("grams").alias("gram"))
    r = reference.select(F.col("id").alias("rid"), F.size("grams").alias("nr"), F.explode("grams").alias("gram"))
    both = r.join(q, "gram").groupBy("qid", "nq", "rid", "nr").agg(F.count("*").alias("shared"))
    score = F.round(F.col("shared") / (F.col("nq") + F.col("nr") - F.col("shared")), 6)
    best = both.withColumn("score", score).groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("rid"))).alias("m"))
    out = queries.join(best.withColumnRenamed("qid", "id"), "id", "left")
    return out.select("id", F.coalesce(-F.col("m.s"), F.lit(0.0)).alias("score"), F.col("m.rid").alias("nearest"))


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", block: int = 4096, shard: int = 65536) -> DataFrame:
    """`(query, neighbour, rank, cosine)`: each query's `k` nearest other vectors, ties by id. Exact.

    A stated query set goes against all rows in a grid: blocks of some `block` queries meet shards of some `shard` vectors, each cell in
    one task, so nothing is broadcast and no cell grows with the data. The k best per query and task are taken before the shuffle.
    """

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def unit(df: DataFrame, name: str, out: str) -> DataFrame:
        return df.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(F.col(id).alias(name), F.col(vector).alias(out), F.sqrt(dot(F.col(vector), F.col(vector))).alias(out + "_n"))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    blocks, shards = (max(1, -(-df.count() // size)) for df, size in ((queries, block), (vectors, shard)))
    q = unit(queries, "query", "q").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("shard", numbers(shards))
    v = unit(vectors, "neighbour", "v").withColumn("shard", F.pmod(F.xxhash64("neighbour"), F.lit(shards)).cast("int")).withColumn("block", numbers(blocks))
    pairs = v.join(q, ["block", "shard"]).where("neighbour != query")
    scored = pairs.select("query", "neighbour", F.round(F.try_divide(dot(F.col("v"), F.col("q")), F.col("v_n") * F.col("q_n")), 6).alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("cosine"), "neighbour"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
