"""Problem 6: splits that keep related records together, by a persisted component table.

A node is a document, a group or, for a record with neither, the record itself. The table `(node, root, split, held)` is
kept in the shared folder, one version per batch taken in. A batch brings links between nodes; known nodes stand for their
root, so only the batch's links and the changed components move. Roots are found by contraction: every node hooks onto its
smallest neighbour, chains are shortened by pointer jumping, links are renamed and thinned, until none is left; each
round at least halves the nodes that have links. A group's links are a star, never all pairs of its members, and a group's
centre is split into `FAN` partial centres, so a group with a third of all rows is many short groups.

A known component keeps its split. New ones fill the splits' deficits: those that are large beside the whole one by one,
the rest in the order of a hash, cut where the deficits end. If a batch joins components of different splits, the one
with most records keeps its split and the members of the others are held back (split null, held true), so that no two
related records ever stand in different splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.components import contract
from lexmill.session import cut

# Group ids that stand for a missing one.
PLACEHOLDERS = ("", "n/a", "-", "unknown", "yoxdur")

#: Partial centres of a group; components over 1/LARGE of all records are placed one by one (so at most LARGE of them); slices of the hash order.
FAN, LARGE, SLICES = 32, 256, 1024


def group_key(group_id: Column) -> Column:
    """The group id without letter case and padding; null where it is missing or a placeholder."""
    g = F.lower(F.trim(F.regexp_replace(group_id, r"[\s\p{Z}]+", " ")))
    return F.when(~g.isin(*PLACEHOLDERS), g)


def records(data_row: DataFrame, correction_pair: DataFrame) -> DataFrame:
    """`(space, id, document_id, group_key, at)` of both tables; a row delivered twice is one record, known by its first delivery.
    An id whose deliveries name several documents or groups keeps a row for each, so every link counts."""
    rows = data_row.select(F.lit("data_row").alias("space"), "id", "document_id", F.lit(None).cast("string").alias("group_key"), F.col("ingested_at").alias("at"))
    pairs = correction_pair.select(F.lit("correction_pair").alias("space"), "id", "document_id", group_key(F.col("group_id")).alias("group_key"), F.col("ingested_at").alias("at"))
    return rows.unionByName(pairs).groupBy("space", "id", "document_id", "group_key").agg(F.min("at").alias("at"))


def home(space: str = "space", id: str = "id") -> Column:
    """The node a record belongs to: its document, else its group, else the record itself (documents sort first, records last)."""
    return F.coalesce(
        F.concat(F.lit("d:"), F.col("document_id")),
        F.concat(F.lit("g:"), F.col("group_key")),
        F.concat_ws("", F.lit("r:"), F.col(space), F.lit(":"), F.col(id)),
    )


def links(recs: DataFrame, fan: int = FAN) -> DataFrame:
    """`(a, b)`: each document beside a partial centre of its group, each partial centre beside the group."""
    both = recs.where("document_id IS NOT NULL AND group_key IS NOT NULL").select("document_id", "group_key").distinct()
    centre = F.concat(F.lit("h:"), F.pmod(F.xxhash64("document_id"), F.lit(fan)).cast("string"), F.lit(":"), F.col("group_key"))
    star = both.select(F.concat(F.lit("d:"), F.col("document_id")).alias("a"), centre.alias("b"), F.concat(F.lit("g:"), F.col("group_key")).alias("c"))
    return star.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("c").alias("a"), F.col("b").alias("b"))))).distinct()


def shares(split_share: DataFrame) -> dict[str, float]:
    """The wanted proportions, made to sum to one. The table has one row per split."""
    rows = split_share.where("split IS NOT NULL AND share > 0").groupBy(F.lower(F.trim("split")).alias("split")).agg(F.sum("share").alias("share")).orderBy("split").collect()
    total = sum(r["share"] for r in rows)
    return {r["split"]: r["share"] / total for r in rows}


def _placed(new: DataFrame, have: dict[str, float], want: dict[str, float], seed: str) -> DataFrame:
    """`new (root, n)` with a split each, so that the splits come near their share of all records; null where no split is wanted."""
    spark = new.sparkSession
    if not want:
        return new.select("root", F.lit(None).cast("string").alias("split"))
    fresh = new.agg(F.sum("n")).first()[0] or 0
    total = fresh + sum(have.values())
    due = {s: max(0.0, w * total - have.get(s, 0.0)) for s, w in want.items()}
    limit = max(1, total // LARGE)
    large = {r["root"]: r["n"] for r in new.where(F.col("n") > limit).collect()}  # fewer than LARGE, whatever the corpus
    chosen = {}
    for root, n in sorted(large.items(), key=lambda x: (-x[1], x[0])):
        chosen[root] = max(sorted(due), key=lambda s: due[s])
        due[chosen[root]] = max(0.0, due[chosen[root]] - n)
    small = new.where(F.col("n") <= limit).withColumn("h", F.xxhash64(F.lit(seed), "root")).withColumn("slice", F.pmod("h", F.lit(SLICES)))
    sums = dict(small.groupBy("slice").agg(F.sum("n")).collect())  # at most SLICES rows
    scale = sum(sums.values()) / (sum(due.values()) or 1.0)
    edges, at = [], 0.0
    for s in sorted(due):
        at += due[s] * scale
        edges.append((at, s))
    start, before = [], 0
    for i in range(SLICES):
        start.append(before)
        before += sums.get(i, 0)
    first = F.element_at(F.lit(start), (F.col("slice") + 1).cast("int")) if start else F.lit(0)
    running = small.selectExpr("*", "sum(n) OVER (PARTITION BY slice ORDER BY h, root ROWS UNBOUNDED PRECEDING) - n / 2.0 AS mid").withColumn("mid", F.col("mid") + first)
    split = F.lit(edges[-1][1])
    for edge, s in reversed(edges[:-1]):
        split = F.when(F.col("mid") <= edge, s).otherwise(split)
    placed = running.select("root", split.alias("split"))
    rows = spark.createDataFrame([*chosen.items()], "root string, split string")
    return placed.unionByName(rows)


def take_in(table: DataFrame | None, recs: DataFrame, want: dict[str, float], seed: str = "splits") -> DataFrame:
    """The component table `(node, root, split, held, n)` after a batch of records `(space, id, document_id, group_key)`; `n` counts a node's records.

    Nodes that the table knows keep their split unless their component is joined to a larger one of another split; then
    they are held back. A batch taken in again changes the counts but neither roots nor splits.
    """
    spark = recs.sparkSession
    counts = recs.groupBy(home().alias("node")).agg(F.count("*").alias("fresh"))
    edges = links(recs)
    if table is None:
        table = spark.createDataFrame([], "node string, root string, split string, held boolean, n long")
    known = table.select("node", F.col("root").alias("was"))
    renamed = edges.join(known.select(F.col("node").alias("a"), F.col("was").alias("wa")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("was").alias("wb")), "b", "left")
    renamed = renamed.select("a", "b", F.coalesce("wa", "a").alias("ra"), F.coalesce("wb", "b").alias("rb"))
    # a known node's links are those of its root
    moved = contract(renamed.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).unionByName(counts.select("node")).distinct()
    every = (
        table.select("node", F.col("root").alias("was"), F.col("split").alias("old"), "held", "n")
        .join(nodes.join(counts, "node", "left"), "node", "full_outer")
        .select("node", F.coalesce("was", "node").alias("was"), "old", F.coalesce("held", F.lit(False)).alias("held"), F.coalesce("n", F.lit(0)).alias("n0"), F.coalesce("fresh", F.lit(0)).alias("fresh"))
    )
    joined = every.join(moved.select(F.col("node").alias("was"), F.col("root").alias("top")), "was", "left")
    rooted = cut(joined.select("node", "was", F.coalesce("top", "was").alias("root"), "old", "held", "n0", "fresh"), "rooted")

    # the split of each component: that of its largest known part
    parts = rooted.where("old IS NOT NULL").groupBy("root", "old").agg(F.sum("n0").alias("size"))
    kept = parts.groupBy("root").agg(F.max_by("old", F.struct("size", "old")).alias("kept"))
    sizes = rooted.groupBy("root").agg(F.sum(F.col("n0") + F.col("fresh")).alias("n"))
    have = {r["kept"]: float(r["n"]) for r in sizes.join(kept, "root").groupBy("kept").agg(F.sum("n").alias("n")).collect()}
    new = cut(sizes.join(kept, "root", "left_anti"), "new")
    split = cut(kept.select("root", F.col("kept").alias("split")).unionByName(_placed(new, have, want, seed)), "chosen")
    out = rooted.join(split, "root")
    held = F.col("held") | (F.col("old").isNotNull() & (F.col("old") != F.col("split")))
    return out.select("node", "root", F.when(~held, F.col("split")).alias("split"), held.alias("held"), (F.col("n0") + F.col("fresh")).alias("n"))


def batches(recs: DataFrame, late_days: int = 30) -> list[DataFrame]:
    """The records as they came: all but the last `late_days` days, then those. A null time belongs to the first batch."""
    edge = recs.select(F.max("at") - F.make_interval(days=F.lit(late_days))).first()[0]
    late = F.coalesce(F.col("at") > F.lit(edge), F.lit(False))
    return [recs.where(~late), recs.where(late)]


def components(data_row: DataFrame, correction_pair: DataFrame, split_share: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(records, table)`: the records of both tables and the component table after the batches they came in."""
    recs = cut(records(data_row, correction_pair), "records")
    want, table = shares(split_share), None
    for batch in batches(recs):
        table = cut(take_in(table, batch, want), "components")
    return recs, table


def found(data_row: DataFrame, correction_pair: DataFrame, split_share: DataFrame) -> DataFrame:
    """`(lead_document_id, document_id)`: each document that is not the smallest of its related set, beside the smallest.
    Documents sort before groups, so a component's root is its smallest document wherever it has one."""
    _, table = components(data_row, correction_pair, split_share)
    docs = table.where("node LIKE 'd:%' AND node != root")
    return docs.select(F.substring("root", 3, 1 << 30).alias("lead_document_id"), F.substring("node", 3, 1 << 30).alias("document_id"))


def assigned(data_row: DataFrame, correction_pair: DataFrame, split_share: DataFrame) -> DataFrame:
    """`(space, id, split, held)`: the split of each record; null and held where a conflicting merge awaits review."""
    recs, table = components(data_row, correction_pair, split_share)
    of = recs.select("space", "id", home().alias("node")).join(table.select("node", "split", "held"), "node")
    return of.groupBy("space", "id").agg(F.min("split").alias("split"), F.max("held").alias("held"))
