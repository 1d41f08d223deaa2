"""Problem 8: filling containers of fixed capacity with items, by bounded-space online best fit.

Items come in a fixed order within a shard (a hash of the id). `OPEN` bins are open at a time, known by their free space in a
bitset: the lowest bit at or above an item's size is the best fit, and where none fits, the lowest bit of all, the fullest
bin, closes first. An item larger than the capacity is cut into full containers and a rest. A shard holds some
`SHARD_BINS` containers, so the bins still open at its end are a small share, and any number of shards go through one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import tokens
from lexmill.session import cut

#: Bins open at a time; containers of a shard.
OPEN, SHARD_BINS = 128, 8_000


class Packer:
    """Online best fit with at most `most` open bins. `put` gives an item's bin; bins are numbered as they open."""

    def __init__(self, capacity: int, most: int = OPEN):
        self.capacity, self.most = capacity, most
        self.bits, self.by_free, self.open, self.next = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.open -= 1
        return bin_

    def _keep(self, free: int, bin_: int) -> None:
        if free == 0:
            return  # full: closed
        self.by_free.setdefault(free, []).append(bin_)
        self.bits |= 1 << free
        self.open += 1

    def put(self, size: int) -> int:
        fits = self.bits >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            bin_ = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_ = self.capacity, self.next
            self.next += 1
        self._keep(free - size, bin_)
        return bin_


def pack(items: DataFrame, capacities: DataFrame, most: int = OPEN, shard_bins: int = SHARD_BINS) -> DataFrame:
    """`(container, shard, bin, id, piece, start_token, n_tokens, capacity_tokens)` for items `(id, n_tokens)` and capacities
    `(container, capacity_tokens)`: every token of every item once per container kind, no bin above its capacity.

    Items without tokens are in no bin. Null or non-positive capacities are left out, a container named twice keeps its
    larger capacity. Items with one id are packed each by itself. The result depends on the items alone, not on partitions.
    """
    kinds = [
        (r["container"], int(r["capacity_tokens"]))
        for r in capacities.where("container IS NOT NULL AND capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").alias("capacity_tokens")).orderBy("container").collect()
    ]
    sized = items.select("id", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0")
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    id_type = items.schema["id"].dataType.simpleString()
    parts = []
    for name, capacity in kinds:
        shards = max(1, round(total / (capacity * shard_bins)))
        h = F.xxhash64("id", "n_tokens")
        spread = sized.select("id", "n_tokens", F.pmod(h, F.lit(shards)).cast("long").alias("shard"), h.alias("h"))
        parts.append(spread.select(F.lit(name).alias("container"), F.lit(capacity).cast("long").alias("capacity"), "shard", "h", "id", "n_tokens"))
    if not parts:
        return items.sparkSession.createDataFrame([], f"container string, shard long, bin long, id {id_type}, piece int, start_token long, n_tokens long, capacity_tokens long")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    key = ["container", "shard"]
    ordered = every.repartition(*key).sortWithinPartitions(*key, "h", "id", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer = None, None
        for batch in batches:
            at, bins, pieces, starts, sizes = [], [], [], [], []
            columns = zip(*(batch.column(c).to_pylist() for c in ("container", "shard", "capacity", "n_tokens")))
            for i, (container, shard, capacity, n) in enumerate(columns):
                if (container, shard) != now:
                    now, packer = (container, shard), Packer(capacity, most)
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    at.append(i)
                    bins.append(packer.put(size))
                    pieces.append(piece)
                    starts.append(start)
                    sizes.append(size)
            take = pa.array(at, pa.int64())
            yield pa.record_batch([
                batch.column("container").take(take), batch.column("shard").take(take), pa.array(bins, pa.int64()), batch.column("id").take(take),
                pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), batch.column("capacity").take(take),
            ], names=["container", "shard", "bin", "id", "piece", "start_token", "n_tokens", "capacity_tokens"])

    return ordered.mapInArrow(run, f"container string, shard long, bin long, id {id_type}, piece int, start_token long, n_tokens long, capacity_tokens long")


def sizes(documents: DataFrame, folder: str = tokens.FOLDER, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """`(id, n_tokens)` of each document's whole text; null and empty texts have none."""
    return documents.select(F.col("doc_id").alias("id"), tokens.token_count(F.col("text"), folder, vocabulary).alias("n_tokens"))


def packed(documents: DataFrame, pack_capacity: DataFrame, folder: str = tokens.FOLDER) -> DataFrame:
    """The containers of all documents, for each capacity."""
    return pack(cut(sizes(documents, folder), "sizes"), pack_capacity)


def usage(documents: DataFrame, pack_capacity: DataFrame, folder: str = tokens.FOLDER) -> DataFrame:
    """`(container, capacity_tokens, bins, pieces, n_tokens, used_share)`: how full the containers of each kind are."""
    bins = packed(documents, pack_capacity, folder)
    per_bin = bins.groupBy("container", "capacity_tokens", "shard", "bin").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    total = per_bin.groupBy("container", "capacity_tokens").agg(F.count("*").alias("bins"), F.sum("pieces").alias("pieces"), F.sum("n").alias("n_tokens"))
    return total.withColumn("used_share", F.round(F.col("n_tokens") / (F.col("bins") * F.col("capacity_tokens")), 4))
