"""Problem 3: records that differ only in white space, letter case, punctuation, visual form or order of fields."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import visual
from lexmill.session import cut, shared_dir

#: A text that may consist of `field: value` items.
_FIELD_LIKE = r"^\s*(\{|[^:;|\n]+:)"

_PAIR = regex.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*("(?:[^"\\]|\\.)*"|[^,}"]+)')
_FIELD = regex.compile(r"^\W*\p{L}")


def _items(text: str) -> list[tuple[str, str]] | None:
    """The items of a text that consists of them, else None: a JSON object, or `field: value` between `;`, `|` or line breaks."""
    s = text.strip()
    if s.startswith("{") and s.endswith("}"):
        try:
            parsed = json.loads(s, object_pairs_hook=list)
            return [(str(k), v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in parsed]
        except (ValueError, TypeError):
            pairs = _PAIR.findall(s)
            return pairs or None
    for sep in (";", "|", "\n"):
        if sep not in s:
            continue
        parts = [p.partition(":") for p in s.split(sep) if p.strip()]
        if len(parts) > 1 and all(colon and _FIELD.search(field) for field, colon, _ in parts):
            return [(field, value) for field, _, value in parts]
    return None


def canonical_texts(texts: pa.Array) -> list[str]:
    """The canonical texts: letters and digits of the ordinary form in lower case; of items, the sorted items. Null gives an empty one."""
    values = visual.ordinary_array(texts)
    plain = visual.folded(values, False)
    for i in np.flatnonzero(pc.match_substring_regex(pa.array(values, pa.string()), _FIELD_LIKE).fill_null(False).to_numpy(zero_copy_only=False)):
        if items := _items(values[i]):
            flat = visual.folded([x for item in items for x in item], False)
            pairs = sorted(zip(flat[::2], flat[1::2]))
            # a single item is the same as its letters without the colon
            plain[i] = "\x02".join(f"{k}\x03{v}" for k, v in pairs) if len(pairs) > 1 else "".join(flat)
    return plain


@F.arrow_udf(T.BinaryType())
def _key_udf(v: pa.Array) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(t) if t else None for t in canonical_texts(v)], pa.binary())


def canonical_key(text: Column) -> Column:
    """128-bit key of the canonical text, null where the text has no letter or digit."""
    return _key_udf(text)


#: Buckets of the ledger: a batch rewrites those it has keys in. More of them suit a larger ledger and smaller batches.
BUCKETS = 64


def keyed(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`(space, id, at, bucket, key)` of records `(space, id, text, at)`: one row per id with a text, by its earliest delivery (of those
    without a time, or of one time, the smallest key)."""
    one = (
        records.select("space", "id", "at", canonical_key(F.col("text")).alias("key"))
        .where("key IS NOT NULL")
        .groupBy("space", "id")
        .agg(F.min(F.struct(F.col("at").isNull(), "at", "key")).alias("first"))
        .select("space", "id", "first.at", "first.key")
    )
    return one.select("space", "id", "at", F.pmod(F.hash("space", "key"), F.lit(buckets)).alias("bucket"), "key")


def batch_counts(batch: DataFrame) -> DataFrame:
    """One row per key of a keyed batch: copies and the smallest id; counted map-side, so a hot key is one row per task."""
    return batch.groupBy("bucket", "space", "key").agg(F.count("*").alias("copies"), F.min("id").alias("kept_id"))


def merged(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """Ledger rows `(bucket, space, key, copies, kept_id)` after a batch of counts of the same form: counts add up, the earliest
    (smallest) representative stays."""
    both = ledger.alias("l").join(batch.alias("b"), ["bucket", "space", "key"], "full_outer")
    return both.select(
        "bucket", "space", "key",
        (F.coalesce("l.copies", F.lit(0)) + F.coalesce("b.copies", F.lit(0))).alias("copies"),
        F.least("l.kept_id", "b.kept_id").alias("kept_id"),
    )


class Ledger:
    """A table of canonical keys in a shared folder, kept batch by batch.

    Each batch writes the buckets it has keys in anew, under its own name; a bucket's latest writing is the ledger, and no other
    bucket is read or written. Ids are kept as well, so an id that is delivered again in a later batch counts no second time. A batch
    whose name is known is not taken in again; one that did not finish leaves no trace in the ledger.
    """

    COUNTS = "space string, key binary, copies long, kept_id string, bucket int"
    IDS = "space string, id string, key binary, bucket int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _names(self, folder: str) -> list[str]:
        p = self._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(self._conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def batches(self) -> list[str]:
        """The finished batches, in the order they came in."""
        return [b for b in self._names(f"{self.path}/counts") if "_SUCCESS" in self._names(f"{self.path}/counts/{b}")]

    def counts(self, buckets: list[int] | None = None) -> DataFrame:
        """`(bucket, space, key, copies, kept_id)`: the ledger, or those of its buckets."""
        latest = {}
        for b in self.batches():
            for name in self._names(f"{self.path}/counts/{b}"):
                if name.startswith("bucket="):
                    latest[int(name[7:])] = f"{self.path}/counts/{b}/{name}"
        paths: dict[str, list[str]] = {}
        for k, p in latest.items():
            if buckets is None or k in buckets:
                paths.setdefault(p.rsplit("/", 1)[0], []).append(p)
        out = self.spark.createDataFrame([], self.COUNTS)
        for base, some in sorted(paths.items()):
            out = out.unionByName(self.spark.read.schema(self.COUNTS).option("basePath", base).parquet(*some))
        return out

    def members(self) -> DataFrame:
        """`(space, id, key, bucket)` of every id taken in."""
        some = [f"{self.path}/ids/{b}" for b in self.batches()]
        return self.spark.read.schema(self.IDS).parquet(*some) if some else self.spark.createDataFrame([], self.IDS)

    def take_in(self, batch: DataFrame) -> None:
        """Adds a keyed batch `(space, id, at, bucket, key)`."""
        known = self.batches()
        name = f"{len(known):08d}"
        new = batch.select("space", "id", "key", "bucket")
        if known:
            new = new.join(self.members().select("space", "id"), ["space", "id"], "left_anti")
        new.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/ids/{name}")
        fresh = batch_counts(self.spark.read.schema(self.IDS).parquet(f"{self.path}/ids/{name}"))
        if known:
            fresh = cut(fresh, "fresh")
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most the number of buckets
            fresh = merged(self.counts(touched), fresh)
        out = fresh.select("space", "key", "copies", "kept_id", "bucket").repartition("bucket")
        out.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/counts/{name}")


def collapse(records: DataFrame, late_days: int = 30) -> Ledger:
    """The ledger of records `(space, id, text, at)` in a folder of the shared one, taken in as two batches: all but the last `late_days` days,
    then those; a null time belongs to the first."""
    spark = records.sparkSession
    members = cut(keyed(records), "copies")
    edge = members.select(F.max("at") - F.make_interval(days=F.lit(late_days))).first()[0]
    late = F.coalesce(F.col("at") > F.lit(edge), F.lit(False))
    ledger = Ledger(spark, f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}")
    for batch in (members.where(~late), members.where(late)):
        ledger.take_in(batch)
    return ledger


def _records(data_row: DataFrame, clean_document: DataFrame) -> DataFrame:
    return clean_document.select(F.lit("clean_document").alias("space"), F.col("document_id").alias("id"), "text", F.col("ingested_at").alias("at")).unionByName(
        data_row.select(F.lit("data_row").alias("space"), "id", F.col("target").alias("text"), F.col("ingested_at").alias("at"))
    )


def found(data_row: DataFrame, clean_document: DataFrame) -> DataFrame:
    """`(kept_id, copy_id)`: of each set of copies the smallest id, beside each other member. Sets are formed within
    clean_document (by text) and within data_row (by target); texts without letter or digit are in no set."""
    ledger = collapse(_records(data_row, clean_document))
    several = ledger.counts().where("copies > 1").select("space", "key", "kept_id")
    return ledger.members().join(several, ["space", "key"]).where("id != kept_id").select("kept_id", F.col("id").alias("copy_id"))


def counted(data_row: DataFrame, clean_document: DataFrame) -> DataFrame:
    """`(space, kept_id, copies)`: one record per text with the number of its copies."""
    return collapse(_records(data_row, clean_document)).counts().select("space", "kept_id", "copies")
