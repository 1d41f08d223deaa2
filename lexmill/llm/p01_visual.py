"""Problem 1: text that looks the same but is written with other characters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import visual
from lexmill.session import cut


def canonical_members(tokens: DataFrame) -> DataFrame:
    """`(mapped, canonical)` for tokens `(surface, mapped)`: look-alike-mapped tokens that are equal under the
    accent-sensitive Unicode collation form a class, and the class's canonical member is its smallest mapped form
    (mapped forms before surfaces, then by code points). A mapped form is its own ordinary form, so a token that needs mapping is never its
    class's canonical member, whatever other rows there are. Null rows are ignored; an empty table gives an empty one.
    """
    spark = tokens.sparkSession
    pairs = tokens.select("surface", "mapped").where("mapped IS NOT NULL").distinct()
    return spark.sql(
        """
        WITH member AS (
            SELECT collate(mapped, 'UNICODE') AS class, mapped, 0 AS rank, mapped AS form FROM {pairs}
            UNION ALL
            SELECT collate(mapped, 'UNICODE') AS class, mapped, 1 AS rank, surface AS form FROM {pairs}
        ), chosen AS (
            SELECT class, min_by(form, struct(rank, form)) AS canonical FROM member GROUP BY class
        )
        SELECT DISTINCT p.mapped, c.canonical
        FROM {pairs} p JOIN chosen c ON collate(p.mapped, 'UNICODE') = c.class
        """,
        pairs=pairs,
    )


def changed_tokens(values: DataFrame) -> DataFrame:
    """One row per token that is not written in the ordinary form: the columns of `values` but `text`, then `surface` and
    `mapped`. Null and empty texts give no row.
    """
    keys = [c for c in values.columns if c != "text"]
    schema = T.StructType([*values.select(*keys).schema, T.StructField("surface", T.StringType()), T.StructField("mapped", T.StringType())])

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = batch.filter(pc.match_substring_regex(batch.column("text"), visual.SUSPICIOUS))
            at, surface, mapped = [], [], []
            for i, text in enumerate(odd.column("text").to_pylist()):
                for a, b in visual.changes(text):
                    at.append(i)
                    surface.append(a)
                    mapped.append(b)
            take = pa.array(at, pa.int64())
            yield pa.record_batch([*(odd.column(c).take(take) for c in keys), pa.array(surface, pa.string()), pa.array(mapped, pa.string())], names=[*keys, "surface", "mapped"])

    return values.select(*keys, "text").where("text IS NOT NULL").mapInArrow(changed, schema)


def with_canonical(values: DataFrame) -> DataFrame:
    """`changed_tokens` joined back to the canonical member of each token's class; the join key is the mapped form, which
    adaptive execution splits where one token is hot."""
    tokens = cut(changed_tokens(values), "tokens")
    return tokens.join(canonical_members(tokens), "mapped")


def normalized(values: DataFrame) -> DataFrame:
    """`values` with `ordinary_text`: every text in its one ordinary form (null stays null, plain text stays as it is)."""
    return values.withColumn("ordinary_text", visual.ordinary_column(F.col("text")))


def found(data_row: DataFrame, clean_document: DataFrame) -> DataFrame:
    """`(record_id, field_name)` of each value with a token that differs from its canonical member. A row delivered twice
    counts once; null values are no cases."""
    rows = data_row.select(
        F.col("id").alias("record_id"),
        F.inline(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("input", "target")))),
    )
    docs = clean_document.select(F.col("document_id").alias("record_id"), F.lit("text").alias("field_name"), "text")
    hit = with_canonical(rows.unionByName(docs)).where(F.col("surface") != F.col("canonical"))
    return hit.select("record_id", "field_name").distinct()
