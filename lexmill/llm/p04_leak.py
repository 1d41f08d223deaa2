"""Problem 4: evaluation texts inside the training corpus, by a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.llm import visual
from lexmill.session import cut


def postings(texts: DataFrame, keys: list[str]) -> DataFrame:
    """`(*keys, term, positions, n_words)`: one posting per term and text of `texts (*keys, text)`; term is the 64-bit hash of
    a plain word, positions count plain words from 0. Null texts and texts without a word have none."""
    schema = T.StructType([
        *texts.select(*keys).schema,
        T.StructField("term", T.LongType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
        T.StructField("n_words", T.IntegerType()),
    ])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.array(visual.folded(visual.ordinary_array(batch.column("text")), True), pa.string())
            split = pc.split_pattern(plain, " ")
            n = np.where(np.asarray(pc.equal(plain, "")), 0, np.asarray(pc.list_value_length(split), dtype=np.int64))
            coded = pc.dictionary_encode(pc.list_flatten(split.filter(pa.array(n > 0))))
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            code = np.asarray(coded.indices).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            if not len(row):
                continue
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((pos, code, row))
            row, code, pos = row[order], code[order], pos[order]
            start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
            take = pa.array(row[start])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)].astype(np.int32)), pa.array(pos.astype(np.int32)))
            yield pa.record_batch([*(batch.column(k).take(take) for k in keys), pa.array(table[code[start]].view(np.int64)), lists, pa.array(n[row[start]].astype(np.int32))], names=[*keys, "term", "positions", "n_words"])

    return texts.select(*keys, "text").where("text IS NOT NULL").mapInArrow(index, schema)


def windows(case_postings: DataFrame, frequency: DataFrame, width: int, unknown: int = 0) -> DataFrame:
    """Every `width` consecutive words of a case text of which at most `unknown` are not in the corpus:
    `(case_id, field, start, terms)`, terms sorted from the rarest (unknown ones first, with df 0), each with its position."""
    w = Window.partitionBy("case_id", "field").orderBy("pos").rowsBetween(0, width - 1)
    words = case_postings.select("case_id", "field", "term", "n_words", F.explode("positions").alias("pos")).join(frequency, "term", "left")
    listed = words.withColumn("terms", F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("pos"), F.col("term"))).over(w))
    whole = listed.where((F.size("terms") == width) & (F.col("pos") + width <= F.col("n_words")))
    return whole.select("case_id", "field", F.col("pos").alias("start"), F.sort_array("terms").alias("terms")).where(F.col("terms")[unknown]["df"] > 0)


def matches(corpus: DataFrame, cases: DataFrame, width: int = 12, slop: int = 0, least: int | None = None) -> DataFrame:
    """`(case_id, field, start, document_id, at, hits)`: windows of `width` case words found in a document from word `at` on.

    Where all words must stand in place (a phrase), the two rarest terms' posting lists of each window are intersected
    first, shifted by their offsets; the survivors are intersected with the other terms. Else (proximity) a term may stand
    up to `slop` words off and `least` of the terms must be there. Cases are a fixed, small set; the corpus index is
    written once and shuffled by term and document, so a term in every document spreads over all tasks.
    """
    least = width if least is None else least
    index = cut(postings(corpus.select("document_id", "text"), ["document_id"]), "postings")
    texts = cases.select(F.col("id").alias("case_id"), F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("input", "expected")))))
    queries = postings(texts, ["case_id", "field"])
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    window = cut(windows(queries, frequency, width, width - least), "windows")
    if slop or least < width:
        return _proximity(index, queries, window, width, slop, least)
    # postings of words that no window has are left where they are; the planner broadcasts the terms where they are few
    asked = window.select(F.explode("terms.term").alias("term")).distinct()
    place = index.join(asked, "term", "left_semi").select("term", "document_id", F.explode("positions").alias("found"))
    ranked = window.select("case_id", "field", "start", F.posexplode("terms").alias("rank", "t")).select(
        "case_id", "field", "start", "rank", F.col("t.term").alias("term"), (F.col("t.pos") - F.col("start")).alias("offset")
    )
    first = ranked.where("rank = 0").join(place, "term").select("case_id", "field", "start", "document_id", (F.col("found") - F.col("offset")).alias("at"))
    first = first.where("at >= 0")

    def intersect(candidates: DataFrame, terms: DataFrame) -> DataFrame:
        wanted = candidates.join(terms, ["case_id", "field", "start"])
        there = place.withColumnRenamed("found", "due")
        return wanted.withColumn("due", F.col("at") + F.col("offset")).join(there, ["term", "document_id", "due"], "left_semi")

    spot = ["case_id", "field", "start", "document_id", "at"]
    second = cut(intersect(first, ranked.where("rank = 1")).select(*spot), "survivors")
    rest = intersect(second, ranked.where("rank > 1"))
    return rest.groupBy(*spot).agg((F.count("*") + 2).alias("hits")).where(F.col("hits") >= least)


def _proximity(index: DataFrame, queries: DataFrame, window: DataFrame, width: int, slop: int, least: int) -> DataFrame:
    """As `matches`; a window is there if for some `at`, `least` of its words stand within `slop` of it plus their offset.

    Up to width - least words are missing, so of the width - least + 2 rarest words of a window two are there, be the
    others absent from the document or the corpus. Those are looked up once for all windows of a case text, as shifts of
    the text against the document. Stretches of two widths of the text and of two spans of shifts overlap by one, so every
    window is within one; where a stretch has two of the words, the text's other words are looked up and each window's
    counted. Until then texts and documents go by hashes, and each pair's stretches are counted where the pair is.
    """
    if width > 31:
        raise ValueError("a stretch of two widths has to fit the bits of a long")
    some, span = min(2, least), 2 * slop + 1
    tid, did = F.xxhash64("case_id", "field").alias("tid"), F.xxhash64("document_id").alias("did")
    terms = window.select(tid, F.posexplode("terms").alias("rank", "t"))
    rare = terms.where(F.col("rank") < width - least + some).select("tid", F.col("t.pos").alias("pos"), F.col("t.term").alias("term")).distinct()
    tasks = 4 * int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = rare.join(index.select("term", did, "positions"), "term").select("tid", "did", "pos", "positions").repartition(tasks, "tid", "did")

    part, stretch = F.floor(F.col("pos") / width).cast("int"), F.floor((F.col("found") - F.col("pos")) / span).cast("int")
    shifts = listed.select("tid", "did", "pos", F.explode("positions").alias("found"))
    parts = shifts.select("tid", "did", "pos", stretch.alias("of"), F.explode(F.array(part, part + 1)).alias("part"))
    parts = parts.select("tid", "did", "part", F.expr(f"shiftleft(1L, pos - {width} * (part - 1))").alias("bit"), F.explode(F.array("of", F.col("of") + 1)).alias("stretch"))
    held = parts.groupBy("tid", "did", "stretch", "part").agg(F.bit_or("bit").alias("bits")).where(F.bit_count("bits") >= some)
    near = cut(held.groupBy("tid", "did").agg(F.collect_set("stretch").alias("stretches")), "survivors")

    words = queries.select(tid, "term", F.explode("positions").alias("pos"))
    there = near.join(F.broadcast(words), "tid").join(index.select("term", "document_id", did, "positions"), ["term", "did"])
    there = there.select("tid", "document_id", "pos", "positions", F.explode("stretches").alias("stretch"))
    first = span * (F.col("stretch") - 1) + slop
    spots = F.filter(F.sequence(first, first + span - 1), lambda at: F.exists("positions", lambda p: F.abs(p - F.col("pos") - at) <= slop))
    there = there.select("tid", "document_id", "pos", F.explode(spots).alias("shift"))
    whole = there.groupBy("tid", "document_id", "shift").agg(F.collect_set("pos").alias("held")).where(F.size("held") >= least)
    about = queries.select(tid, "case_id", "field", "n_words").distinct().where(F.col("n_words") >= width)
    spot = ["case_id", "field", "document_id", "shift"]
    starts = whole.join(about, "tid").select(*spot, "held", F.explode(F.sequence(F.lit(0), F.col("n_words") - width)).alias("start"))
    counted = starts.withColumn("hits", F.size(F.filter("held", lambda p: (p >= F.col("start")) & (p < F.col("start") + width))))
    return counted.where(F.col("hits") >= least).select("case_id", "field", "start", "document_id", (F.col("shift") + F.col("start")).alias("at"), "hits")


def found(clean_document: DataFrame, dataset_case: DataFrame) -> DataFrame:
    """`(case_id, document_id)` where the text holds at least twelve consecutive plain words of the case's input or expected."""
    return matches(clean_document, dataset_case).select("case_id", "document_id").distinct()


def near(clean_document: DataFrame, dataset_case: DataFrame, slop: int = 2, least: int = 11) -> DataFrame:
    """`(case_id, document_id, hits)`: proximity matches; of some twelve consecutive case words, `least` stand within `slop` of their place.
    A missing word may be any of the twelve, one that the corpus doesn't know as well."""
    return matches(clean_document, dataset_case, slop=slop, least=least).groupBy("case_id", "document_id").agg(F.max("hits").alias("hits"))
