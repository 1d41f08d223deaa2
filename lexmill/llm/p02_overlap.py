"""Problem 2: records of the evaluation splits that recur, exactly or almost, in training.

Each distinct text (plain words) gets a 64-bit similarity hash: bit h(word) mod 64 is flipped for each distinct word, so
texts that differ in d words differ in at most 2d bits, always. Segments of that code cannot be the join keys: a fifth of
fifty words allows twenty bits, and one of 21 segments of 64 bits, three bits long, is shared by any two texts. What is joined
instead are blocks of the text, one per pair of neighbouring words. Two texts within e edits share a block among the rarest
`blocks_needed(n)` of each, by any order common to both: every edit destroys at most two pairs. The order is by frequency
in a sketch of fixed size over all texts. So candidates from equal blocks within the Hamming radius contain every true
pair, and the verification by word edit distance leaves only those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import visual
from lexmill.session import cut

#: Buckets of the frequency sketch (a power of two): 4 MB in the driver and in each worker, whatever the corpus.
SKETCH_BITS = 20


def side(split: Column) -> Column:
    """0 for train, 1 for validation and test in any spelling, null for the rest."""
    s = F.lower(F.trim(split))
    return F.when(s == "train", 0).when(s.isin("validation", "valid", "dev", "val", "test"), 1)


def occurrences(data_row: DataFrame) -> DataFrame:
    """`(id, source, split, side, words)` per text of a row with a split: the plain words of input and target, once if equal."""
    s = F.lower(F.trim("split"))
    return (
        data_row.select("id", "source", F.when(s.isin("valid", "dev", "val"), "validation").otherwise(s).alias("split"), side(F.col("split")).alias("side"), "input", "target")
        .where("side IS NOT NULL")
        .select("id", "source", "split", "side", visual.plain_words(F.col("input")).alias("a"), visual.plain_words(F.col("target")).alias("b"))
        .select("id", "source", "split", "side", F.explode(F.array_distinct(F.array("a", "b"))).alias("words"))
        .where("words != ''")
    )


def allowed(n: np.ndarray) -> np.ndarray:
    """Edits within a fifth of n words."""
    return n // 5


def blocks_needed(n: np.ndarray) -> np.ndarray:
    """So many of the rarest blocks of a text of n words hold one of any text within a fifth of the longer one's words."""
    return np.maximum(2 * allowed(n), 2 * allowed(n + 1) - 1) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: the hash of each word, of each pair with the next word (the last of a text is void), the texts' word counts."""
    lists = pc.split_pattern(words, " ")
    n = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    h = table[np.asarray(coded.indices)]
    pair = _mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else np.empty(0, np.uint64)
    return h, np.append(pair, np.uint64(0))[: len(h)], n


def _inner(n: np.ndarray) -> np.ndarray:
    """Where a pair starts: everywhere but at the last word of a text."""
    keep = np.ones(int(n.sum()), dtype=bool)
    keep[np.cumsum(n)[n > 0] - 1] = False
    return keep


def frequency_sketch(texts: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of all word pairs of `texts.words`, hashed into 2**bits buckets. The driver gets at most 2**bits counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            _, pair, n = _hashed(batch.column(0))
            total += np.bincount((pair[_inner(n)] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (batch.column(i).to_numpy() for i in (0, 1))
            n = np.minimum(n, np.iinfo(np.int32).max)
            yield pa.record_batch({"at": [at.astype(np.int32).tobytes()], "n": [n.astype(np.int32).tobytes()]})

    per_task = texts.select("words").mapInArrow(count, "bucket int, n long")
    packed = per_task.groupBy("bucket").agg(F.sum("n").alias("n")).mapInArrow(pack, "at binary, n binary")
    sketch = np.zeros(1 << bits, dtype=np.int32)
    for row in packed.toLocalIterator():
        sketch[np.frombuffer(row["at"], np.int32)] = np.frombuffer(row["n"], np.int32)
    return sketch


def code_blocks(texts: DataFrame, sketch: np.ndarray) -> DataFrame:
    """`(block, text_id, side_flags, bits, n)`: the rarest blocks of each text of four words or more; shorter ones
    are within a fifth of no other text."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)
    bits = int(sketch.size).bit_length() - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for batch in batches:
            h, pair, n = _hashed(batch.column("words"))
            if not len(h):
                continue
            row = np.repeat(np.arange(len(n)), n)
            # the similarity hash: parity of the distinct words' bits
            order = np.lexsort((h, row))
            first = np.ones(len(h), dtype=bool)
            first[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
            code = np.zeros(len(n), dtype=np.uint64)
            np.bitwise_xor.at(code, row[order][first], np.uint64(1) << (h[order][first] >> np.uint64(58)))
            # the rarest distinct blocks
            inner = _inner(n) & (n[row] >= 4)
            row, pair = row[inner], pair[inner]
            rare = freq[(pair >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.lexsort((pair, rare, row))
            row, pair = row[order], pair[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
            row, pair = row[new], pair[new]
            start = np.searchsorted(row, np.arange(len(n)))
            keep = np.arange(len(row)) - start[row] < blocks_needed(n)[row]
            row, pair = row[keep], pair[keep]
            take = pa.array(row)
            yield pa.record_batch({
                "block": pa.array(pair.view(np.int64)),
                "text_id": batch.column("text_id").take(take),
                "sides": batch.column("sides").take(take),
                "code": pa.array(code.view(np.int64)[row]),
                "n": pa.array(n[row].astype(np.int32)),
            })

    return texts.select("text_id", "sides", "words").mapInArrow(emit, "block long, text_id binary, sides int, code long, n int")


def edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Word edit distance, or most + 1 where it is more; common ends are cut, then a band of the table is filled."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    if not a:
        return len(b)
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        new[0] = min(i, far)
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1, far)
        row = new
        if min(row[lo - 1 : hi + 1]) > most:
            return far
    return row[-1]


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> bool:
        p, q = x.split(" "), y.split(" ")
        most = max(len(p), len(q)) // 5
        return edit_distance(p, q, most) <= most

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)


def near_texts(texts: DataFrame) -> DataFrame:
    """`(train_id, eval_id)`: text ids of distinct texts `(text_id, words, sides)` across the sides (1 train, 2 evaluation, 3 both)
    that differ in at least one and at most a fifth of the longer one's words."""
    blocks = code_blocks(texts, frequency_sketch(texts))
    a = blocks.where("sides IN (1, 3)").select("block", F.col("text_id").alias("train_id"), F.col("code").alias("ca"), F.col("n").alias("na"))
    b = blocks.where("sides IN (2, 3)").select("block", F.col("text_id").alias("eval_id"), F.col("code").alias("cb"), F.col("n").alias("nb"))
    radius = 2 * F.floor(F.greatest("na", "nb") / 5)
    candidates = (
        a.join(b, "block")
        .where((F.col("train_id") != F.col("eval_id")) & (F.abs(F.col("na") - F.col("nb")) * 5 <= F.greatest("na", "nb")))
        .where(F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= radius)
        .select("train_id", "eval_id")
        .distinct()
    )
    # one pass over the texts serves both ends of a pair
    ends = cut(candidates, "candidates").select("train_id", "eval_id", F.explode(F.array("train_id", "eval_id")).alias("text_id"))
    return (
        ends.join(texts.select("text_id", "words"), "text_id")
        .groupBy("train_id", "eval_id")
        .agg(F.max(F.when(F.col("text_id") == F.col("train_id"), F.col("words"))).alias("x"), F.max(F.when(F.col("text_id") == F.col("eval_id"), F.col("words"))).alias("y"))
        .where(_near("x", "y"))
        .select("train_id", "eval_id")
    )


def overlaps(data_row: DataFrame) -> DataFrame:
    """`(train_row, eval_row)`, ids of rows across the splits that share a text, exactly (letters and digits of the plain
    form) or almost (near_texts). Rows without a known split, null and empty texts are in no pair; a row delivered twice
    counts once. Copies of a text are compared once and expanded at the end."""
    seen = occurrences(data_row).select(
        "id", "side", "words", F.unhex(F.md5("words")).alias("text_id"), F.unhex(F.md5(F.replace("words", F.lit(" "), F.lit("")))).alias("letters")
    )
    seen = cut(seen, "occurrences")
    texts = seen.groupBy("text_id").agg(F.min("words").alias("words"), F.bit_or(F.col("side") + 1).alias("sides"))
    texts = cut(texts, "texts")
    rows = seen.select("id", "side", "text_id", "letters")
    train = rows.where("side = 0").select(F.col("id").alias("train_row"), F.col("text_id").alias("train_id"), "letters")
    test = rows.where("side = 1").select(F.col("id").alias("eval_row"), F.col("text_id").alias("eval_id"), "letters")
    same = train.join(test, "letters").select("train_row", "eval_row")
    near = near_texts(texts).join(train, "train_id").join(test, "eval_id").select("train_row", "eval_row")
    return same.union(near).distinct()


def found(data_row: DataFrame) -> DataFrame:
    """`(id_a, id_b)` with id_a < id_b of each overlap; an id that occurs in both splits is no pair with itself."""
    pair = overlaps(data_row)
    return pair.where("train_row != eval_row").select(F.least("train_row", "eval_row").alias("id_a"), F.greatest("train_row", "eval_row").alias("id_b")).distinct()


def report(data_row: DataFrame) -> DataFrame:
    """`(split, source, overlapping, train_partners)` per evaluation split and source: rows that recur in training, and pairs. An id
    delivered under several sources counts for the smallest."""
    s = F.lower(F.trim("split"))
    named = data_row.select(F.col("id").alias("eval_row"), F.when(s.isin("valid", "dev", "val"), "validation").otherwise(s).alias("split"), "source")
    about = named.where("split IN ('validation', 'test')").groupBy("eval_row", "split").agg(F.min("source").alias("source"))
    per_row = overlaps(data_row).groupBy("eval_row").agg(F.count("*").alias("partners"))
    return per_row.join(about, "eval_row").groupBy("split", "source").agg(F.count("*").alias("overlapping"), F.sum("partners").alias("train_partners"))
