"""Keys that may lie in several splits, found by 64-bit hashes before any key is written in full."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut

#: Bits of the filter for each hash in it, the most bits it has (2**30 are 128 MB; beyond, it lets more through), bits of one of its pieces.
PER_HASH, MOST, PIECE = 32, 30, 19

_BASE, _STEP, _WHOLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE, dtype=np.uint64))


def spans(texts: pa.Array, n: int = 8) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of words between single spaces: their bytes and, of each whole text (kind 0) and n-gram (kind 1), kind, number of the text,
    first byte, end and hash. Equal keys have equal hashes; a null text has no key."""
    idx = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
    given = texts.cast(pa.large_binary()).take(pa.array(idx, pa.int64()))
    size = pc.binary_length(given).to_numpy(zero_copy_only=False).astype(np.int64)
    data = b"".join(given.to_pylist())
    d, edge = np.frombuffer(data, dtype=np.uint8), np.r_[0, np.cumsum(size)].astype(np.int64)
    whole = np.zeros(len(idx), dtype=np.uint64)
    of = lo = hi = np.zeros(0, dtype=np.int64)
    gram = np.zeros(0, dtype=np.uint64)
    if len(d):
        gap = d == 32
        start = np.sort(np.r_[edge[:-1][size > 0], np.flatnonzero(gap) + 1])
        end = np.sort(np.r_[edge[1:][size > 0], np.flatnonzero(gap)])
        text = np.searchsorted(edge, start, side="right") - 1
        place = np.arange(len(d)) - np.repeat(start, np.diff(np.r_[start, len(d)]))
        word = _mix(np.add.reduceat(np.where(gap, 0, d).astype(np.uint64) * _powers(place.max() + 1)[place], start))
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        place = np.arange(len(word)) - np.repeat(first, np.diff(np.r_[first, len(word)]))
        whole[text[first]] = np.add.reduceat(word * _powers(place.max() + 1)[place], first)
        many = len(word) - n + 1
        if many > 0:
            gram = np.zeros(many, dtype=np.uint64)
            for j in range(n):
                gram = gram * _STEP + word[j : j + many]
            inside = text[:many] == text[n - 1 :]
            gram, of, lo, hi = gram[inside], text[:many][inside], start[:many][inside], end[n - 1 :][inside]
    kind = np.r_[np.zeros(len(idx), dtype=np.int32), np.ones(len(gram), dtype=np.int32)]
    return data, kind, np.r_[idx, idx[of]], np.r_[edge[:-1], lo], np.r_[edge[1:], hi], np.r_[_mix(whole + _WHOLE), _mix(gram)]


def _slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some `most` bytes of text."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("clean", "noisy"))
        part = np.cumsum(size) // most
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for lo, hi in zip(at, [*at[1:], len(part)]):
            yield batch.slice(lo, hi - lo)


def _hashes(rows: DataFrame, n: int) -> DataFrame:
    """`(h)` of the hashes that occur in more than one split."""
    number = {r["split"]: i for i, r in enumerate(rows.select("split").distinct().collect())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            split = np.array([number[s] for s in batch.column("split").to_pylist()], dtype=np.int32)
            h, s = [], []
            for side in ("clean", "noisy"):
                _, _, text, _, _, hashes = spans(batch.column(side), n)
                h.append(hashes.view(np.int64))
                s.append(split[text])
            h, s = np.concatenate(h), np.concatenate(s)
            order = np.lexsort((s, h))
            h, s = h[order], s[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            yield pa.record_batch({"h": pa.array(h[new]), "s": pa.array(s[new])})

    seen = rows.select("split", "clean", "noisy").mapInArrow(run, "h long, s int")
    return seen.groupBy("h").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo != hi").select("h")


def _filter(hashes: DataFrame) -> tuple[int, np.ndarray]:
    """Bits by the first digits of the hashes, one piece of them a task, and how many digits: the driver gets the filter only, however many hashes there are."""
    digits = min(MOST, max(PIECE, (PER_HASH * hashes.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = np.unique(batch.column("bit").to_numpy())
            for piece in np.unique(bit >> PIECE):
                own = bit[bit >> PIECE == piece] & ((1 << PIECE) - 1)
                np.bitwise_or.at(pieces.setdefault(int(piece), np.zeros(1 << PIECE - 3, dtype=np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        for piece, bits in pieces.items():
            yield pa.record_batch({"piece": pa.array([piece], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    bits = hashes.select(F.shiftrightunsigned("h", 64 - digits).alias("bit"))
    out = np.zeros(1 << digits - 3, dtype=np.uint8)
    for r in bits.repartition(F.shiftright("bit", PIECE)).mapInArrow(run, "piece int, bits binary").collect():
        out[r["piece"] << PIECE - 3 :][: 1 << PIECE - 3] = np.frombuffer(r["bits"], dtype=np.uint8)
    return digits, out


def keyed(rows: DataFrame, n: int = 8) -> DataFrame:
    """`(key_type, key, side, split, row)` for `rows (row, split, clean, noisy)` whose texts are words between single spaces: the SHA-256 (binary) of
    each whole text (0) and n-gram (1). All rows of a key that lies in several splits are there; of the other keys, most are left out.

    The texts are read twice: for the hashes, of which those in several splits make a filter, and for the keys that pass it. Equal hashes of
    different keys let a key through, never one be lost.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_filter(cut(_hashes(rows, n), "hashes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits, bits = shared.value
        for batch in _slices(batches):
            for side in ("clean", "noisy"):
                data, kind, text, lo, hi, h = spans(batch.column(side), n)
                bit = (h >> np.uint64(64 - digits)).astype(np.int64)
                on = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                keys = pa.array([sha256(data[a:b]).digest() for a, b in zip(lo[on].tolist(), hi[on].tolist())], pa.binary())
                take = pa.array(text[on], pa.int64())
                yield pa.record_batch([
                    pa.array(kind[on]), keys, pa.array([side] * len(on), pa.string()), batch.column("split").take(take), batch.column("row").take(take),
                ], names=["key_type", "key", "side", "split", "row"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"key_type int, key binary, side string, split string, row {kind}")
