"""Edit distances and alignments; Arrow UDFs where Spark has no function."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of an alignment table beyond which a pair is not aligned but reported (null).
MOST_CELLS = 4_000_000


def levenshtein_at_most(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance in code points, `most + 1` where it is more. JVM-side."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def osa(a: str, b: str, most: int) -> int:
    """Restricted Damerau distance (adjacent swaps, no edits between them), `most + 1` where it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        new = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            cost = a[i - 1] != b[j - 1]
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + cost)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                new[j] = min(new[j], before[j - 2] + 1)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def osa_bounded(a: Column, b: Column, most: int = 2) -> Column:
    """OSA distance as a column; null where either side is."""

    @F.pandas_udf(T.IntegerType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else osa(p, q, most) for p, q in zip(x, y)], dtype="Int32")

    return run(a, b)


def edit_script(source, target) -> list[tuple[int, int, list]] | None:
    """The edits `(start, end, replacement)` of one shortest alignment, read from the end: equal, then replace, delete,
    insert. Neighbouring deletions and insertions are one edit, each replacement is its own. None beyond MOST_CELLS."""
    n, m = len(source), len(target)
    if (n + 1) * (m + 1) > MOST_CELLS:
        return None
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        row = [i]
        for j in range(1, m + 1):
            row.append(min(cost[i - 1][j - 1] + (source[i - 1] != target[j - 1]), cost[i - 1][j] + 1, row[j - 1] + 1))
        cost.append(row)
    steps, i, j = [], n, m
    while i or j:
        if i and j and source[i - 1] == target[j - 1] and cost[i][j] == cost[i - 1][j - 1]:
            i, j = i - 1, j - 1
            steps.append(("=", i, i + 1, []))
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            steps.append(("r", i, i + 1, [target[j]]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            steps.append(("g", i, i + 1, []))
        else:
            j -= 1
            steps.append(("g", i, i, [target[j]]))
    out, last = [], "="
    for kind, lo, hi, new in reversed(steps):
        if kind == "g" and last == "g":
            a, _, words = out[-1]
            out[-1] = (a, hi, words + new)
        elif kind != "=":
            out.append((lo, hi, new))
        last = kind
    return out


_EDIT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("replacement", T.StringType())]))


@F.udf(_EDIT, useArrow=True)
def word_edits(source: str | None, target: str | None):
    """Edits between the white-space tokens of two texts; null beyond MOST_CELLS or for a null."""
    if source is None or target is None:
        return None
    script = edit_script(source.split(), target.split())
    return None if script is None else [(a, b, " ".join(w)) for a, b, w in script]


_OPCODE = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType())]))


@F.udf(_OPCODE, useArrow=True)
def seq_opcodes(source: str | None, target: str | None):
    """Aligned word pairs by matching blocks: equal words and replacements of as many words; other blocks align nothing."""
    if source is None or target is None:
        return None
    a, b, out = source.split(), target.split(), []
    for op, a0, a1, b0, b1 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal" or op == "replace" and a1 - a0 == b1 - b0:
            out += [(op, a0 + k, b0 + k, a[a0 + k], b[b0 + k]) for k in range(a1 - a0)]
    return out


_QUALITY = T.StructType([T.StructField(c, T.LongType()) for c in ("char_errors", "word_errors", "words", "tp", "fp", "fn")])


@F.udf(_QUALITY, useArrow=True)
def quality_counts(source: str | None, target: str | None, actual: str | None):
    """Counts of one row: word errors of the result, edit spans it shares with the reference (tp), has alone (fp), lacks (fn)."""
    if source is None or target is None or actual is None:
        return None
    s, g, p = source.split(), target.split(), actual.split()
    gold, got, rest = edit_script(s, g), edit_script(s, p), edit_script(p, g)
    if gold is None or got is None or rest is None:
        return None
    x, y = ({(a, b, tuple(w)) for a, b, w in e} for e in (gold, got))
    errors = sum(max(b - a, len(w)) for a, b, w in rest)
    return 0, errors, len(g), len(x & y), len(y - x), len(x - y)
