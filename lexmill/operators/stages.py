"""Text stages: named column functions chained over a text, with literals shielded, a trace and an idempotence check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import LITERAL


@dataclass(frozen=True)
class Stage:
    """A step from a text column to a text column; `category` groups steps in reports."""

    name: str
    category: str
    fn: Callable[[Column], Column]


def punctuation_spacing(text: Column) -> Column:
    """No space before a closing mark, one after it where a letter follows, no space inside brackets and guillemets."""
    out = F.regexp_replace(text, r" +([,.;:!?»)\]])", "$1")
    out = F.regexp_replace(out, r"([«(\[]) +", "$1")
    return F.regexp_replace(out, r"([,;!?])(\p{L})", "$1 $2")


def collapse_spaces(text: Column) -> Column:
    """Runs of spaces and tabs as one space, none at the ends of lines."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?m)^ | $", "")


def terminal_mark(text: Column) -> Column:
    """A full stop where a text ends in a letter or digit."""
    return F.when(F.rlike(text, F.lit(r"[\p{L}\p{N}]\z")), F.concat(text, F.lit("."))).otherwise(text)


def sentence_case(text: Column) -> Column:
    """A capital at the start of the text."""
    first = F.substring(text, 1, 1)
    up = F.upper(F.translate(first, "iı", "İI"))
    return F.concat(up, F.substring(text, 2, 1 << 30))


DEFAULT = (
    Stage("collapse_spaces", "layout", collapse_spaces),
    Stage("punctuation_spacing", "punctuation", punctuation_spacing),
    Stage("terminal_mark", "punctuation", terminal_mark),
    Stage("sentence_case", "case", sentence_case),
)


_MARK = "\ue000"  # a private-use sign: stands for a literal while the stages run


def run_stages(rows: DataFrame, id: str, text: str, stages: tuple[Stage, ...] = DEFAULT) -> DataFrame:
    """`(id, before, after, trace, stable)`: the chain's result, which stages changed the text, and whether a second run would change nothing.

    Code, URLs and addresses are shielded: a private-use sign stands for each while the stages run and is replaced in order afterwards; if a
    stage loses one, the text stays as it was. Null texts stay null.
    """
    bare = F.replace(F.col(text), F.lit(_MARK), F.lit(""))
    x = rows.select(id, F.col(text).alias("before"), F.regexp_extract_all(bare, F.lit(LITERAL), 0).alias("literals"), F.regexp_replace(bare, LITERAL, _MARK).alias("s0"))
    for i, s in enumerate(stages):
        x = x.withColumn(f"s{i + 1}", s.fn(F.col(f"s{i}")))
    last = f"s{len(stages)}"
    again = F.col(last)
    for s in stages:
        again = s.fn(again)
    parts = F.split(F.col(last), _MARK)
    back = F.array_join(F.flatten(F.transform(parts, lambda p, i: F.array(F.when(i > 0, F.get("literals", i - 1)).otherwise(""), p))), "")
    trace = F.filter(F.array(*(F.when(F.col(f"s{i + 1}") != F.col(f"s{i}"), s.name) for i, s in enumerate(stages))), lambda n: n.isNotNull())
    whole = F.size(parts) == F.size("literals") + 1
    return x.select(id, "before", F.when(whole, back).otherwise(F.col("before")).alias("after"), F.when(whole, trace).otherwise(F.array().cast("array<string>")).alias("trace"), (again == F.col(last)).alias("stable"))
