"""Seeded synthetic errors: one edit of one word per text, drawn from a hash, protected words left alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as t

# Letters and, at the same place, what they are mistaken for.
PLAIN_OF = ("əıçğöşü", "eicgosu")
QX = ("qkxh", "kqhx")
KEYS = ("qüertyuiopasdfghjklzxcvbnm", "üqrtyuiopoasdfghjklzxcvbnb")
ELIGIBLE = r"^[a-zəıçğöşü]{5,32}\z"

KINDS = ("identity", "diacritics_all", "diacritics_partial", "qk_xh", "deletion", "insertion", "transpose", "keyboard", "digraph", "space_split", "hyphen", "punctuation", "case", "space_join")


def _edited(word: Column, kind: str, u: Column) -> Column:
    """`word` with one edit of a kind at a place drawn by `u` in [0, 1)."""
    n = F.length(word)
    p = (F.floor(u * (n - 1)) + 1).cast("int")  # 1 .. n - 1
    left, here, after, rest = F.substring(word, F.lit(1), p - 1), F.substring(word, p, F.lit(1)), F.substring(word, p + 1, F.lit(1)), F.substring(word, p + 2, n)
    tail = F.substring(word, p + 1, n)
    half = (F.floor(u * (n - 3)) + 2).cast("int")  # 2 .. n - 2
    match kind:
        case "diacritics_all":
            return F.translate(word, *PLAIN_OF)
        case "diacritics_partial":
            return F.concat(left, F.translate(here, *PLAIN_OF), tail)
        case "qk_xh":
            return F.concat(left, F.translate(here, *QX), tail)
        case "keyboard":
            return F.concat(left, F.translate(here, *KEYS), tail)
        case "deletion":
            return F.concat(left, tail)
        case "insertion":
            return F.concat(left, here, here, tail)
        case "transpose":
            return F.concat(left, after, here, rest)
        case "digraph":
            return F.replace(F.replace(F.replace(word, F.lit("ş"), F.lit("sh")), F.lit("ç"), F.lit("ch")), F.lit("ğ"), F.lit("gh"))
        case "space_split":
            return F.concat(F.substring(word, F.lit(1), half), F.lit(" "), F.substring(word, half + 1, n))
        case "hyphen":
            return F.concat(F.substring(word, F.lit(1), half), F.lit("-"), F.substring(word, half + 1, n))
    raise ValueError(kind)


def noised(rows: DataFrame, id: str, text: str, kind: str, seed: str = "42") -> DataFrame:
    """`(id, noisy, category)`: the text with one error of a kind; where it allows none, the text as it is, with category `identity`.

    Only plain lower-case words of five letters or more are altered: names, numbers, addresses and words in capitals are not.
    Draws depend on the seed, the id and the kind alone. Null texts stay null.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    base = rows.select(id, F.col(text).alias("t"))
    draw = [t.unit_hash(F.lit(seed), F.col(id).cast("string"), F.lit(kind), F.lit(x)) for x in ("word", "place")]
    if kind == "identity":
        out = base.withColumn("noisy", F.col("t"))
    elif kind == "punctuation":
        out = base.withColumn("noisy", F.regexp_replace("t", r"[.!?,;:]+\z", ""))
    elif kind == "case":
        out = base.withColumn("noisy", F.concat(t.az_lower(F.substring("t", 1, 1)), F.substring("t", 2, 1 << 30)))
    else:
        w = base.withColumn("w", F.split("t", " "))
        at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.rlike(F.get("w", i), F.lit(ELIGIBLE)))
        w = w.withColumn("at", at).withColumn("i", F.get("at", F.floor(draw[0] * F.size("at")).cast("int")))
        if kind == "space_join":  # the drawn word and the next one
            joined = F.concat(F.slice("w", F.lit(1), F.col("i")), F.array(F.concat(F.get("w", F.col("i")), F.get("w", F.col("i") + 1))), F.expr("slice(w, i + 3, size(w))"))
            out = w.withColumn("noisy", F.when((F.size("at") > 0) & (F.col("i") < F.size("w") - 1), F.array_join(joined, " ")).otherwise(F.col("t")))
        else:
            new = F.transform("w", lambda x, i: F.when(i == F.col("i"), _edited(x, kind, draw[1])).otherwise(x))
            out = w.withColumn("noisy", F.when(F.size("at") > 0, F.array_join(new, " ")).otherwise(F.col("t")))
    return out.select(id, "noisy", F.when(F.col("noisy") == F.col("t"), "identity").when(F.col("t").isNotNull(), kind).alias("category"))
