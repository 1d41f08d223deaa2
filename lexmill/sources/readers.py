"""Readers that check what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, plain or gzipped; blank lines are skipped, a line that is no JSON object stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As `read_jsonl`, but a blank line stops the job too."""
    parsed = F.from_json("value", schema if isinstance(schema, T.DataType) else T._parse_datatype_string(schema), {"mode": "FAILFAST"})
    checked = F.when(F.trim("value") == "", F.raise_error(F.lit("blank line"))).otherwise(parsed)
    return spark.read.text(path).select(checked.alias("row")).select("row.*")


def violations_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """`(value)` of the lines that hold no JSON object, blank ones included."""
    return spark.read.text(path).where(F.expr("try_parse_json(value) IS NULL OR schema_of_variant(try_parse_json(value)) NOT LIKE 'OBJECT%'"))


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """`(sentence, token, word, lemma, pos)` of CoNLL-U files: blocks between blank lines; comments, word ranges and empty nodes are left out."""
    blocks = spark.read.text(path, lineSep="\n\n").select(F.monotonically_increasing_id().alias("sentence"), F.explode(F.split("value", "\n")).alias("line"))
    cells = blocks.where(F.rlike("line", F.lit(r"^\d+\t"))).select("sentence", F.split("line", "\t").alias("c"))
    return cells.select("sentence", F.col("c")[0].cast("int").alias("token"), F.col("c")[1].alias("word"), F.col("c")[2].alias("lemma"), F.col("c")[3].alias("pos"))


def read_hunspell_dic(spark: SparkSession, path: str) -> DataFrame:
    """`(word, flags)` of a Hunspell dictionary with long (two-character) flags; the count in the first line is left out."""
    lines = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*\d*\s*$")))
    parts = F.split(F.regexp_replace("value", r"\s.*$", ""), "/", 2)
    flags = F.regexp_extract_all(F.coalesce(F.get(parts, 1), F.lit("")), F.lit(".."), 0)
    return lines.select(F.get(parts, 0).alias("word"), flags.alias("flags"))


def read_hunspell_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """`(flag, strip, affix, condition)` of the suffix rules of an affix file; headers and malformed lines are left out, `0` means nothing."""
    c = F.split(F.trim("value"), r"\s+")
    rules = spark.read.text(path).select(c.alias("c")).where("size(c) >= 5 AND c[0] = 'SFX' AND length(c[1]) = 2")
    none = lambda x: F.when(x == "0", "").otherwise(x)
    return rules.select(F.col("c")[1].alias("flag"), none(F.col("c")[2]).alias("strip"), none(F.split(F.col("c")[3], "/")[0]).alias("affix"), F.col("c")[4].alias("condition"))


def expand_suffixes(words: DataFrame, rules: DataFrame) -> DataFrame:
    """`(base, form)`: each word and what its flags' rules make of it, where the end fits the rule's condition."""
    forms = words.select("word", F.explode("flags").alias("flag")).join(rules, "flag")
    fits = F.expr("word RLIKE concat(condition, '$') AND endswith(word, strip)")
    made = forms.where(fits).select(F.col("word").alias("base"), F.expr("concat(substring(word, 1, length(word) - length(strip)), affix)").alias("form"))
    return words.select(F.col("word").alias("base"), F.col("word").alias("form")).union(made).distinct()


def nested_strings(rows: DataFrame, id: str, json: str, names: list[str]) -> DataFrame:
    """`(id, path, value)`: every string under one of `names`, at any depth of a JSON text; texts that are no JSON have none."""
    import json as _json

    wanted = set(names)

    @F.udf("array<struct<path: string, value: string>>", useArrow=True)
    def walk(text: str | None):
        try:
            todo = [("", _json.loads(text), False)] if text else []
        except ValueError:
            return []
        out = []
        while todo:
            path, node, take = todo.pop()
            if isinstance(node, dict):
                todo += [(f"{path}.{k}", v, k in wanted) for k, v in reversed(node.items())]
            elif isinstance(node, list):
                todo += [(f"{path}[{i}]", v, take) for i, v in reversed(list(enumerate(node)))]
            elif isinstance(node, str) and take:
                out.append((path.lstrip("."), node))
        return out

    return rows.select(id, F.inline(walk(F.col(json))))
