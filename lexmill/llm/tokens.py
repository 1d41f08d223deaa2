"""Sizes of texts in tokens of a public tokenizer; the vocabulary's folder is a parameter and nothing of it is copied."""

from __future__ import annotations

import base64
import importlib.util
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"



@lru_cache(4)
def _pattern(folder: str) -> str:
    spec = importlib.util.spec_from_file_location("_public_tokenizers", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


@lru_cache(4)
def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The encoder of a `.tiktoken` file, once per process."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in (Path(folder) / vocabulary).read_bytes().splitlines() if line)}
    return tiktoken.Encoding(vocabulary, pat_str=_pattern(folder), mergeable_ranks=ranks, special_tokens={})


def count(text: str, enc) -> int:
    """Tokens of a whole text."""
    try:
        return len(enc.encode_ordinary(text))
    except UnicodeEncodeError:  # lone surrogates
        return len(enc.encode_ordinary(text.encode("utf-8", "replace").decode()))


def token_count(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each text as a LONG; a null text has none."""

    @F.arrow_udf(T.LongType())
    def counted(v: pa.Array) -> pa.Array:
        enc = encoding(folder, vocabulary)
        return pa.array([count(t, enc) if t else 0 for t in v.to_pylist()], pa.int64())

    return counted(text)
