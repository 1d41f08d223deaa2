from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from lexmill.llm import p01_visual as p
from lexmill.llm import visual as v

ALPHABET = "abcçeəışy АВеоңӘӧҪүαΩ̧̈́​ ­Ａ１ﬁⒶ₂\u0007é№²。ab\n"


@settings(deadline=None, max_examples=500)
@given(st.text(ALPHABET, max_size=12))
def test_ordinary_is_idempotent(text):
    once = v.ordinary(text)
    assert v.ordinary(once) == once


@pytest.mark.parametrize("odd, plain", [
    ("ѕ̧irkət", "şirkət"), ("сöz", "cöz"), ("kӧk", "kök"), ("Ҫay", "Çay"), ("Ⓐdam", "Adam"), ("x₂", "x2"), ("a\u0007b", "ab"), ("ᴀdam", "adam"),
    ("ｍətn", "mətn"), ("me​tn", "metn"), ("a b", "a b"), ("օlan", "olan"),
])
def test_odd_characters(odd, plain):
    assert v.ordinary(odd) == plain


@pytest.mark.parametrize("text", ["№ 5 «a» – b… ² ³", "Бакы үч", "می‌خواهم", "你好，世界", "Şəhər, İl\tIşıq\r\n", "", "x½"])
def test_ordinary_text_stays(text):
    assert v.ordinary(text) == text


def test_tokens_of_wide_compatibility_letters_stay_aligned():
    assert v.changes("ﷺ kӧk")[-1] == ("kӧk", "kök")


def test_a_value_is_found_whatever_other_rows_there_are(spark):
    odd = ["ѕ̧irk", "şirk", "şirk", "ѕirk", "áb", None, "", "söz"]
    rows = spark.createDataFrame([(str(i), x, None, "t") for i, x in enumerate(odd)] + [("4", odd[4], None, "t")], "id string, input string, target string, surface string")
    docs = spark.createDataFrame([("d", "Сoz " * 4000, "m")], "document_id string, text string, mapped string")
    got = {r["record_id"] for r in p.found(rows, docs).collect()}
    alone = {r["record_id"] for i in range(5) for r in p.found(rows.where(f"id = '{i}'"), docs.limit(0)).collect()}
    assert got == {"0", "1", "3", "4", "d"} and alone == got - {"d"}
    assert p.found(rows.limit(0), docs.limit(0)).count() == 0
