import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import distance as d, features, text as t
from lexmill.operators import curation as c

ODD = ["İSTANBUL Işıq", "", None, "  a  b c ", "é", "100 min", "söz " * 5000, "ÇIXIŞ", "q"]


def one(spark, texts, column):
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(texts)], "i int, x string, value string")
    return [r[0] for r in df.orderBy("i").select(column.alias("o")).collect()]


def test_normal_forms(spark):
    assert one(spark, ODD, t.az_lower(F.col("x")))[:3] == ["istanbul ışıq", "", None]
    assert one(spark, ODD, t.normalize_ws(F.col("x")))[3:5] == ["a b c", "é"]
    assert one(spark, ["Şəhər q"], t.fold_qx(F.col("x"))) == ["seher k"]
    assert one(spark, ["Shəkil 12"], t.norm_number_class(F.col("x"))) == ["shekil <n>"]
    assert one(spark, ["12 a", ""], t.norm_alnum(F.col("x"))) == ["12 a", ""]


def test_words_equal_python(spark):
    expected = [None if x is None else re.findall(r"[^\W\d_]+", unicodedata.normalize("NFC", x).translate(str.maketrans("Iİ", "ıi")).lower()) for x in ODD]
    assert one(spark, ODD, t.words(t.nfc(F.col("x")))) == expected


def test_ngrams_of_short_texts(spark):
    w = t.words(F.col("x"))
    assert one(spark, ["a b", "a b a b", "", None], t.word_ngrams(w, 3)) == [[], ["a b a", "b a b"], [], None]
    assert one(spark, ["a", "", "a b"], t.token_bigrams(w)) == [["a"], [], ["a b"]]


def test_classes(spark):
    assert one(spark, ["evimlərdən", "dan", "ev", None], t.suffix_class(F.col("x"))) == ["<suffix:lərdən>", "<unk>", "<unk>", None]
    assert one(spark, ["ev", "Ev", "EV", "eV", "İl", "I"], t.case_label(F.col("x"))) == [0, 1, 2, 3, 1, 2]
    assert one(spark, ["ab", "a", ""], t.deletions(F.col("x"))) == [["ab", "b", "a"], ["a", ""], [""]]


def test_literals_and_spans(spark):
    assert one(spark, ["bax https://a.example/x. və `kod` a@b.example!"], t.literal_spans(F.col("x"))) == [["https://a.example/x", "`kod`", "a@b.example"]]
    spans = one(spark, ["Bu gün ABB ilə 12 nəfər Bakı-ya getdi. Sonra"], t.protected_spans("x", F.array(F.lit("nəfər"))))[0]
    text = "Bu gün ABB ilə 12 nəfər Bakı-ya getdi. Sonra"
    assert [text[a:b] for a, b in spans] == ["ABB", "12", "nəfər", "Bakı"]


def test_html(spark):
    assert one(spark, ["<p>a &amp; b</p><script>x</script>", "1 < 2"], t.html_visible_text(F.col("x"))) == ["a & b", "1 < 2"]


def test_segment_news_equals_python(spark):
    texts = ["A. Məmmədov gəldi. «Sonra» getdi! (Bax) nə?\n\nYeni bölmə.", "Qiymət 3.5 manat. bu kiçik", "", None, "X."]
    split = re.compile(rf"(?<=[.!?])\s+(?=[“«\"(]*[{c.CAPITAL}])|\n\s*\n")
    expected = []
    for i, x in enumerate(texts):
        if x is not None:
            shield = re.sub(rf"\b([{c.CAPITAL}])\.(?=\s*[{c.CAPITAL}])", lambda m: m[1] + "", x)
            parts = [" ".join(p.replace("", ".").split()) for p in split.split(shield)]
            expected += [(str(i), k, p) for k, p in enumerate(p for p in parts if p)]
    df = spark.createDataFrame([(str(i), x, "e") for i, x in enumerate(texts)], "document_id string, text string, segment string")
    assert sorted(map(tuple, c.segment_news(df).collect())) == sorted(expected)


@settings(deadline=None, max_examples=200)
@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
def test_osa_against_plain_recursion(a, b):
    from functools import lru_cache

    @lru_cache(None)
    def f(i, j):
        if not i or not j:
            return i + j
        best = min(f(i - 1, j) + 1, f(i, j - 1) + 1, f(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, f(i - 2, j - 2) + 1)
        return best

    assert d.osa(a, b, 2) == min(f(len(a), len(b)), 3)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from("xyz"), max_size=7), st.lists(st.sampled_from("xyz"), max_size=7))
def test_edit_script_rebuilds_the_target(a, b):
    out, at = [], 0
    for lo, hi, new in d.edit_script(a, b):
        out += a[at:lo] + new
        at = hi
    assert out + a[at:] == b


def test_vectors_have_length_one(spark):
    v = one(spark, ["ev", None], features.char_vector("x"))
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-9 and v[1] is None
    assert features.fnv1a("") == 0x811C9DC5
