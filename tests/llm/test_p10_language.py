import random
import re
import time

import pytest

from lexmill.llm import p10_language as p

AZ = ["Maliyyə şöbəsi hesabatı vaxtında göndərdi.", "Həmin sənəd arxivdə saxlanılır və heç kim onu oxumayıb.", "Müdir bildirdi ki, iclas sabah keçiriləcək."]
TR = ["Mali işler birimi raporu zamanında gönderdi.", "Bu belge arşivde saklanıyor ve kimse onu okumadı.", "Müdür toplantının yarın yapılacağını söyledi."]
EN = ["The finance office sent the report on time.", "This paper is kept in the archive and nobody read it.", "The head said that the meeting will be tomorrow."]
RU = ["Финансовый отдел вовремя отправил отчёт.", "Этот документ хранится в архиве и его никто не читал.", "Директор сказал, что собрание будет завтра."]
CY = ["Малијјә шөбәси һесабаты вахтында ҝөндәрди.", "Һәмин сәнәд архивдә сахланылыр вә һеч ким ону охумајыб.", "Мүдир билдирди ки, иҹлас сабаһ кечириләҹәк."]
ZH = "财务部门昨天把合同送回了档案室。项目负责人很快就改好了。"
TH = "ฝ่ายการเงินได้ส่งสัญญา หัวหน้าโครงการได้ลงนามแล้ว"
SCHEMA = "doc_id long, text string, lang string, source string, institution string, seg_no string"


@pytest.fixture(scope="module")
def rows(spark):
    docs, i = [], 0
    for lang, texts in (("az", AZ), ("tr", TR), ("en", EN), ("ru", RU), ("az", CY)):
        for k in range(12):
            docs.append((i, " ".join(texts[k % 3 :] + texts[: k % 3]), lang if k != 5 else "ru" if lang != "ru" else "en", "xeber-ofis", "inst-1", "x"))
            i += 1
    docs += [
        (100, " ".join(AZ) + "\n" + " ".join(EN) + " " + ZH, "AZ", None, None, None),
        (101, TH + " " + " ".join(TR), "tha", "x", "y", None),
        (102, "", None, None, None, None), (103, None, "az", None, None, None), (104, " 12/34 | 56 ", "und", None, None, None),
        (105, " ".join(RU * 400), "rus", "x", "inst-1", None), (106, AZ[0], "az-AZ", None, None, None), (107, EN[0], "xx", None, None, None), (108, EN[2], " UNKNOWN ", None, None, None),
    ]
    words = spark.createDataFrame([("en", "the"), ("az", "və"), ("tr", "ve"), ("xx", "q"), (None, None)], "lang string, word string")
    table = spark.createDataFrame(docs, SCHEMA)
    return p.found(table, words).collect(), {r["doc_id"]: r for r in p.stretches(table, words).collect()}, table, words


def test_wrong_labels_and_mixed_documents(rows):
    got = {}
    for r in sorted(rows[0], key=lambda r: (r["doc_id"], r["seg_no"])):
        got.setdefault(r["doc_id"], []).append(r["lang"])
    assert got == {5: ["az"], 17: ["tr"], 29: ["en"], 41: ["ru"], 53: ["az"], 100: ["az", "en", "zh"], 101: ["th", "tr"], 107: ["en"], 108: ["en"]}


def test_texts_without_letters_have_no_stretch_and_long_ones_one(rows):
    _, by_id, *_ = rows
    assert not {102, 103, 104} & set(by_id) and by_id[105]["lang"] == "ru" and by_id[105]["confidence"] > 0.9


def test_empty_table(rows):
    assert p.found(rows[2].limit(0), rows[3]).count() == 0


def test_codes(spark):
    df = spark.createDataFrame([("AZ",), ("az-AZ",), ("aze",), (" tr_TR",), ("und",), ("",), (None,), ("xx",)], "lang string")
    assert [r[0] for r in df.select(p.declared(p.F.col("lang"))).collect()] == ["az", "az", "az", "tr", None, None, None, "xx"]


def test_sentences_keep_abbreviation_marks_inside():
    text = "Qiymət 3.50 manat. 今天很好。明天见"
    assert [text[a:b] for a, b in p.sentences(text)] == ["Qiymət 3.50 manat.", "今天很好。", "明天见"]


_PLAIN = re.compile("[\r\n\v\f\x85\u2028\u2029]+|[.!?…]+[»”\"’)\\]」』]*(?=\\s|$)|[。！？।؟۔]+[»”\"’)\\]」』]*|(?<=[\u0e00-\u0e7f]) +")


def _plain_ends(text):
    return [m.end() for m in _PLAIN.finditer(text)]


def test_ends_are_those_of_the_plain_pattern():
    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choices("ab1 .!?…。！？।؟۔»”\"’)]」』\r\n\v\f\x85\u2028\u2029  \tกข.", k=draw.randrange(14)))
        out, at = [], 0
        for hi in [*_plain_ends(text), len(text)]:
            if any(c.isalpha() for c in text[at:hi]):
                out.append((at + len(text[at:hi]) - len(text[at:hi].lstrip()), at + len(text[at:hi].rstrip())))
            at = hi
        assert p.sentences(text) == out, repr(text)


def test_ends_are_searched_for_by_their_first_character():
    text = " ".join(AZ[1][:-1] for _ in range(3_000)) + "."

    def least(f):
        times = []
        for _ in range(5):
            start = time.process_time()
            f(text)
            times.append(time.process_time() - start)
        return min(times)

    assert least(p.sentences) < 0.6 * least(_plain_ends)
