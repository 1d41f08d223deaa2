import pytest

from lexmill.llm import p05_sentences as p


@pytest.mark.parametrize("line, parts", [
    ("asked for a reply.It cost", ["reply.", "It"]),
    ("Bu ev.Sonra gəldi", ["ev.", "Sonra"]),
    ("il 2023.Sonra gəldi", ["2023.", "Sonra"]),
    ("(bax şəkil).Sonra gəldi", ["şəkil).", "Sonra"]),
    ("यह घर है।वह आया", ["है।", "वह"]),
    ("او رفت.من ماندم", ["رفت.", "من"]),
    ("او رفت؟من ماندم", ["رفت؟", "من"]),
])
def test_a_mark_inside_a_token_may_end_a_sentence(line, parts):
    words = [line[a:b] for a, b in p._tokens(line)]
    assert " ".join(parts) in " ".join(words)
    _, possible, _ = p._read(line, p._tokens(line), set())
    assert possible[words.index(parts[0])]


def test_marks_that_end_their_sentence_cut_without_a_space():
    text = "यह घर है।वह आया"
    assert [text[a:b] for a, b in p.units(text, p.Model(set(), {}))] == ["यह घर है।", "वह आया"]


@pytest.mark.parametrize("text", ["Qiymət 3.50 manat", "Tarix 12.03.2023 idi", "bax www.site.example/Ana.Page sonra", "A.B.Quliyev gəldi", "yəni z.B.Berlin"])
def test_decimals_dates_addresses_and_initials_stay_whole(text):
    assert [text[a:b] for a, b in p.units(text, p.Model(set(), {}))] == [text]
