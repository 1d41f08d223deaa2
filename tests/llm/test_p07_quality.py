import numpy as np
import pytest

from lexmill.llm import p07_quality as p

PROSE = "Sabah Leyla xanım şəhər arxivinə getdi və köhnə sənədləri oxudu. Sonra o, müdirə zəng etdi və nəticəni ona danışdı."
TABLE = "12/34 | akt | Bakı | 120,50 | 01.02.2020\n13/35 | plan | Gəncə | 99,10 | 02.02.2020\n14/36 | rəy | Şuşa | 7,00 | 03.02.2020"
DOCS = "document_id string, text string, source string, extra string"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(f"p{i:02d}", PROSE + f" Bu {i} nömrəli yazıdır.", "a", None) for i in range(30)] + [(f"t{i:02d}", TABLE + f"\n{i}/9 | akt", " A", "x") for i in range(30)]
    rows += [("null", None, None, None), ("empty", "", "b", None), ("blank", " \n\t ", "b", None), ("long", PROSE * 3000, "b", None), ("mixed", TABLE * 3 + "\n" + PROSE, "b", None)]
    rows += [(f"m{i:02d}", f"{TABLE}\n{i}/1 | {PROSE[:40]}\n{TABLE}\n{PROSE[i:]}", "b", None) for i in range(12)]
    labels = [(r[0], r[0].startswith("p")) for r in rows[:20] + rows[30:50] + rows[-12:]] + [("p00", True), ("null", None), ("t25", True), ("t25", False), (None, True)]
    words = [("az", w) for w in ("və", "o", "bu", "sonra")] + [(None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "document_id string, is_prose boolean"), spark.createDataFrame(words, "lang string, word string")


def test_tables_are_told_from_prose(tables):
    assert {r["document_id"] for r in p.found(*tables).collect()} == {f"t{i:02d}" for i in range(30)} | {f"m{i:02d}" for i in range(12)} | {"mixed"}


def test_statistics(tables):
    docs, _, words = tables
    got = {r["document_id"]: r for r in p.statistics(docs, words).collect()}
    assert got["null"]["n_words"] == got["empty"]["n_words"] == 0 and got["null"]["mean_word_len"] is None
    assert got["p00"]["closed_lines"] == 1.0 and got["t00"]["closed_lines"] == 0.0
    assert got["t00"]["symbol_ratio"] > 3 * got["p00"]["symbol_ratio"] and got["p00"]["common_words"] > 0.1


def test_by_source(tables):
    got = {r["source"]: r for r in p.by_source(*tables).collect()}
    assert got["a"]["documents"] == 60 and got["a"]["prose_share"] == 0.5 and got[None]["documents"] == 1


def test_empty_tables(tables):
    assert p.found(*(t.limit(0) for t in tables)).count() == 0


def test_rules_find_a_conjunction_in_noise():
    rng = np.random.default_rng(1)
    x = {c: rng.random(4000) for c in "abc"}
    y = (x["a"] > 0.6) & (x["b"] < 0.3)
    rules = p.induce(x, y, np.ones(4000))
    hit = np.zeros(4000, bool)
    for r in rules:
        hit |= p._covers(x, r.conditions, 4000)
    assert (hit == y).mean() > 0.98
    assert p.case_expression([]) == "false" and p.case_expression(rules).startswith("CASE WHEN `")
