from lexmill.llm import p04_leak

CASE = "alma armud heyva nar gilas banan ananas kivi qovun qarpız ərik şaftalı"


def _near(spark, documents, case=CASE):
    corpus = spark.createDataFrame(list(documents.items()), "document_id string, text string")
    cases = spark.createDataFrame([("c", case, None)], "id string, input string, expected string")
    return {r["document_id"]: r["hits"] for r in p04_leak.near(corpus, cases).collect()}


def test_the_missing_word_may_be_unknown_to_the_corpus(spark):
    assert _near(spark, {"d": CASE.replace("gilas", "üzüm"), "e": "alma armud heyva"}) == {"d": 11}


def test_the_missing_word_may_be_the_rarest(spark):
    others = {f"o{i}": w for i, w in enumerate(w for w in CASE.split() if w != "gilas")}
    assert _near(spark, {"d": CASE.replace("gilas", "üzüm"), "x": "gilas"} | others) == {"d": 11}


def test_two_missing_words_are_too_many(spark):
    assert _near(spark, {"d": CASE.replace("gilas", "üzüm").replace("alma", "limon"), "w": CASE}) == {"w": 12}


def test_words_stand_within_two_of_one_place_whichever_is_the_rarest(spark):
    w = CASE.split()
    apart = " ".join([*w[:4], "x", "y", *w[4:8], "x", "y", *w[8:]])  # shifts 0, 2 and 4
    far = " ".join([*w[:4], "x", "y", *w[4:8], "x", "y", "z", *w[8:]])
    for common in (w[0], w[-1], w[5]):
        others = {f"o{i}": x for i, x in enumerate(x for x in w if x != common)}
        assert _near(spark, {"a": apart, "f": far} | others) == {"a": 12}
