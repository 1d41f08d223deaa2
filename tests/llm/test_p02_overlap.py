import random

from lexmill.llm import p02_overlap as p

SCHEMA = "id string, source string, split string, input string, target string, words string"


def rows(spark, data):
    return spark.createDataFrame([(i, s, sp, a, b, "x") for i, s, sp, a, b in data], SCHEMA)


def test_four_words_against_five(spark):
    table = rows(spark, [("a", "s", "train", "alma armud heyva nar", None), ("b", "s", "test", "alma armud yaşıl heyva nar", None), ("c", "s", "test", "alma armud yaşıl heyva banan", None)])
    assert [tuple(r) for r in p.found(table).collect()] == [("a", "b")]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_against_all_pairs(spark):
    rnd, data = random.Random(8), []
    base = [[rnd.choice("abcdefgh") * 2 + str(rnd.randrange(6)) for _ in range(rnd.randrange(1, 30))] for _ in range(14)]
    for i in range(90):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 5)):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randrange(2)] = ["new%d" % rnd.randrange(9)] * rnd.randrange(2)
        data.append((f"r{i:02d}", "s", rnd.choice(["train", " TRAIN", "dev", "test", None, "other"]), " ".join(w).upper() if i % 3 else " ".join(w), None if i % 2 else "tək söz"[: i % 8]))
    data += data[:5]
    want = set()
    for x in data:
        for y in data:
            sx, sy = (("train" if "train" in (z[2] or "").lower() else "eval" if z[2] in ("dev", "test") else None) for z in (x, y))
            if (sx, sy) != ("train", "eval") or x[0] == y[0]:
                continue
            for u in (x[3], x[4]):
                for v in (y[3], y[4]):
                    # plain form, as the problem states it
                    a, b = ((t or "").lower().replace("ə", "e").replace("ö", "o").split() for t in (u, v))
                    if a and b and ("".join(a) == "".join(b) or plain_distance(a, b) * 5 <= max(len(a), len(b))):
                        want.add((min(x[0], y[0]), max(x[0], y[0])))
    assert {tuple(r) for r in p.found(rows(spark, data)).collect()} == want and len(want) > 20


def test_report_and_empty(spark):
    table = rows(spark, [("a", "s", "train", "bir iki üç", None), ("b", "t", "DEV ", "Bir, iki üç!", None), ("b", "u", "dev", "Bir, iki üç!", None), ("c", "t", "test", None, "")])
    assert [tuple(r) for r in p.report(table).collect()] == [("validation", "t", 1, 1)]
    assert p.found(table.limit(0)).count() == 0
