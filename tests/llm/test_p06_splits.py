import random

from lexmill.llm import p06_splits as p

ROW = "id string, document_id string, ingested_at timestamp, extra string"
PAIR = "id string, group_id string, document_id string, ingested_at timestamp, root string"
SHARES = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def brute(pairs):
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for _, g, d, _, _ in pairs:
        key = (g or "").strip().lower()
        if d is not None and key not in p.PLACEHOLDERS:
            a, b = sorted((find("d:" + d), find("g:" + key)))
            lead[b] = a
    return sorted((find(x)[2:], x[2:]) for x in list(lead) if x[0] == "d" and find(x) != x)


def tables(spark, rows, pairs):
    return spark.createDataFrame(rows, ROW), spark.createDataFrame(pairs, PAIR), spark.createDataFrame(SHARES, "split string, share double")


def stamp(spark, day):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(days=day)


def test_against_union_find(spark):
    rnd = random.Random(5)
    pairs = [(f"p{i}", rnd.choice(["hot", f" G{rnd.randrange(60)} ", "n/a", None, "-"]), rnd.choice([None, f"doc{rnd.randrange(90)}"]), stamp(spark, rnd.randrange(60)), "x") for i in range(200)]
    pairs += pairs[:10]
    rows = [(f"r{i}", f"doc{rnd.randrange(200)}" if i % 9 else None, stamp(spark, i % 60), None) for i in range(300)]
    t = tables(spark, rows, pairs)
    assert sorted(map(tuple, p.found(*t).collect())) == brute(pairs)
    out = p.assigned(*t).collect()
    assert len(out) == 500
    by_id = {(r["space"], r["id"]): r["split"] for r in out}
    lead = {d: a for a, d in brute(pairs)}
    seen = {}
    for space, recs in (("data_row", [(r[0], r[1]) for r in rows]), ("correction_pair", [(r[0], r[2]) for r in pairs])):
        for id_, d in recs:
            if d is not None and by_id[(space, id_)] is not None:
                assert seen.setdefault(lead.get(d, d), by_id[(space, id_)]) == by_id[(space, id_)]


def test_known_components_keep_their_split_and_conflicts_are_held(spark):
    want = dict(SHARES)
    cols = "space string, id string, document_id string, group_key string"
    one = spark.createDataFrame([("s", f"r{i}", f"d{i // 2}", None) for i in range(100)], cols)
    first = p.cut(p.take_in(None, one, want), "t")
    old = {r["node"]: r["split"] for r in first.collect()}
    assert set(old.values()) == set(want)
    a = next(n for n, s in sorted(old.items()) if s == "train")
    b = next(n for n, s in sorted(old.items()) if s == "test")
    two = spark.createDataFrame([("c", "p1", a[2:], "g"), ("c", "p2", b[2:], "g"), ("c", "p3", "new", None)], cols)
    new = {r["node"]: r for r in p.take_in(first, two, want).collect()}
    assert new[a]["root"] == new[b]["root"] == min(a, b)
    assert sorted([new[a]["held"], new[b]["held"]]) == [False, True]
    assert all(new[n]["split"] == s for n, s in old.items() if n not in (a, b))
    assert new["d:new"]["split"] in want


def test_long_chain_and_empty(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)] + [("x", "x"), (None, "y")]
    got = p.contract(spark.createDataFrame(chain, "a string, b string")).collect()
    assert len(got) == 71 and {r["root"] for r in got} == {"n000"}
    assert p.contract(spark.createDataFrame([], "a string, b string")).count() == 0
    assert p.found(*tables(spark, [], [])).count() == 0


def test_shares_are_near_on_many_small_components(spark):
    one = spark.range(3000).selectExpr("'s' space", "cast(id as string) id", "concat('d', id div 2) document_id", "cast(null as string) group_key")
    n = {r["split"]: r["n"] for r in p.take_in(None, one, dict(SHARES)).groupBy("split").agg(p.F.sum("n").alias("n")).collect()}
    assert abs(n["train"] - 2400) < 20 and abs(n["test"] - 300) < 20
