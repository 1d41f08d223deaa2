from collections import Counter, defaultdict

import pytest

from lexmill.llm import p09_mixing as p

WEIGHTS = {"a": (0.5, 2), "b": (0.3, 10), "c": (0.2, None), "gone": (0.1, 4)}


def test_rates_reach_the_shares_and_keep_the_caps():
    sums = {"a": 1000, "b": 50, "c": 10, "z": 99}
    r = p.rates(sums, WEIGHTS)
    used = {s: r[s] * sums[s] for s in r}
    whole = sum(used.values())
    assert {s: round(v / whole, 9) for s, v in used.items()} == {"a": 0.5, "b": 0.3, "c": 0.2}
    assert r["b"] == 10.0 and r["a"] <= 2


def test_rates_for_a_size_spread_what_capped_sources_lack():
    sums = {"a": 100, "b": 100, "c": 100}
    r = p.rates(sums, {"a": (0.5, 1), "b": (0.25, 3), "c": (0.25, None)}, size=600)
    assert r["a"] == 1.0 and r["b"] == pytest.approx(2.5) and r["c"] == pytest.approx(2.5)
    assert p.rates(sums, {"a": (1.0, 2)}, size=900) == {"a": 2.0}
    assert p.rates({}, WEIGHTS) == {} and p.rates({"a": 5}, {}) == {}


def test_mix_counts_and_reached_shares(spark):
    rows = [(i, "ABC"[i % 3] + " " if i % 2 else "abc"[i % 3], 10 + i % 5) for i in range(6000)] + [(9001, None, 50), (9002, "other", 50)]
    items = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("source", p.source_key(p.F.col("source")))
    weights = {"a": (0.5, 2), "b": (0.3, 10), "c": (0.2, None)}
    out = p.mix(items, weights).collect()
    copies = Counter(r["doc_id"] for r in out)
    by = defaultdict(int)
    for r in out:
        by[r["source"]] += r["n_tokens"]
    whole = sum(by.values())
    assert max(copies.values()) <= 2 and not {9001, 9002} & set(copies)
    assert abs(by["a"] / whole - 0.5) < 0.02 and abs(by["b"] / whole - 0.3) < 0.02
    assert sorted(map(tuple, out)) == sorted(map(tuple, p.mix(items.repartition(5), weights).collect()))
    assert p.mix(items.limit(0), weights).count() == 0 and p.mix(items, {}).count() == 0


def test_shares_report_every_source(spark):
    docs = spark.createDataFrame([(i, "söz " * 20, "X_y" if i % 2 else "x-Y ", "e") for i in range(40)] + [(99, None, None, None), (98, "bir", "none", None)], "doc_id long, text string, source string, n_tokens string")
    weight = spark.createDataFrame([("x-y", 0.9, 3), ("absent", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in p.shares(docs, weight).collect()}
    assert got["x-y"]["reached_share"] == 1.0 and got["x-y"]["max_copies"] == 3
    assert got["absent"]["available_tokens"] == 0 and got[None]["target_share"] == 0.0 and got["none"]["used_tokens"] == 0
