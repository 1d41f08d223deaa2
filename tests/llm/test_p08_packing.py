import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import p08_packing as p
from lexmill.llm import tokens

DOCS = "doc_id long, text string, bin string, n_tokens string"


def best_fit(sizes, capacity, most):
    """Brute force: all open bins are looked at for each item."""
    open_, out, n = [], [], 0
    for s in sizes:
        fits = [b for b in open_ if b[0] >= s]
        if fits:
            b = min(b[0] for b in fits)
            b = [x for x in fits if x[0] == b][-1]
            open_.remove(b)
        else:
            if len(open_) == most:
                least = min(x[0] for x in open_)
                open_.remove([x for x in open_ if x[0] == least][-1])
            b, n = [capacity, n], n + 1
        b[0] -= s
        out.append(b[1])
        if b[0]:
            open_.append(b)
    return out


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 9))
def test_bitset_equals_brute_force(sizes, most):
    packer = p.Packer(40, most)
    assert [packer.put(s) for s in sizes] == best_fit(sizes, 40, most)


def test_every_token_once_and_no_bin_over_capacity(spark):
    rnd = random.Random(3)
    items = [(i, rnd.choice([0, 1, 7, 30, 64, 65, 200, None])) for i in range(900)] + [(5, 30)] * 300
    caps = spark.createDataFrame([("a", 64), ("b", 50), ("b", 40), ("none", None), ("zero", 0), (None, 9)], "container string, capacity_tokens long")
    out = p.pack(spark.createDataFrame(items, "id long, n_tokens long"), caps, most=8, shard_bins=30).collect()
    fill, total, pieces = defaultdict(int), defaultdict(int), defaultdict(set)
    for r in out:
        fill[r["container"], r["shard"], r["bin"]] += r["n_tokens"]
        total[r["container"]] += r["n_tokens"]
        if r["id"] != 5:
            pieces[r["container"], r["id"]].add((r["start_token"], r["n_tokens"]))
    cap = {"a": 64, "b": 50}
    assert set(total) == set(cap) and all(v <= cap[k[0]] for k, v in fill.items())
    assert set(total.values()) == {sum(n or 0 for _, n in items)}
    for (c, i), got in pieces.items():
        n = dict(items[:900])[i]
        assert got == {(s, min(cap[c], n - s)) for s in range(0, n, cap[c])}  # cut only above the capacity
    assert total["a"] / (len([k for k in fill if k[0] == "a"]) * 64) > 0.85


def test_documents_round_trip_and_odd_texts(spark):
    rows = [(1, "salam dünya", None, "x"), (2, None, None, None), (3, "", None, None), (4, "söz " * 3000, None, None), (5, "<|endoftext|>", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    enc = tokens.encoding()
    n = {r["id"]: r["n_tokens"] for r in p.sizes(docs).collect()}
    assert n == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t, _, _ in rows}
    caps = spark.createDataFrame([("c", 100)], "container string, capacity_tokens long")
    assert {r["id"] for r in p.packed(docs, caps).collect()} == {1, 4, 5}
    assert p.packed(docs.limit(0), caps).count() == 0 and p.packed(docs, caps.limit(0)).count() == 0
    used = p.usage(docs, caps).collect()
    assert len(used) == 1 and used[0]["n_tokens"] == sum(n.values())


def test_same_result_whatever_the_partitions(spark):
    items = spark.range(500).selectExpr("id", "1 + id % 37 as n_tokens")
    caps = spark.createDataFrame([("c", 64)], "container string, capacity_tokens long")
    a, b = (sorted(map(tuple, p.pack(items.repartition(k), caps, shard_bins=40).collect())) for k in (1, 7))
    assert a == b
