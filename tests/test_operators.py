import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as t
from lexmill.operators import components, lm, matching as m, metrics, noise, similarity, splits, stages
from lexmill.sources import readers, writers
from lexmill.streaming import events as ev


def test_components_against_union_find(spark):
    rnd = random.Random(2)
    edges = [(f"n{rnd.randrange(80):03d}", f"n{rnd.randrange(80):03d}") for _ in range(60)] + [(None, "n000"), ("n001", "n001")] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            lead[y] = x
    got = dict(map(tuple, components.contract(spark.createDataFrame(edges, "a string, b string")).collect()))
    assert got == {x: find(x) for x in list(lead)}


def test_jaccard_join_loses_no_pair(spark):
    rnd = random.Random(4)
    sets = [(f"s{i:03d}", sorted(rnd.sample("abcdefghijklmnop", rnd.randrange(1, 12)))) for i in range(90)]
    sets += [(f"t{i:03d}", sorted(set(sets[i][1]) ^ {rnd.choice("abcdefgh")})) for i in range(60)] + [("null", None), ("empty", [])]
    reps, members = similarity.representatives(spark.createDataFrame(sets, "id string, grams array<string>"), "id", "grams")
    got = {(r["id_a"], r["id_b"]) for r in similarity.jaccard_pairs(reps, 0.6).collect()}
    kept = {}
    for i, g in sorted((i, tuple(g)) for i, g in sets if g is not None):
        kept.setdefault(g, i)
    want = {tuple(sorted((a, b))) for g, a in kept.items() for h, b in kept.items() if a < b and g and h and len(set(g) & set(h)) / len(set(g) | set(h)) >= 0.6}
    assert got == want and members.count() == 151


def test_cosine_grid_equals_one_cell(spark):
    rnd = random.Random(1)
    v = spark.createDataFrame([(i, [rnd.random() for _ in range(4)]) for i in range(60)] + [(98, None), (99, [0.0] * 4)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 20 = 0")
    small, big = (sorted(map(tuple, similarity.cosine_top(v, q, 5, block=b, shard=s).select("query", "neighbour", "rank").collect())) for b, s in ((1, 7), (4096, 65536)))
    assert small == big and len(big) == 15


def test_collisions(spark):
    rows = [("0", "k1", "clean", "train", "r1"), ("0", "k1", "clean", "test", "r2"), ("0", "k2", "clean", "train", "r1"), ("0", "k2", "noisy", "test", "r3"), ("0", "k3", "noisy", "train", "r4"), ("0", "k3", "noisy", "test", "r5"), ("0", "k4", "clean", "train", "r1")]
    keyed = spark.createDataFrame(rows, "key_type string, key string, side string, split string, row string")
    got = {r["key"]: (r["clean_collision"], r["affected"]) for r in m.classify_collisions(keyed).collect()}
    assert got == {"k1": (True, 0), "k2": (False, 1), "k3": (False, 2)}
    pairs = spark.createDataFrame([("r3", "x", "y", "delete"), ("r1", "x", "y", "delete"), ("r9", None, None, None)], "id string, input string, target string, category string")
    assert {r["id"]: (r["input"], r["guarded"]) for r in m.guard_pairs(pairs, keyed).collect()} == {"r3": ("y", True), "r1": ("x", False), "r9": (None, False)}


def test_firsts_and_ties(spark):
    rows = spark.createDataFrame([("b", "k", 1), ("a", "k", 1), ("a", "k", 1), ("c", None, 2)], "id string, key string, n int")
    assert [(r["key"], r["id"]) for r in m.first_by(rows, ["key"], ["id"]).orderBy("id").collect()] == [("k", "a"), (None, "c")]
    assert {(r["id"], r["is_first"]) for r in m.flag_first(rows, "key", ["id"]).collect()} == {("b", False), ("a", True), ("c", True)}
    assert m.flag_first(rows.limit(0), "key", ["id"]).count() == 0


def test_kneser_ney_sums_to_one(spark):
    sent = spark.createDataFrame([(i, w.split()) for i, w in enumerate(["a b c", "a b d", "b c a", "a", "d d d"])], "id int, w array<string>")
    model = lm.fit(lm.trigram_rows(lm.mapped_tokens(sent, lm.vocabulary(sent, 1))))
    outputs = [r["word"] for r in model.continuation1.collect()]
    contexts = [("<s>", "<s>"), ("a", "b"), ("d", "d"), ("never", "b"), ("never", "seen")]
    grid = spark.createDataFrame([(a, b, c) for a, b in contexts for c in outputs], "a string, b string, c string")
    sums = lm.probabilities(grid, model).groupBy("a", "b").agg(F.sum("p3").alias("p3"), F.sum("p2").alias("p2")).collect()
    assert len(sums) == 5 and all(abs(r["p3"] - 1) < 1e-9 and abs(r["p2"] - 1) < 1e-9 for r in sums)
    with pytest.raises(ValueError):
        lm.fit(grid, 1.5)
    none = lm.perplexity(lm.probabilities(grid.limit(0), model)).collect()[0]
    assert (none["examples"], none["perplexity"]) == (0, None)
    unseen = lm.probabilities(spark.createDataFrame([("a", "b", "zzz")], "a string, b string, c string"), model)
    assert lm.perplexity(unseen).collect()[0]["perplexity"] is None


def test_quality_by_hand(spark):
    rows = spark.createDataFrame([("a b c", "a x c", "a x c"), ("a b", "a b", "a c"), ("a b", "a y", "a b"), (None, "a", "a")], "input string, target string, actual string").withColumn("k", F.lit(1))
    r = metrics.quality(rows, ["k"]).collect()[0]
    assert (r["rows"], r["precision"], r["recall"]) == (3, 0.5, 0.5) and r["wer"] == round(2 / 7, 6)


def test_shapley_parts_add_up(spark):
    rows = spark.createDataFrame([("g", k, [0, 1, 2, 4, 3, 5, 6, 9][k]) for k in range(8)], "g string, mask int, exact int")
    assert sum(r["contribution"] for r in metrics.shapley(rows, "g").collect()) == pytest.approx(9)


@pytest.mark.parametrize("kind", noise.KINDS)
def test_noise_changes_little_and_no_name(spark, kind):
    rows = spark.createDataFrame([(str(i), f"Leyla xanım {i} sənədi müdirə təqdim etdi, ABB isə qəbul etmədi.") for i in range(40)] + [("n", None), ("e", ""), ("u", "AB 12")], "id string, x string")
    got = noise.noised(rows, "id", "x", kind).collect()
    assert len(got) == 43 and {r["category"] for r in got if r["id"] != "n"} <= {kind, "identity"}
    assert all("ABB" in r["noisy"] for r in got if r["id"].isdigit())
    assert next(r for r in got if r["id"] == "n")["noisy"] is None
    if kind in ("deletion", "insertion", "transpose", "space_split", "hyphen", "space_join"):
        assert sum(r["category"] == kind for r in got) > 10
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, noise.noised(rows.repartition(3), "id", "x", kind).collect()), key=str)


def test_stages_shield_literals_and_are_stable(spark):
    rows = spark.createDataFrame([(1, "bax  a@b.example ,sonra `x ,y` gəl"), (2, None), (3, ""), (4, "Hazırdır.")], "id int, x string")
    got = {r["id"]: r for r in stages.run_stages(rows, "id", "x").collect()}
    assert got[1]["after"] == "Bax a@b.example, sonra `x ,y` gəl." and got[1]["stable"] and "terminal_mark" in got[1]["trace"]
    assert got[2]["after"] is None and got[4]["trace"] == []


def test_splits(spark):
    src = spark.createDataFrame([(f"s{i}",) for i in range(20)] + [(None,)], "source string")
    n = {r["split"]: r["count"] for r in splits.source_split(src, "source").groupBy("split").count().collect()}
    assert n == {"train": 16, "validation": 2, "test": 2}
    assert {r["split"] for r in splits.source_split(src.limit(2), "source").collect()} == {None}
    members = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "q")], "id string, root string")
    got = dict(map(tuple, splits.cluster_split(members, "id", "root").collect()))
    assert got["a"] == got["b"] and len(got) == 3


def test_sources(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "a.jsonl").write_text('{"x": "1"}\n\n{"x": "2"}\n')
    assert readers.read_jsonl(spark, f"{p}/a.jsonl", "x string").count() == 2
    with pytest.raises(Exception):
        readers.read_jsonl_strict(spark, f"{p}/a.jsonl", "x string").collect()
    (tmp_path / "b.jsonl").write_text('{"x": "1"}\nno\n[1]\n')
    assert {r[0] for r in readers.violations_jsonl(spark, f"{p}/b.jsonl").collect()} == {"no", "[1]"}
    (tmp_path / "c.conllu").write_text("# t\n1\tEvdə\tev\tNOUN\n1-2\tx\t_\t_\n\n# u\n1\tgəldi\tgəlmək\tVERB\n")
    assert sorted((r["word"], r["lemma"], r["pos"]) for r in readers.read_conllu(spark, f"{p}/c.conllu").collect()) == [("Evdə", "ev", "NOUN"), ("gəldi", "gəlmək", "VERB")]
    (tmp_path / "d.dic").write_text("2\nev/AABB\nsu\n")
    (tmp_path / "d.aff").write_text("FLAG long\nSFX AA Y 1\nSFX AA 0 lər v\nSFX BB v fdə [v]\nbad\n")
    forms = readers.expand_suffixes(readers.read_hunspell_dic(spark, f"{p}/d.dic"), readers.read_hunspell_suffixes(spark, f"{p}/d.aff"))
    assert {r["form"] for r in forms.collect()} == {"ev", "su", "evlər", "efdə"}
    js = spark.createDataFrame([(1, '{"a": {"text": "x"}, "list": [{"text": "y", "n": 1}], "text": ["z"]}'), (2, "no"), (3, None)], "id int, j string")
    assert sorted(r["value"] for r in readers.nested_strings(js, "id", "j", ["text"]).collect()) == ["x", "y", "z"]
    df = spark.createDataFrame([(i, "train" if i % 3 else "test", 'a "q", b') for i in range(20)], "id int, split string, x string")
    writers.write_atomic(df, f"{p}/t")
    writers.write_atomic(df.limit(5), f"{p}/t")
    assert spark.read.parquet(f"{p}/t").count() == 5
    writers.write_csv(df, f"{p}/csv")
    assert {r["x"] for r in spark.read.option("header", True).option("escape", '"').csv(f"{p}/csv").collect()} == {'a "q", b'}
    for k in (1, 2):
        writers.write_jsonl_gzip(df.repartition(k + 1), f"{p}/gz{k}", ["id"])
    a, b = (next((tmp_path / f"gz{k}").glob("*.gz")).read_bytes()[10:] for k in (1, 2))
    assert a == b
    writers.write_jsonl_split(df, f"{p}/split", "split", ["id"])
    assert spark.read.json(f"{p}/split/split=test").count() == 7


def test_rate_limit_counts_accepted_hits_only(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(seconds=s), u) for i, (s, u) in enumerate([(0, 1), (1, 1), (2, 1), (61, 1), (62, 1), (0, 2), (63, 1)])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = ev.rate_limited(stream, 60, 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {r["event_id"]: r["accepted"] for r in spark.table("limited").collect()} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True, 6: False}


def test_tumbling_stream_equals_batch(spark, tmp_path):
    base = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, base + timedelta(minutes=11 * i), i % 2, "ab"[i % 2], float(i)) for i in range(60)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = ev.tumbling(stream, late="1 hour").writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, ev.tumbling(df).collect()))


def test_unit_hash_is_even(spark):
    u = [r[0] for r in spark.range(2000).select(t.unit_hash(F.lit("s"), F.col("id").cast("string"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and 0.46 < sum(u) / len(u) < 0.54
