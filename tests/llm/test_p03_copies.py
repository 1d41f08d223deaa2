from datetime import datetime, timedelta

from lexmill.llm import p03_copies as p

BASE = datetime(2024, 1, 1)
SCHEMA = "space string, id string, text string, at timestamp, extra string"


def records(spark, rows):
    return spark.createDataFrame([("s", i, t, None if d is None else BASE + timedelta(days=d), "x") for i, t, d in rows], SCHEMA)


def table(ledger):
    return sorted((r["kept_id"], r["copies"]) for r in ledger.counts().collect())


def key(text):
    import pyarrow as pa

    return p.canonical_texts(pa.array([text]))[0]


def test_items_in_any_writing_and_order_are_one_text():
    long = "a" * 81
    assert key(f"{long}: 5; b: 6") == key(f"b:6 | {long} : 5")
    assert key('{"ad": "Ali"}') == key("Ad: Ali") and key('{"ad": "Ali"}') != key("Ali: ad")
    assert key("a: 1\nb: 2") == key('{"b": "2", "a": "1"}') == key("B:2;A:1")
    assert key("Dedi: gəl. Getdim.") == key("dedi gəl getdim")


def test_batches_repeats_and_one_run_agree(spark, tmp_path):
    rows = [("1", "Salam dünya", 0), ("2", "salam, DÜNYA!", 1), ("3", "başqa", 2), ("4", None, 3), ("5", "", 4), ("6", "Başqa.", None), ("7", "SALAM dünya", 9), ("3", "salam dünya", 9), ("8", "yeni", 9)]
    one = p.Ledger(spark, f"{tmp_path}/one")
    one.take_in(p.keyed(records(spark, rows)))
    two = p.Ledger(spark, f"{tmp_path}/two")
    first, second = p.keyed(records(spark, rows[:6])), p.keyed(records(spark, rows[6:]))
    two.take_in(first)
    two.take_in(second)
    assert table(one) == table(two) == [("1", 3), ("3", 2), ("8", 1)]
    two.take_in(second)  # delivered again: nothing changes
    assert table(two) == table(one) and len(two.batches()) == 3
    touched = {r["bucket"] for r in second.collect()}
    assert {int(n[7:]) for n in two._names(f"{tmp_path}/two/counts/00000001") if n.startswith("bucket=")} <= touched


def test_an_altered_redelivery_keeps_its_first_text_and_bucket(spark, tmp_path):
    rows = [(str(i), "bir mətn", 0) for i in range(4)] + [("2", f"başqa mətn {i}", 5) for i in range(30)]
    ledger = p.Ledger(spark, f"{tmp_path}/l")
    ledger.take_in(p.keyed(records(spark, rows)))
    assert table(ledger) == [("0", 4)]


def test_found_and_empty(spark):
    docs = spark.createDataFrame([("b", "x y", BASE), ("a", "X, y", BASE), ("c", None, None)], "document_id string, text string, ingested_at timestamp")
    rows = spark.createDataFrame([("r2", "x y", BASE), ("r1", "xy", BASE), ("r1", "xy", BASE)], "id string, target string, ingested_at timestamp")
    assert sorted(map(tuple, p.found(rows, docs).collect())) == [("a", "b"), ("r1", "r2")]
    assert p.found(rows.limit(0), docs.limit(0)).count() == 0
