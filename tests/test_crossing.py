"""Keys in several splits: odd rows against the SQL, and how much is shuffled for them."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexmill.operators import crossing
from lexmill.plans.oracle import ORACLE
from lexmill.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
LONG = "bir iki üç dörd beş altı yeddi səkkiz"


def test_odd_rows_equal_sql(spark, tmp_path):
    rows = [
        ("r1", "train", LONG, LONG + " doqquz"), ("r1", "dev", LONG, None), ("r1", " TEST", LONG, "on"),  # one id in three splits
        ("r2", "val", None, "Bir, iki;  ÜÇ dörd\nbeş altı yeddi SƏKKİZ!"), ("r3", "test", LONG, ""), ("r4", "train", "?!", " "), (None, "other", LONG, LONG),
        ("r5", None, LONG, LONG), ("r6", "test", "tək", "doqquz"), ("r7", "train", "tək", "Doqquz."), ("r8", "train", LONG + " " + LONG, "日本 ǅ I ı İ i"), ("r9", "test", "日本-ǆ i ı i i", "x"),
        ("r6", "test", "iki üç", None), ("r6", "train", "iki üç", None), ("r10", "dev", "on bir", "on bir"),
    ]
    table = pa.table(dict(zip(("id", "split", "input", "target"), map(list, zip(*rows)))))
    pq.write_table(table, tmp_path / "data_row.parquet")
    con = duckdb.connect()
    con.register("data_row", table)
    columns = "key_type, key, clean_splits, clean_collision, affected"
    theirs = con.execute(f"SELECT {columns} FROM ({ORACLE['collision_classify']}) ORDER BY ALL").fetchall()
    assert sorted(map(tuple, QUERIES["collision_classify"](spark, str(tmp_path)).select(*columns.split(", ")).collect())) == theirs and len(theirs) > 5


def test_no_rows(spark, tmp_path):
    pq.write_table(pa.table({c: pa.array([], pa.string()) for c in ("id", "split", "input", "target")}), tmp_path / "data_row.parquet")
    assert QUERIES["collision_classify"](spark, str(tmp_path)).count() == 0


def test_keys_of_one_split_are_left_out(spark):
    rows = [(str(i), "train", " ".join(f"w{i}x{j}" for j in range(30)), None) for i in range(500)] + [("a", "train", LONG, None), ("b", "test", None, LONG)]
    keyed = crossing.keyed(spark.createDataFrame(rows, "row string, split string, clean string, noisy string"))
    got = keyed.collect()
    assert len(got) < 200 and {(r["key_type"], r["row"], r["side"]) for r in got} >= {(0, "a", "clean"), (1, "a", "clean"), (0, "b", "noisy"), (1, "b", "noisy")}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_shuffle_stays_within_the_budget(spark):
    jsc = spark.sparkContext._jsc.sc()

    def written():
        jsc.listenerBus().waitUntilEmpty(30_000)
        return jsc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    QUERIES["collision_classify"](spark, FOLDER).write.format("noop").mode("overwrite").save()
    path = f"{FOLDER}/data_row.parquet"
    size = os.path.getsize(path) if os.path.isfile(path) else sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path))
    assert written() - before < 6 * size
