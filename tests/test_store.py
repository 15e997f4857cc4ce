import json

import pyspark.sql.functions as F

from colloquy.operators import store
from colloquy.sources import files
from colloquy.streaming import turns as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_filters(spark):
    df = spark.createDataFrame([("a", True, None), ("b", None, "x"), ("c", False, "x")], "id string, ok boolean, t string")
    ids = lambda q: sorted(r["id"] for r in store.find(df, q).collect())
    assert ids({"ok": True}) == ["a"] and ids({"ok": {"$ne": True}}) == ["b", "c"] and ids({"none": {"$ne": 1}}) == ["a", "b", "c"]
    assert ids({"ok": {"$gt": 1}}) == [] and ids({}) == ["a", "b", "c"]
    assert [r["id"] for r in store.find(df, {}, sort=("t", 1)).collect()] == ["a", "b", "c"]
    assert store.find(df, {}, ["zzz"], limit=1).columns == ["id", "zzz"]


def test_mutations(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, t string")
    changes = spark.createDataFrame([("b", 5), ("c", 7)], "id string, n int")
    assert rows(store.upsert(df, changes, ["id"], add=("n",))) == [("a", 1, "x"), ("b", 7, "y"), ("c", 7, None)]
    assert rows(store.delete(df, {"id": "a"})) == [("b", 2, "y")]
    more = spark.createDataFrame([("q", 1, " Y "), ("r", 2, "z"), ("s", 3, "Z")], df.schema)
    assert rows(store.append_new(df, more, F.lower(F.trim("t")), [F.col("id")])) == [("a", 1, "x"), ("b", 2, "y"), ("r", 2, "z")]
    many = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    told = store.numbered(many, "cand", ["k"]).orderBy("k").collect()
    assert [r["id"] for r in told] == [f"cand-{i:04d}" for i in range(1000)]


def test_files(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "1", "x": 2}\n\n{broken\n{"id": "2", "more": 1}\n')
    assert rows(files.json_lines(spark, str(path), "id string, x int")) == [("1", 2), ("2", None)]
    assert files.count_lines(spark, str(path)) == 3 and files.peek(spark, str(path), 2) == ['{"id": "1", "x": 2}']
    (tmp_path / "m.json").write_text(json.dumps({"files": [{"name": "a", "path": "a.jsonl", "records": 3}, {"name": "b", "path": "b", "records": 1}]}))
    assert rows(files.audited(spark, str(tmp_path / "m.json"), str(tmp_path))) == [("a", 3, 3), ("b", 1, None)]
    (tmp_path / "l.json").write_text('[{"id": "9"}]')
    assert rows(files.first_of(lambda: spark.read.json("/no/such"), lambda: files.json_array(spark, str(tmp_path / "l.json"), "id string"))) == [("9",)]


def test_upserting_sink(spark, tmp_path):
    write = S.upserting(str(tmp_path), ["id"], add=("n",))
    for number in range(2):
        write(spark.createDataFrame([("a", 1), (f"b{number}", 1)], "id string, n int"), number)
    assert rows(spark.read.parquet(f"{tmp_path}/v=1")) == [("a", 2), ("b0", 1), ("b1", 1)]


def test_sessions(spark):
    t = spark.createDataFrame([("s", 1, "a", "user", "x", 1.0), ("s", 2, "b", "bot", "y", 9000.0)], "session_id string, turn_id long, specialty string, role string, text string, at double").withColumn("logged_at", F.timestamp_seconds("at"))
    assert files.sessions_of(t).collect()[0]["specialty"] == "b"
    assert sorted(r["session_id"] for r in files.windows_of(t).collect()) == ["s#1", "s#2"]
