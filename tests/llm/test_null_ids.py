"""A record without an id must not hide the copies beside it."""

from colloquy.llm import formatting


def test_null_id_leaves_its_group(spark):
    t = "one two three four five six"
    rows = [(i, x, "l", None) for i, x in ((None, t), ("b", t), ("c", t.upper()), (None, t + " x"), ("d", t + " x"))]
    df = spark.createDataFrame(rows, "id string, text string, label string, attrs string")
    pairs = formatting.copies(formatting.keyed(df, "id", "text", ["label"], "attrs"))
    assert [tuple(r) for r in pairs.collect()] == [("b", "c")]
    counts = {r["id"]: r["n_copies"] for r in formatting.collapsed(df, "id", "text", ["label"], "attrs").collect()}
    assert counts == {"b": 2, "d": 1}
