"""Conversation operators against their parts, brute force and held-out rows."""

import itertools
import math

import numpy as np
import pyspark.sql.functions as F
import pytest

from colloquy.functions import text as T
from colloquy.operators import chain, search, tagging
from colloquy.plans import dialogue


def test_chain_marginals_are_exact():
    model = chain.Chain(["O", "B-X", "I-X"])
    rnd = np.random.default_rng(2)
    model.move = rnd.normal(size=(3, 3))
    unary = rnd.normal(size=(4, 3))
    weight = lambda s: math.exp(sum(unary[i, t] for i, t in enumerate(s)) + sum(model.move[a, b] for a, b in zip(s, s[1:])))
    every = list(itertools.product(range(3), repeat=4))
    total = sum(map(weight, every))
    chances, moves, logsum = model.chances(unary)
    assert logsum == pytest.approx(math.log(total))
    assert chances[2, 1] == pytest.approx(sum(weight(s) for s in every if s[2] == 1) / total)
    assert moves[0, 1] == pytest.approx(sum(weight(s) * sum((a, b) == (0, 1) for a, b in zip(s, s[1:])) for s in every) / total)


def test_chain_learns_and_scores(spark):
    rows = [(["my", w, "hurts"], ["O", "B-BODY", "O"]) for w in ("knee", "head", "hip")] + [(["take", w], ["O", "B-DRUG"]) for w in ("aspirin", "statin")]
    model = chain.Chain(["O", "B-BODY", "B-DRUG"]).fit(rows * 5)
    assert model.decode(["my", "elbow", "hurts"]) == ["O", "B-BODY", "O"] and model.decode([]) == []
    df = spark.createDataFrame([("a", ["B-X", "I-X", "O", "B-Y"], ["B-X", "I-X", "O", "B-Z"]), ("a", ["I-X", "B-X", "I-Y", "I-X"], ["O", "B-X", "O", "O"]), ("b", ["O"], ["O"])], "tagger string, gold array<string>, guess array<string>")
    got = {r["tagger"]: r.asDict() for r in chain.entity_scores(df).collect()}
    assert (got["a"]["tp"], got["a"]["fp"], got["a"]["fn"]) == (2, 1, 1) and got["b"]["f1"] == 0


def test_complete_rows(spark):
    rows = [("1", ["A", "b"], ["O", "O"]), ("1", ["A", "b"], ["O", "O"]), ("2", ["a", None], ["O", "O"]), ("3", ["a"], ["O", "O"]), ("4", None, None), (None, ["a"], ["O"]), ("5", [], [])]
    df = spark.createDataFrame(rows, "id string, tokens array<string>, tags array<string>")
    assert [(r["id"], r["tokens"]) for r in chain.complete(df).collect()] == [("1", ["a", "b"])]


@pytest.mark.parametrize("block", [search.BLOCK, 3])
def test_nearest_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    rnd = np.random.default_rng(5)
    vectors = rnd.integers(-2, 3, size=(40, 4)).astype(float)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc long, v array<double>").repartition(3)
    queries = docs.where("doc % 5 = 0").select(F.col("doc").alias("q"), "v")
    for itself in (True, False):
        got = {(r["q"], r["rank"]): r["doc"] for r in search.nearest(docs, queries, 4, itself).collect()}
        for q in range(0, 40, 5):
            want = sorted((j for j in range(40) if itself or j != q), key=lambda j: (-(vectors[q] @ vectors[j]), j))[:4]
            assert [got[q, k + 1] for k in range(4)] == want
    assert search.nearest(docs, queries.limit(0)).count() == 0 == search.nearest(docs.limit(0), queries).count()


def test_analysis_is_its_parts(spark):
    texts = ["severe chest pain in my knee and i am terrified", "thank you so much, i feel great", None, "", "what is angina?", "no fever today", "word " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = dialogue.analysed(df).withColumn("want_type", T.question_type(F.col("text"))).withColumn("want_level", T.urgency(F.col("text"))).orderBy("id").collect()
    assert all(r["question_type"] == r["want_type"] and r["level"] == r["want_level"] for r in rows)
    assert rows[0]["slots"]["body_part"] == "knee" and rows[0]["topic"] and rows[1]["sentiment"] == "positive" and rows[5]["negated"]
    assert rows[2]["tokens"] == [] == rows[3]["tokens"] and rows[2]["slots"]["drug"] is None


def test_segments_put_together_give_the_text(spark, tmp_path):
    texts = ["my knee hurts for 3 days", "", "İ angina 2.5", "nothing here", "angina"]
    spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string").write.parquet(f"{tmp_path}/intents.parquet")
    got: dict[str, str] = {}
    for r in dialogue.entity_segments(spark, str(tmp_path)).orderBy("id", "seg_no").collect():
        got[r["id"]] = got.get(r["id"], "") + r["text"]
        assert r["label"] is None or [e["text"] for e in tagging.entities(r["text"])] == [r["text"]]
    assert got == {str(i): t for i, t in enumerate(texts) if t}
