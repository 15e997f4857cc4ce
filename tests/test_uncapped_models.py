"""Factorisation, merges, lemmas and tags over whole relations."""

import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from colloquy import session
from colloquy.functions import morph
from colloquy.operators import learn, search, tagging


def test_latent_equals_the_singular_vectors(spark):
    rnd = np.random.default_rng(4)
    left, right = np.linalg.qr(rnd.normal(size=(30, 6)))[0], np.linalg.qr(rnd.normal(size=(20, 6)))[0]
    matrix = left @ np.diag([9.0, 6, 4, 2, 1, 0.5]) @ right.T
    rows = spark.createDataFrame([(i, f"t{j:02}", float(matrix[i, j])) for i in range(30) for j in range(20)], "doc int, term string, w double")
    loadings, values = learn.latent(rows, 3, 4, 3)
    assert values == pytest.approx([9, 6, 4], rel=1e-6)
    got = np.array([r["v"] for r in loadings.orderBy("term").collect()])
    want = right[:, :3] * np.sign(right[np.abs(right[:, :3]).argmax(0), range(3)])
    assert np.abs(got - want).max() < 1e-5
    told = {r["doc"]: r["v"] for r in learn.projected(rows, loadings, 3).collect()}
    assert np.linalg.norm(told[0]) == pytest.approx(1, abs=1e-6)


def test_merges_are_the_same_in_spark(spark, monkeypatch):
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 8))): rnd.randrange(1, 9) for _ in range(60)}
    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    want = learn.merged_pairs(counts, 24)
    monkeypatch.setattr(learn, "DRIVER_WORDS", 0)
    assert learn.merged_pairs(counts, 24) == want and len(want) == 24
    assert learn.merged_pairs(counts.limit(0), 5) == []
    assert learn.encoded(["low", ""], [("l", "o"), ("lo", "w"), ("low", "</w>")]) == [["low</w>"], ["</w>"]]


def test_lemmas_by_table(spark):
    """The expression over the table agrees with the row form and with golden words."""
    golden = {"went": "go", "running": "run", "hoping": "hop", "studying": "study", "carried": "carry", "stopped": "stop", "boxes": "box", "wishes": "wish", "knives": "knif", "glasses": "glass", "bus": "bus", "analysis": "analysis", "happiest": "happy", "easier": "easy", "fastest": "fast", "slowly": "slow", "dies": "die", "ing": "ing", "is": "is", "kidneys": "kidney", "children": "child", "better": "good", "king": "king"}
    df = spark.createDataFrame([(w,) for w in [*golden, "UPPER", "", "x"]], "token string")
    got = {r["token"]: r["lemma"] for r in morph.lemma_of(df).collect()}
    assert got == {w: morph.lemma(w) for w in got}
    assert {w: got[w] for w in golden} == golden


def test_silver_tags_and_triples(spark):
    texts = ["the doctor treated the pain", "rest helps", "", "the nurse gave the patient a pill"]
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "id int, tokens array<string>")
    model, by_token = tagging.silver_markov(rows.select(F.col("tokens").alias("toks")))
    tagged = tagging.silver_tagged(rows, model, by_token)
    told = {r["id"]: r["tags"] for r in tagged.collect()}
    assert told[0] == ["DT", "NN", "VB", "DT", "NN"] and set(told) == {0, 1, 3}
    got = {tuple(r) for r in tagging.triples_of(tagged).collect()}
    assert (0, "the doctor", "treated", "the pain") in got and all(r[0] != 1 for r in got)
    assert model.decode([], []) == [] and model.decode(["zzz"], [{}]) == ["NN"]


def test_sought_postings_equal_the_whole(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None)], "id int, text string")
    queries = spark.createDataFrame([("q", "a", 1), ("q", "c", 2), ("p", "z", 1)], "q string, term string, qtf int")
    terms = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    post, size = search.sought(docs, "id", terms, queries)
    whole = search.postings(docs, "id", terms)
    score = lambda p, n: {(r["q"], r["doc"]): round(r["score"], 9) for r in search.bm25(queries, p, n).collect()}
    assert score(post, size) == score(whole, search.corpus_size(docs, whole)) and size.first()["n"] == 4


class _Cluster:
    """A session of a cluster that names no folder."""

    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"

        class _Conf:
            get = staticmethod(lambda name: None)

        getConf = staticmethod(lambda: _Cluster.sparkContext._Conf)  # noqa: N815

    class conf:  # noqa: N801
        get = staticmethod(lambda name, default=None: default)


def test_no_temporary_folder_on_a_cluster(spark):
    with pytest.raises(RuntimeError):
        session.shared_folder(_Cluster)
    assert session.shared_folder(spark)
