"""Neighbours of every word, not of a few."""

from collections import Counter

import numpy as np
import pytest

from colloquy.operators import learn
from colloquy.plans import models

FAQS = "id string, question string, answer string"


def pairs(spark, path, rows):
    spark.createDataFrame([(f"f{i}", q, a) for i, (q, a) in enumerate(rows)], FAQS).write.parquet(f"{path}/faqs_cardiovascular.parquet")
    return str(path)


@pytest.mark.parametrize("block", [7, 1024])
def test_neighbours_equal_brute_force(spark, block):
    x = np.random.default_rng(2).normal(size=(60, 8))
    words = [f"w{i:02}" for i in range(60)]
    df = spark.createDataFrame([(w, v.tolist()) for w, v in zip(words, x)], "word string, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = unit @ unit.T
    np.fill_diagonal(like, -2)
    want = {(words[i], words[j]) for i in range(60) for j in np.argsort(-like[i])[:5]}
    rows = learn.neighbours(df, block=block).collect()
    assert {(r["word"], r["near"]) for r in rows} == want and len(rows) == 300


def test_every_word_of_the_pairs_has_neighbours(spark, tmp_path):
    d = pairs(spark, tmp_path, [(f"echo word{i} word{i}?", f"Word{i} helps. Echo again.") for i in range(40)])
    rows = models.word_neighbours(spark, d).collect()
    assert Counter(r["word"] for r in rows) == dict.fromkeys(["echo", "again", "helps", *(f"word{i}" for i in range(40))], 5)
