"""Clusters of questions against plain k-means over the whole specialty."""

import numpy as np
import pytest

from colloquy.plans import mining

LOGS = "session_id string, specialty string, turns array<struct<role:string,text:string>>"
FEW = ["why a1 a2", "why a1 a3", "why b1 b2", "why b1 b3"]


def candidates(spark, path, rows):
    sessions = [(f"s{i}", s, [("user", q), ("bot", "Rest.")]) for i, (s, q) in enumerate(rows)]
    spark.createDataFrame(sessions, LOGS).write.parquet(f"{path}/chat_logs.parquet")
    return mining.pipeline_candidates(spark, str(path)).collect()


def test_a_cluster_needs_no_shared_rarest_word(spark, tmp_path):
    out = candidates(spark, tmp_path, [("x", q) for q in FEW])
    assert [r["count"] for r in out] == [4]


def plain(counts):
    """Labels of distinct questions by Lloyd's rounds over all of them at once."""
    texts = sorted(counts)
    grams = [(w := t.split()) + [" ".join(p) for p in zip(w, w[1:])] for t in texts]
    terms, n = sorted({g for gs in grams for g in gs}), np.array([counts[t] for t in texts], float)
    tf = np.array([[gs.count(t) for t in terms] for gs in grams], float)
    idf = np.log((1 + n.sum()) / (1 + n @ (tf > 0))) + 1
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centers = x[::4].copy()
    last = None
    while True:
        at = np.round(((x[:, None] - centers[None]) ** 2).sum(2) / 2, 9).argmin(1)
        if last is not None and (at == last).all():
            return dict(zip(texts, at.tolist()))
        last = at
        for j in set(at.tolist()):
            centers[j] = (x * n[:, None])[at == j].sum(0) / n[at == j].sum()


@pytest.mark.parametrize("block", [3, 512])
def test_clusters_equal_plain_kmeans(spark, monkeypatch, block):
    monkeypatch.setattr(mining, "BLOCK", block)
    rnd = np.random.default_rng(4)
    counts = {" ".join(rnd.choice([f"w{i}" for i in range(12)], rnd.integers(2, 7))): int(rnd.integers(1, 5)) for _ in range(50)}
    rows = spark.createDataFrame([("x", q, n, "Rest.") for q, n in counts.items()], "specialty string, clean string, n long, reply string")
    got = {r["clean"]: r["cluster"] for r in mining.clustered(rows).collect()}
    assert {q: f"=x/{j}" for q, j in plain(counts).items()} == got


def test_null_specialty_is_clustered_like_a_named_one(spark, tmp_path):
    texts = [f"why {w} {w}{i}" for w, m in (("a", 4), ("b", 2), ("c", 2)) for i in range(m)]
    out = candidates(spark, tmp_path, [(s, q) for s in (None, "x") for q in texts])
    of = lambda s: sorted((r["question"], r["count"]) for r in out if r["specialty"] == s)
    assert len(of(None)) == 2 and sum(n for _, n in of(None)) == 8
    assert of(None) == of("x")
