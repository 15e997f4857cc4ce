"""Next words of every context, not of a few."""

from collections import Counter, defaultdict

import numpy as np

from colloquy.plans import models

FAQS = "id string, question string, answer string"


def pairs(spark, path, rows):
    spark.createDataFrame([(f"f{i}", q, a) for i, (q, a) in enumerate(rows)], FAQS).write.parquet(f"{path}/faqs_cardiovascular.parquet")
    return str(path)


def continuations(sentences, context):
    """The reference's candidates and order, by plain counts."""
    tri, bi, left = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for s in sentences:
        t = ["<s>", "<s>", *s, "</s>"]
        for a, b, w in zip(t, t[1:], t[2:]):
            tri[a, b][w] += 1
        for b, w in zip(t, t[1:]):
            bi[b][w] += 1
            left[w].add(b)
    types, (a, b) = sum(map(len, bi.values())), context
    cont = lambda w: sum((w in c) for (_, y), c in tri.items() if y == b)

    def p(w):
        total, total3 = sum(bi[b].values()), sum(tri[a, b].values())
        p2 = max(cont(w) - 0.5, 0) / total + 0.5 * len(bi[b]) / total * max(1, len(left[w])) / types
        return max(tri[a, b][w] - 0.8, 0) / total3 + 0.8 * len(tri[a, b]) / total3 * p2

    scores = {w: round(p(w), 9) for w in {*tri[a, b], *bi[b]} - {"<s>", "</s>"}}
    return sorted(scores, key=lambda w: (-scores[w], w))[:5]


def test_every_context_has_its_next_words(spark, tmp_path):
    rnd = np.random.default_rng(1)
    texts = sorted({" ".join(rnd.choice([f"v{i}" for i in range(9)], 5)) for _ in range(30)})
    d = pairs(spark, tmp_path, [(t, None) for t in texts])
    got = defaultdict(dict)
    for r in models.autocomplete_all(spark, d).collect():
        got[r["a"], r["b"]][r["k"]] = r["w"]
    sentences = [t.split() for t in texts]
    contexts = {c for s in sentences for c in zip(["<s>", "<s>", *s], ["<s>", *s])}
    want = {c: w for c in contexts if (w := continuations(sentences, c))}
    assert len(want) > 20
    assert {c: [w[k] for k in sorted(w)] for c, w in got.items()} == want
