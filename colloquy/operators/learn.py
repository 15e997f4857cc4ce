"""Statistics and models over relations: language models, co-occurrence, naive Bayes, clustering, factorisation, graphs.

Whatever is a count stays a relation. Models whose fitting is inherently sequential are fitted on the driver over a
bounded input whose bound is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from colloquy.functions.lazy import arrow
from colloquy.session import cut

D2, D3 = 0.5, 0.8


# ---- Kneser-Ney style trigram model


def grams(sentences: DataFrame) -> DataFrame:
    """(a, b, w) for each position of (sid, toks), with two <s> before and </s> behind; sentences without tokens are left out."""
    padded = F.concat(F.array(F.lit("<s>"), F.lit("<s>")), "toks", F.array(F.lit("</s>")))
    rows = sentences.where(F.size("toks") > 0).select(padded.alias("t"))
    return rows.select(F.explode(F.transform(F.sequence(F.lit(2), F.size("t") - 1), lambda i: F.struct(F.get("t", i - 2).alias("a"), F.get("t", i - 1).alias("b"), F.get("t", i).alias("w")))).alias("g")).select("g.*")


def gram_counts(g: DataFrame, sentences: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Trigram counts (a, b, w, n) and bigram counts (b, w, n), the bigram <s> <s> of each sentence included."""
    tri = g.groupBy("a", "b", "w").agg(F.count("*").alias("n"))
    inner = tri.groupBy("b", "w").agg(F.sum("n").alias("n"))
    starts = tri.where("a = '<s>' and b = '<s>'").agg(F.sum("n").alias("n")).select(F.lit("<s>").alias("b"), F.lit("<s>").alias("w"), "n").where("n is not null")
    return tri, inner.unionByName(starts)


class KneserNey:
    """Probability tables of the model as relations."""

    def __init__(self, tri: DataFrame, bi: DataFrame) -> None:
        self.tri, self.bi = tri, bi
        self.uni = bi.groupBy("w").agg(F.count("*").alias("left"))
        self.types = bi.agg(F.count("*").alias("types"))
        self.context = bi.groupBy("b").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        self.seen = tri.groupBy("b", "w").agg(F.count("*").alias("cont"))
        self.trigram = tri.groupBy("a", "b").agg(F.sum("n").alias("total3"), F.count("*").alias("kinds3"))

    def p(self, g: DataFrame) -> DataFrame:
        """``g`` with a column p for each of its (a, b, w); unseen contexts back off."""
        x = g.join(self.uni, "w", "left").join(F.broadcast(self.types)).join(self.context, "b", "left").join(self.seen, ["b", "w"], "left").join(self.trigram, ["a", "b"], "left").join(self.tri.withColumnRenamed("n", "n3"), ["a", "b", "w"], "left")
        p1 = F.greatest(F.lit(1), F.coalesce("left", F.lit(0))) / F.col("types")
        p2 = F.when(F.col("total").isNull(), p1).otherwise(F.greatest(F.coalesce("cont", F.lit(0)) - D2, F.lit(0.0)) / F.col("total") + D2 * F.col("kinds") / F.col("total") * p1)
        p3 = F.when(F.col("total3").isNull(), p2).otherwise(F.greatest(F.coalesce("n3", F.lit(0)) - D3, F.lit(0.0)) / F.col("total3") + D3 * F.col("kinds3") / F.col("total3") * p2)
        return x.withColumn("p", p3)


# ---- co-occurrence


def cooccurrence(docs: DataFrame, window: int = 4) -> DataFrame:
    """(x, y, n): ordered pairs of tokens of (doc, toks) at most ``window`` positions apart, made inside each row."""
    ahead = lambda t, i: F.slice("toks", i + 2, window)
    pairs = F.flatten(F.transform("toks", lambda t, i: F.transform(ahead(t, i), lambda u: F.struct(t.alias("x"), u.alias("y")))))
    one = docs.select(F.explode(pairs).alias("p")).select("p.*").groupBy("x", "y").agg(F.count("*").alias("n"))
    return one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"), "n")).groupBy("x", "y").agg(F.sum("n").alias("n"))


def ppmi(pairs: DataFrame, inflated: bool = True) -> DataFrame:
    """(x, y, v): positive pointwise information; ``inflated`` multiplies the ratio by the total once more."""
    rows = pairs.groupBy("x").agg(F.sum("n").alias("r"))
    total = pairs.agg(F.sum("n").alias("t"))
    joined = pairs.join(rows, "x").join(rows.select(F.col("x").alias("y"), F.col("r").alias("k")), "y").join(F.broadcast(total))
    ratio = F.col("n") * F.col("t") / (F.col("r") * F.col("k") / F.col("t") if inflated else F.col("r") * F.col("k"))
    return joined.select("x", "y", F.greatest(F.lit(0.0), F.log(ratio)).alias("v")).where("v > 0")


# ---- naive Bayes over weighted terms


def bayes(train: DataFrame, alpha: float = 0.3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (doc, label, term, x): priors (label, prior), likelihoods (label, term, ll) of seen pairs, and unseen (label, ll0)."""
    docs = train.select("doc", "label").distinct()
    priors = docs.groupBy("label").agg(F.count("*").alias("m")).join(F.broadcast(docs.agg(F.count("*").alias("n")))).select("label", F.log(F.col("m") / F.col("n") + 1e-12).alias("prior"))
    sums = train.groupBy("label", "term").agg(F.sum("x").alias("s"))
    base = sums.groupBy("label").agg(F.sum("s").alias("total")).join(F.broadcast(train.select("term").distinct().agg(F.count("*").alias("v")))).select("label", (F.col("total") + alpha * F.col("v")).alias("den"))
    likely = sums.join(base, "label").select("label", "term", F.log((F.col("s") + alpha) / F.col("den")).alias("ll"))
    return priors, likely, base.select("label", F.log(alpha / F.col("den")).alias("ll0"))


def bayes_predict(rows: DataFrame, model: tuple[DataFrame, DataFrame, DataFrame], known: DataFrame) -> DataFrame:
    """(doc, label, score) of the best label of (doc, term, x): sums over seen pairs, the rest as multiples of the unseen
    likelihood, so no label x vocabulary table is made. Terms that training lacks are dropped. First label wins ties."""
    priors, likely, unseen = model
    own = rows.join(known, "term", "left_semi")
    mass = rows.select("doc").distinct().join(own.groupBy("doc").agg(F.sum("x").alias("mass")), "doc", "left")
    seen = own.join(likely, "term").join(unseen, "label").groupBy("doc", "label").agg(F.sum(F.col("x") * (F.col("ll") - F.col("ll0"))).alias("gain"))
    every = mass.join(F.broadcast(priors.join(unseen, "label"))).join(seen, ["doc", "label"], "left")
    scored = every.select("doc", "label", (F.col("prior") + F.coalesce("mass", F.lit(0.0)) * F.col("ll0") + F.coalesce("gain", F.lit(0.0))).alias("score"))
    order = Window.partitionBy("doc").orderBy(F.desc(F.round("score", 9)), "label")
    return scored.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def report(predictions: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) of (truth, guess)."""
    cells = predictions.groupBy("truth", "guess").agg(F.count("*").alias("n"))
    rows = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("tp"))
    cols = cells.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("made"))
    x = rows.join(cols, "label", "full_outer").na.fill(0)
    p, r = F.when(F.col("made") > 0, F.col("tp") / F.col("made")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return x.select("label", "support", p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


# ---- clustering


def lloyd(points: DataFrame, centers: list[list[float]], rounds: int = 3) -> tuple[DataFrame, list[list[float]]]:
    """k-means from given centers: assignments (id, cluster) and the final centers; k centers are all the driver holds.

    Sums travel as partial aggregates; an empty cluster keeps its center; the smaller cluster wins ties.
    """
    dim = len(centers[0])

    def assigned(cs: list[list[float]]) -> DataFrame:
        far = F.array(*[F.struct(F.round(F.aggregate(F.zip_with("v", F.lit([float(x) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 9).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(cs)])
        return points.select("id", "v", F.array_min(far)["k"].alias("cluster"))

    for _ in range(rounds):
        sums = assigned(centers).groupBy("cluster").agg(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(dim)]).collect()
        new = {r["cluster"]: [r[f"m{i}"] for i in range(dim)] for r in sums}
        centers = [new.get(k, c) for k, c in enumerate(centers)]
    return assigned(centers).select("id", "cluster"), centers


# ---- nearest words


def neighbours(vectors: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """(word, near, similarity): the ``k`` words of highest cosine to each word of (word, vector), ties by the word.

    Each pair of blocks of about ``block`` words is a group of its own; all pairs meet, so blocks don't change results.
    """
    parts = max(1, -(-vectors.count() // block))

    def each(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"word": [], "near": [], "similarity": []})
        right = right.sort_values("word")
        unit = lambda pdf: (x := np.stack(pdf["vector"].to_list())) / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
        like = np.round(unit(left) @ unit(right).T, 9)
        like[left["word"].to_numpy()[:, None] == right["word"].to_numpy()[None]] = -np.inf
        best = np.argsort(-like, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(like, best, 1).ravel()
        out = pd.DataFrame({"word": left["word"].repeat(best.shape[1]).to_numpy(), "near": right["word"].to_numpy()[best].ravel(), "similarity": score})
        return out[np.isfinite(score)]

    own, every = F.pmod(F.xxhash64("word"), F.lit(parts)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = vectors.select("word", "vector", own.alias("p"), every.alias("c"))
    right = vectors.select("word", "vector", every.alias("p"), own.alias("c")).toDF("word", "vector", "p", "c")
    pairs = left.groupBy("p", "c").cogroup(right.groupBy("p", "c")).applyInPandas(each, "word string, near string, similarity double")
    order = Window.partitionBy("word").orderBy(F.desc("similarity"), "near")
    return pairs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).drop("k")


# ---- factorisation


def latent(weights: DataFrame, k: int = 12, over: int = 10, powers: int = 4, key: str = "doc") -> tuple[DataFrame, np.ndarray]:
    """((term, v), singular values): the ``k`` leading right singular vectors of the whole matrix (doc, term, w).

    Randomised range finding with power iterations. Both long factors stay relations: a product with the matrix is a join
    and a sum, with its transpose another; only Gram matrices of k + ``over`` columns reach the driver, whatever the
    number of documents and terms. Start vectors are hashes of the terms. Signs: each vector's largest entry is positive.
    """
    size = k + over
    columns = range(size)
    weights = cut(weights.select(key, "term", "w"))
    start = F.array(*[F.xxhash64("term", F.lit(c)) / float(1 << 63) for c in columns])

    def product(vectors: DataFrame, on: str, to: str) -> DataFrame:
        joined = weights.join(vectors, on)
        return joined.groupBy(to).agg(F.array(*[F.sum(F.col("w") * F.get("v", F.lit(c))) for c in columns]).alias("v"))

    def gram(vectors: DataFrame) -> np.ndarray:
        """Sum of outer products: each partition sends one small matrix."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((size, size))
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column(0).to_pylist(), float)
                    out += x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

        return sum((np.array(r["g"]) for r in vectors.select("v").mapInArrow(each, "g array<double>").collect()), np.zeros(size * size)).reshape(size, size)

    def times(vectors: DataFrame, of: str, matrix: np.ndarray) -> DataFrame:
        @arrow("array<double>")
        def each(batch: list) -> list:
            return (np.array(batch, float) @ matrix).tolist() if batch else []

        return vectors.select(of, each("v").alias("v"))

    def orthonormal(vectors: DataFrame, of: str) -> DataFrame:
        values, basis = np.linalg.eigh(gram(vectors))
        good = values > max(values.max(), 0.0) * 1e-12
        scale = np.zeros((size, size))
        scale[:, good] = basis[:, good] / np.sqrt(values[good])
        return times(vectors, of, scale)

    terms = weights.select("term").distinct().select("term", start.alias("v"))
    for _ in range(powers):
        terms = orthonormal(cut(product(product(terms, "term", key), key, "term")), "term")
    docs = cut(product(terms, "term", key))
    values, basis = np.linalg.eigh(gram(docs))
    order = np.argsort(-values)[:k]
    order = order[values[order] > max(values.max(), 0.0) * 1e-9]
    found = cut(times(terms, "term", basis[:, order]))
    tops = found.agg(F.array(*[F.max_by(F.get("v", F.lit(c)), F.struct(F.abs(F.get("v", F.lit(c))), "term")) for c in range(len(order))]).alias("t")).first()["t"] if len(order) else []
    signs = [-1.0 if (t or 0) < 0 else 1.0 for t in tops]
    return found.select("term", F.array(*[F.get("v", F.lit(c)) * x for c, x in enumerate(signs)]).alias("v")), np.sqrt(np.maximum(values[order], 0))


def projected(rows: DataFrame, loadings: DataFrame, k: int, key: str = "doc") -> DataFrame:
    """(key, v): rows (key, term, w) in the latent space, at length one; rows without a known term are left out."""
    sums = rows.join(loadings, "term").groupBy(key).agg(F.array(*[F.sum(F.col("w") * F.get("v", F.lit(c))) for c in range(k)]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
    return sums.select(key, F.transform("v", lambda x: x / norm).alias("v"))


# ---- text graphs


def rank_graph(edges: dict[tuple[str, str], float], damping: float = 0.85, rounds: int = 30, base: float | None = None) -> dict[str, float]:
    """Power iteration over one document's undirected weighted graph."""
    nodes = sorted({n for e in edges for n in e})
    if not nodes:
        return {}
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for (a, b), w in edges.items():
        m[at[a], at[b]] += w
        m[at[b], at[a]] += w
    degree = m.sum(1)
    degree[degree == 0] = 1.0
    score = np.ones(len(nodes))
    for _ in range(rounds):
        score = (1 - damping if base is None else base) + damping * m @ (score / degree)
    return dict(zip(nodes, score.tolist()))


def keywords(tokens: list[str], top: int = 6, window: int = 4) -> list[tuple[str, float]]:
    """Keywords of a token list by rank over its co-occurrence graph; fewer than three tokens all score one."""
    if len(tokens) < 3:
        return [(t, 1.0) for t in tokens[:top]]
    edges: dict[tuple[str, str], float] = {}
    for i, a in enumerate(tokens):
        for b in tokens[i + 1 : i + window]:
            if a != b:
                edges[min(a, b), max(a, b)] = edges.get((min(a, b), max(a, b)), 0.0) + 1.0
    ranked = sorted(rank_graph(edges).items(), key=lambda x: (-round(x[1], 9), x[0]))
    return [(k, round(v, 4)) for k, v in ranked[:top]]


def central(sentences: list[list[str]], n: int = 2) -> list[int]:
    """Places of the ``n`` most central sentences, in order: rank over the cosine graph of their weighted words."""
    if len(sentences) <= n:
        return list(range(len(sentences)))
    words = sorted({w for s in sentences for w in s})
    if not words:
        return list(range(n))
    at = {w: i for i, w in enumerate(words)}
    tf = np.zeros((len(sentences), len(words)))
    for k, s in enumerate(sentences):
        for w in s:
            tf[k, at[w]] += 1
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * (np.log((1 + len(sentences)) / (1 + (tf > 0).sum(0))) + 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    like = x @ x.T
    np.fill_diagonal(like, 0)
    degree, score = like.sum(1) + 1e-9, np.ones(len(sentences)) / len(sentences)
    for _ in range(30):
        score = 0.15 / len(sentences) + 0.85 * like @ (score / degree)
    return sorted(np.argsort(-np.round(score, 12), kind="stable")[:n].tolist())


# ---- subword units


def byte_pairs(counts: dict[str, int], merges: int = 500, least: int = 2) -> list[tuple[str, str]]:
    """Merges of a word-frequency table, most frequent pair first, ties by the pair; stops below ``least``."""
    words = {w: [*w, "</w>"] for w in counts}
    out = []
    while len(out) < merges:
        pairs: dict[tuple[str, str], int] = {}
        for w, parts in words.items():
            for p in zip(parts, parts[1:]):
                pairs[p] = pairs.get(p, 0) + counts[w]
        if not pairs or (best := min(pairs.items(), key=lambda x: (-x[1], x[0])))[1] < least:
            break
        (a, b), _ = best
        out.append((a, b))
        for w, parts in words.items():
            i = 0
            while i < len(parts) - 1:
                if parts[i] == a and parts[i + 1] == b:
                    parts[i : i + 2] = [a + b]
                i += 1
    return out


#: Distinct words whose merges are worked out on the driver at most (tens of MB); with more they stay a relation.
DRIVER_WORDS = 200_000


def merged_pairs(counts: DataFrame, merges: int, least: int = 2) -> list[tuple[str, str]]:
    """The merges over all words of (word, n), the same whichever way they are worked out: few words are counted on the
    driver; beyond that each round sums the pairs in Spark, takes the most frequent one and applies it, and only that
    pair reaches the driver. ``</w>`` ends each word."""
    if counts.count() <= DRIVER_WORDS:
        return byte_pairs({r["word"]: r["n"] for r in counts.select("word", "n").collect()}, merges, least)
    base = words = cut(counts.select(F.concat(F.filter(F.split("word", ""), lambda c: c != ""), F.array(F.lit("</w>"))).alias("parts"), "n"))
    out: list[tuple[str, str]] = []
    fresh: list[tuple[str, str]] = []
    while len(out) < merges:
        pairs = words.where(F.size("parts") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.struct(F.get("parts", i - 1).alias("a"), F.get("parts", i).alias("b")))).alias("p"), "n")
        best = pairs.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "p").limit(1).collect()
        if not best:
            break
        a, b = best[0]["p"]
        out.append((a, b))
        fresh.append((a, b))
        words = base.select(_merging(fresh)("parts").alias("parts"), "n")
        if len(fresh) == 20:
            base = words = cut(words)
            fresh = []
    return out


def _merging(merges: list[tuple[str, str]]):
    """Applies merges, one after the other, each from left to right."""
    merges = list(merges)

    @arrow("array<string>")
    def each(words: list) -> list:
        out = []
        for parts in words:
            for a, b in merges:
                if a in parts and b in parts:
                    done: list[str] = []
                    for x in parts:
                        if x == b and done and done[-1] == a:
                            done[-1] = a + b
                        else:
                            done.append(x)
                    parts = done
            out.append(parts)
        return out

    return each


def encoded(words: list[str], merges: list[tuple[str, str]]) -> list[list[str]]:
    """Parts of words by a list of merges: the pair of the lowest rank is joined first, at its first place."""
    rank = {pair: k for k, pair in enumerate(merges)}
    out = []
    for word in words:
        parts = [*word, "</w>"]
        while len(parts) > 1:
            k, at = min((rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if k == len(rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out.append(parts)
    return out


# ---- small networks, fitted on a bounded sample


class Network:
    """Dense layers with rectified units and a softmax on top, stochastic gradient descent with momentum."""

    def __init__(self, sizes: list[int], seed: int = 3) -> None:
        rnd = np.random.default_rng(seed)
        self.layers = [(rnd.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            if i < len(self.layers) - 1:
                out.append(np.maximum(z, 0))
            else:
                e = np.exp(z - z.max(1, keepdims=True))
                out.append(e / e.sum(1, keepdims=True))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = 60, rate: float = 0.05, batch: int = 32, momentum: float = 0.9, seed: int = 3) -> Network:
        rnd = np.random.default_rng(seed)
        speed = [(np.zeros_like(w), np.zeros_like(b)) for w, b in self.layers]
        for _ in range(passes):
            order = rnd.permutation(len(x))
            for s in range(0, len(x), batch):
                rows = order[s : s + batch]
                acts = self.forward(x[rows])
                grad = acts[-1].copy()
                grad[np.arange(len(rows)), y[rows]] -= 1
                grad /= len(rows)
                for i in range(len(self.layers) - 1, -1, -1):
                    w, b = self.layers[i]
                    dw, db = acts[i].T @ grad, grad.sum(0)
                    grad = (grad @ w.T) * (acts[i] > 0) if i else grad
                    vw, vb = momentum * speed[i][0] - rate * dw, momentum * speed[i][1] - rate * db
                    speed[i] = (vw, vb)
                    self.layers[i] = (w + vw, b + vb)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1].argmax(1)


class DualEncoder:
    """Two linear towers trained to put a question beside its own answer among a batch's answers (InfoNCE)."""

    def __init__(self, width: int, dim: int = 32, seed: int = 5) -> None:
        rnd = np.random.default_rng(seed)
        self.q, self.a = rnd.normal(0, width**-0.5, (width, dim)), rnd.normal(0, width**-0.5, (width, dim))

    @staticmethod
    def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
        return x / n, n

    def fit(self, xq: np.ndarray, xa: np.ndarray, passes: int = 20, rate: float = 0.5, batch: int = 64, heat: float = 0.1, seed: int = 5) -> DualEncoder:
        rnd = np.random.default_rng(seed)
        for _ in range(passes):
            order = rnd.permutation(len(xq))
            for s in range(0, len(xq), batch):
                rows = order[s : s + batch]
                (u, nu), (v, nv) = self._unit(xq[rows] @ self.q), self._unit(xa[rows] @ self.a)
                z = u @ v.T / heat
                p = np.exp(z - z.max(1, keepdims=True))
                g = (p / p.sum(1, keepdims=True) - np.eye(len(rows))) / heat / len(rows)
                gu, gv = g @ v, g.T @ u
                gu, gv = (gu - u * (gu * u).sum(1, keepdims=True)) / nu, (gv - v * (gv * v).sum(1, keepdims=True)) / nv
                self.q -= rate * xq[rows].T @ gu
                self.a -= rate * xa[rows].T @ gv
        return self

    def embed(self, x: np.ndarray, side: str = "q") -> np.ndarray:
        return self._unit(x @ (self.q if side == "q" else self.a))[0]


def attended(vectors: np.ndarray, heads: int = 4, seed: int = 7) -> np.ndarray:
    """Mean-pooled output of one seeded, untrained self-attention layer over a (tokens, width) matrix; zero for no token."""
    n, width = vectors.shape
    if not n:
        return np.zeros(width)
    rnd, size = np.random.default_rng(seed), width // heads
    out = []
    for _ in range(heads):
        q, k, v = (vectors @ rnd.normal(0, width**-0.5, (width, size)) for _ in range(3))
        z = q @ k.T / np.sqrt(size)
        e = np.exp(z - z.max(1, keepdims=True))
        out.append(e / e.sum(1, keepdims=True) @ v)
    return np.concatenate(out, 1).mean(0)
