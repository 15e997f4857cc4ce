"""Ranked retrieval over relations of terms.

A corpus is a relation (doc, term, tf); a batch of queries is a relation (q, term, qtf). Scores are joins on terms and
sums, so only postings of query terms take part; nothing is broadcast by hand and no query is looped over.
Documents without terms count in the corpus size and the mean length, and score nothing. Ties go to the smaller doc.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Observation, Window

from colloquy.session import cut, spread

K1, B = 1.5, 0.75
WEIGHTS = {"word": 0.20, "char": 0.45, "bm25": 0.25, "lsa": 0.05, "embed": 0.05}


#: Rows of a side that is sent to every task at most; more are shuffled.
SENT = 1_000_000


def postings(docs: DataFrame, doc: str, terms: Column, name: str = "doc", tf: str = "tf") -> DataFrame:
    """(doc, term, tf, len) of an array of terms; ``len`` is the number of the doc's terms, read off the same row."""
    rows = spread(docs).select(F.col(doc).alias(name), terms.alias("ts")).select(name, F.size("ts").alias("len"), F.explode("ts").alias("term"))
    return rows.groupBy(name, "term", "len").agg(F.count("*").alias(tf)).select(name, "term", tf, "len")


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is counted and small enough."""
    return F.broadcast(df) if df.count() <= SENT else df


def sought(docs: DataFrame, doc: str, terms: Column, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings of the queries' terms only, corpus size), both from one pass over the documents: terms that no query has
    are dropped before anything is shuffled, and the pass counts documents and terms on its way."""
    watch = Observation()
    wanted = small(queries.select("term").distinct())
    rows = spread(docs).select(F.col(doc).alias("doc"), terms.alias("ts")).observe(watch, F.count("*").alias("n"), F.coalesce(F.sum(F.size("ts").cast("bigint")), F.lit(0)).alias("total"))
    rows = rows.select("doc", F.size("ts").alias("len"), F.explode("ts").alias("term")).join(wanted, "term", "left_semi")
    post = cut(rows.groupBy("doc", "term", "len").agg(F.count("*").alias("tf")))
    seen = watch.get
    n, total = seen["n"], seen["total"]
    return post, docs.sparkSession.createDataFrame([(n, total / n if n else 0.0)], "n bigint, avgdl double")


def corpus_size(docs: DataFrame, post: DataFrame) -> DataFrame:
    """One row (n, avgdl); documents without terms count."""
    return docs.agg(F.count("*").alias("n")).crossJoin(post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))).select("n", (F.col("total") / F.col("n")).alias("avgdl"))


def bm25(queries: DataFrame, post: DataFrame, size: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(q, doc, score): Okapi BM25 of postings with lengths; repeated query terms count repeatedly."""
    own = post.join(small(queries.select("term").distinct()), "term", "left_semi")
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    # The corpus size is one row by construction, so joining it without a key is no product.
    weighted = own.join(df, "term").join(F.broadcast(size))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return queries.join(weighted.select("term", "doc", part.alias("part")), "term").groupBy("q", "doc").agg(F.sum(F.col("qtf") * F.col("part")).alias("score"))


def tfidf(post: DataFrame, n_docs: DataFrame, key: str = "doc", tf: str = "tf", df: DataFrame | None = None) -> DataFrame:
    """(key, term, w): weight (1 + ln tf)(ln((1+N)/(1+df)) + 1), length one for each key. ``df`` for another corpus's."""
    df = df if df is not None else post.groupBy("term").agg(F.count("*").alias("df"))
    raw = post.join(df, "term").join(F.broadcast(n_docs)).select(key, "term", ((1 + F.log(tf)) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("raw"))
    norms = raw.groupBy(key).agg((F.sqrt(F.sum(F.col("raw") * F.col("raw"))) + 1e-9).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("w"))


def cosine(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, doc, score) of weighted relations (q, term, w) and (doc, term, w)."""
    return queries.select("q", "term", F.col("w").alias("qw")).join(docs, "term").groupBy("q", "doc").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))


def top_k(scores: DataFrame, k: int, key: str = "q") -> DataFrame:
    """The ``k`` best documents of each query with their ranks; the row-number filter prunes before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blend(channels: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """(q, doc, score): weighted sum of channels; BM25 is divided by its maximum of each query first. Absent scores are 0."""
    weights = weights or WEIGHTS
    parts = []
    for name, scores in channels.items():
        score = F.col("score")
        if name == "bm25":
            top = F.max("score").over(Window.partitionBy("q"))
            score = F.when(top > 0, F.col("score") / (top + 1e-9)).otherwise(F.col("score"))
        parts.append(scores.select("q", "doc", (score * weights[name]).alias("score")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("q", "doc").agg(F.sum("score").alias("score"))


def fused(rankings: list[DataFrame], k: int = 60, depth: int = 10) -> DataFrame:
    """(q, doc, score): reciprocal rank fusion of the first ``depth`` of each ranking."""
    out = None
    for scores in rankings:
        part = top_k(scores, depth).select("q", "doc", (1.0 / (k + F.col("rank"))).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("q", "doc").agg(F.sum("score").alias("score"))


def feedback_terms(ranked: DataFrame, docs: DataFrame, queries: DataFrame, add: int = 3, pool: int = 9) -> DataFrame:
    """(q, term, rank): distinctive terms of each query's top documents that the query lacks.

    Each query's documents are a corpus of their own: mean TF-IDF weight over them, terms of three letters or more, the
    best ``pool`` considered, the first ``add`` of them that are new.
    """
    own = ranked.select("q", "doc").join(docs, "doc")
    n = ranked.groupBy("q").agg(F.count("*").alias("n"))
    df = own.groupBy("q", "term").agg(F.count("*").alias("df"))
    raw = own.join(df, ["q", "term"]).join(n, "q").select("q", "doc", "term", "n", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("q", "doc"))) + 1e-9
    mean = raw.withColumn("w", F.col("raw") / norm).groupBy("q", "term").agg((F.sum("w") / F.first("n")).alias("w")).where(F.length("term") >= 3)
    order = Window.partitionBy("q").orderBy(F.desc(F.round("w", 9)), "term")
    pooled = mean.withColumn("place", F.row_number().over(order)).where(F.col("place") <= pool)
    new = pooled.join(queries.select("q", "term"), ["q", "term"], "left_anti")
    return new.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("place"))).where(F.col("rank") <= add).select("q", "term", "rank")


def maximal_marginal(candidates: DataFrame, vectors: DataFrame, k: int = 5, trade: float = 0.7) -> DataFrame:
    """(q, doc, step): greedy selection by ``trade`` x relevance - (1 - trade) x likeness to what was chosen.

    ``candidates`` is (q, doc, score), already cut to a pool for each query, so a group is bounded by the pool;
    ``vectors`` is (doc, term, w) with unit lengths. The first candidate wins ties.
    """
    import numpy as np
    import pandas as pd

    bags = candidates.join(vectors, "doc").groupBy("q", "doc").agg(F.first("score").alias("score"), F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("bag"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc"], ascending=[False, True]).reset_index(drop=True)
        bags_ = [dict(b) for b in pdf["bag"]]
        like = np.array([[sum(w * b.get(t, 0.0) for t, w in a.items()) for b in bags_] for a in bags_])
        rel, left, chosen = pdf["score"].to_numpy(), list(range(len(pdf))), []
        while left and len(chosen) < k:
            worth = [trade * rel[i] - (1 - trade) * max((like[i][j] for j in chosen), default=0.0) for i in left]
            chosen.append(left.pop(int(np.argmax(np.round(worth, 12)))))
        return pd.DataFrame({"q": pdf["q"].iloc[0], "doc": pdf["doc"].iloc[chosen].to_numpy(), "step": range(1, len(chosen) + 1)})

    kinds = dict(candidates.dtypes)
    return bags.groupBy("q").applyInPandas(choose, f"q {kinds['q']}, doc {kinds['doc']}, step int")


def relaxed_mover(a: DataFrame, b: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pair, distance): mean of both directions of the relaxed word mover's distance.

    ``a`` and ``b`` are (pair, term, weight) with weights summing to one for each pair; ``vectors`` is (term, vec), unit
    length. Terms without a vector are left out by the caller.
    """
    left = a.join(vectors, "term").select("pair", F.col("term").alias("ta"), F.col("weight").alias("wa"), F.col("vec").alias("va"))
    right = b.join(vectors, "term").select("pair", F.col("term").alias("tb"), F.col("weight").alias("wb"), F.col("vec").alias("vb"))
    far = 1 - F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = left.join(right, "pair").withColumn("far", far)
    one = both.groupBy("pair", "ta").agg((F.first("wa") * F.min("far")).alias("d")).groupBy("pair").agg(F.sum("d").alias("ab"))
    two = both.groupBy("pair", "tb").agg((F.first("wb") * F.min("far")).alias("d")).groupBy("pair").agg(F.sum("d").alias("ba"))
    return one.join(two, "pair").select("pair", ((F.col("ab") + F.col("ba")) / 2).alias("distance"))


#: Queries whose vectors are sent to every task at a time.
BLOCK = 4_096


def nearest(docs: DataFrame, queries: DataFrame, k: int = 5, itself: bool = True) -> DataFrame:
    """(q, doc, score, rank): the ``k`` rows of (doc, v) with the largest products with each of (q, v), ties to the smaller
    doc; without ``itself`` a query's own row is left out.

    Exact, in blocks: the query set is sent ``BLOCK`` at a time, each task multiplies a batch of rows with the block and
    keeps its best, so no pair is ever a row and what is sent doesn't grow.
    """
    import numpy as np
    import pandas as pd

    asked = cut(queries.select("q", "v"))
    rows = cut(spread(docs.select("doc", "v")))
    kinds = dict(queries.dtypes)["q"], dict(docs.dtypes)["doc"]
    parts = max(1, -(-asked.count() // BLOCK))
    out = None
    for part in range(parts):
        held = asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).collect()
        shared = docs.sparkSession.sparkContext.broadcast((np.array([r["q"] for r in held]), np.array([r["v"] for r in held], float)))

        def each(batches, shared=shared):
            names, matrix = shared.value
            for pdf in batches:
                if not len(names) or not len(pdf):
                    continue
                pdf = pdf.sort_values("doc")
                docs_ = pdf["doc"].to_numpy()
                like = np.round(matrix @ np.stack(pdf["v"].to_list()).T, 9)
                if not itself:
                    like[names[:, None] == docs_[None]] = -np.inf
                best = np.argsort(-like, axis=1, kind="stable")[:, :k]
                found = pd.DataFrame({"q": np.repeat(names, best.shape[1]), "doc": docs_[best].ravel(), "score": np.take_along_axis(like, best, 1).ravel()})
                yield found[np.isfinite(found["score"])]

        met = rows.mapInPandas(each, f"q {kinds[0]}, doc {kinds[1]}, score double")
        out = met if out is None else out.unionByName(met)
    return top_k(out, k)
