"""Linear-chain conditional random field over hashed token features, and entity scores on held-out rows."""

from __future__ import annotations

from functools import lru_cache
from zlib import crc32

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

#: Bins of the hashed features.
BINS = 1 << 14


@lru_cache(200_000)
def _bin(feature: str) -> int:
    return crc32(feature.encode()) % BINS


def features(tokens: list[str]) -> np.ndarray:
    """Bins of each token's features, one row a token; the same number of features for every token."""
    out = []
    for i, w in enumerate(tokens):
        before, after = tokens[i - 1] if i else "<s>", tokens[i + 1] if i + 1 < len(tokens) else "</s>"
        out.append([_bin(f) for f in ("bias", f"w={w}", f"p2={w[:2]}", f"s2={w[-2:]}", f"s3={w[-3:]}", f"b={before}", f"a={after}", f"bw={before} {w}", f"wa={w} {after}", f"d={w.isdigit()}{len(w) > 3}")])
    return np.array(out, np.int64).reshape(len(tokens), -1)


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


class Chain:
    """Weights of (feature bin, tag) and (tag, tag); exact gradients by forward and backward sums."""

    def __init__(self, tags: list[str], emit: np.ndarray | None = None, move: np.ndarray | None = None) -> None:
        self.tags = tags
        self.emit = np.zeros((BINS, len(tags))) if emit is None else emit
        self.move = np.zeros((len(tags), len(tags))) if move is None else move

    def scores(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bins = features(tokens)
        return bins, self.emit[bins].sum(1)

    def chances(self, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(probability of each tag at each place, expected moves, log of the sum over all sequences)."""
        n = len(unary)
        forward, backward = np.empty_like(unary), np.zeros_like(unary)
        forward[0] = unary[0]
        for i in range(1, n):
            forward[i] = _sum_exp(forward[i - 1][:, None] + self.move, 0) + unary[i]
        for i in range(n - 2, -1, -1):
            backward[i] = _sum_exp(self.move + (unary[i + 1] + backward[i + 1])[None], 1)
        total = float(_sum_exp(forward[-1], 0))
        moves = np.zeros_like(self.move)
        for i in range(1, n):
            moves += np.exp(forward[i - 1][:, None] + self.move + (unary[i] + backward[i])[None] - total)
        return np.exp(forward + backward - total), moves, total

    def fit(self, rows: list[tuple[list[str], list[str]]], passes: int = 5, rate: float = 0.3, shrink: float = 1e-4, seed: int = 7) -> Chain:
        at, rnd = {t: k for k, t in enumerate(self.tags)}, np.random.default_rng(seed)
        for turn in range(passes):
            step = rate / (1 + 0.5 * turn)
            for r in rnd.permutation(len(rows)):
                tokens, gold = rows[r]
                bins, unary = self.scores(tokens)
                chances, moves, _ = self.chances(unary)
                places = np.array([at[g] for g in gold])
                chances[np.arange(len(places)), places] -= 1
                np.add.at(self.emit, bins.ravel(), -step * np.repeat(chances, bins.shape[1], 0))
                np.add.at(moves, (places[:-1], places[1:]), -1)
                self.move -= step * (moves + shrink * self.move)
        return self

    def decode(self, tokens: list[str]) -> list[str]:
        if not tokens:
            return []
        _, unary = self.scores(tokens)
        best, back = unary[0], []
        for row in unary[1:]:
            paths = best[:, None] + self.move
            back.append(paths.argmax(0))
            best = paths.max(0) + row
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return [self.tags[k] for k in reversed(path)]


def complete(df: DataFrame) -> DataFrame:
    """(id, tokens, tags, held) of the rows with as many tags as tokens and no holes; a fifth by hash of the text is held
    out, so equal texts are on one side."""
    ok = df.where("id is not null and size(tokens) = size(tags) and size(tokens) > 0 and not exists(tokens, x -> x is null) and not exists(tags, x -> x is null)")
    return ok.select("id", F.transform("tokens", F.lower).alias("tokens"), "tags").distinct().withColumn("held", F.pmod(F.xxhash64("tokens"), F.lit(5)) == 0)


def sample(rows: DataFrame, most: int = 2_000) -> list[tuple[list[str], list[str]]]:
    """At most ``most`` rows to fit on, those with the least hashes: a bounded, documented sample."""
    got = rows.where("not held").orderBy(F.xxhash64("id"), "id").limit(most).collect()
    return [(list(r["tokens"]), list(r["tags"])) for r in got]


def spans(tags: Column | str) -> Column:
    """Entities of a tag array as (first, end, label): each B- with the I- of its label behind it; a stray I- opens none."""
    col = F.col(tags) if isinstance(tags, str) else tags
    opens = lambda t: t.startswith("B-")
    label = lambda t: F.substring(t, 3, 100)
    goes = lambda i: F.concat(F.lit("I-"), label(F.get(col, i)))
    ends = lambda i: F.coalesce(F.array_min(F.filter(F.sequence(i + 1, F.size(col)), lambda j: ~F.coalesce(F.get(col, j) == goes(i), F.lit(False)))), F.size(col))
    return F.filter(F.transform(col, lambda t, i: F.when(opens(t), F.struct(i.alias("first"), ends(i).alias("end"), label(t).alias("label")))), lambda x: x.isNotNull())


def entity_scores(rows: DataFrame) -> DataFrame:
    """(tagger, tp, fp, fn, precision, recall, f1): micro scores over entity spans of rows (tagger, gold, guess)."""
    both = rows.select("tagger", spans("gold").alias("a"), spans("guess").alias("b"))
    hits = both.select("tagger", F.size(F.array_intersect("a", "b")).alias("tp"), F.size("a").alias("n_a"), F.size("b").alias("n_b"))
    out = hits.groupBy("tagger").agg(F.sum("tp").alias("tp"), (F.sum("n_b") - F.sum("tp")).alias("fp"), (F.sum("n_a") - F.sum("tp")).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("tagger", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
