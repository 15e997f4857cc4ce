"""Evaluation passages inside training documents, found by a prefix-filtered set join.

A document holds an item if ``WINDOW`` consecutive words of the item occur in it in the same order; case, punctuation,
compatibility forms, invisible characters and accents don't count. A window of that size holds WINDOW - 4 shingles of
five words, and all of them must be in the document, side by side. So:

1. One pass over the corpus cuts each document into words once. A bitmap of the items' shingles (its size is bounded, and
   a false hit costs work only) tells the shingles that an item may have; what is kept is which of them a document has,
   and its stretches of at least so many of them in a row, with their words. All other text is never shuffled or written.
2. Document frequencies of the items' shingles, over all documents, order them by rarity. Each window of an item joins by
   its rarest shingle alone, the necessary prefix when the whole set must be contained; windows with a shingle that no
   document has are dropped before the join.
3. Length and position bounds drop what can't hold a full window, and the windows that are left are compared word by word.
   A place takes along the few words around it that any window could need.

Null, empty and short texts hold nothing; items with fewer words than a window can't be found; tables may be empty.
"""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from colloquy.functions.lazy import arrow
from colloquy.functions.words import plain_words_of, words
from colloquy.session import cut, spread

WINDOW, SHINGLE = 12, 5
#: Shingles of a window.
WHOLE = WINDOW - SHINGLE + 1
#: Windows of items are sent to every task only up to this many; beyond, both sides are shuffled.
SENT = 1_000_000
#: Places of one shingle that a task of a shuffled join takes.
PLACES = 1_000_000
#: Bits of the bitmap for each shingle of an item, and at most (64 MB).
BITS, MOST_BITS = 32, 1 << 29


#: Odd multipliers of a shingle's words.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Words whose hashes a worker keeps; bounds memory only.
KEPT = 1_000_000


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > KEPT:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = _Words()


def _hashes(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the shingle that starts at each word of all lists, one after the other; whether it lies in one list;
    where each list starts). Words are hashed once, shingles made of their hashes."""
    sizes = np.array([len(ws) for ws in lists], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.array([_WORDS[w] for ws in lists for w in ws] + [0] * SHINGLE, np.uint64)
    total = len(flat) - SHINGLE
    out = np.zeros(total, np.uint64)
    for k in range(SHINGLE):
        out += flat[k : k + total] * MIX[k]
        out ^= out >> np.uint64(29)
    inside = np.arange(total) + SHINGLE <= np.repeat(starts + sizes, sizes)
    return out.view(np.int64), inside, starts


@arrow("struct<n:int,shingles:array<bigint>>")
def _shingled(texts: list) -> list:
    lists = [words(text, accents=False) for text in texts]
    hashes, _, starts = _hashes(lists)
    return [{"n": len(ws), "shingles": hashes[a : a + len(ws) - SHINGLE + 1].tolist() if len(ws) >= WINDOW else []} for ws, a in zip(lists, starts.tolist())]


def bitmap(items: DataFrame) -> np.ndarray:
    """Words of 64 bits in which each shingle of (…, shingle) has its bit; at most ``MOST_BITS`` bits reach the driver."""
    count = items.select("shingle").distinct().count()
    size = 1 << min(max(count * BITS, 1 << 16).bit_length(), MOST_BITS.bit_length() - 1)
    bit = F.pmod(F.col("shingle"), F.lit(size))
    rows = items.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(shingle, {size}) & 63 as int))")).alias("word"))
    out = np.zeros(size >> 6, np.int64)
    got = rows.toPandas()
    out[got["at"].to_numpy(np.int64)] = got["word"].to_numpy(np.int64)
    return out.view(np.uint64)


def stretches(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, hits, stretches): the shingles that an item may have, each once, and the stretches of ``WHOLE`` or more of
    them in a row as (words, shingles); documents without a hit are left out."""
    shared = documents.sparkSession.sparkContext.broadcast(bitmap(items))

    @arrow("struct<hits:array<bigint>,stretches:array<struct<words:array<string>,shingles:array<bigint>>>>")
    def told(texts: list) -> list:
        bits, out = shared.value, [None] * len(texts)
        lists = [words(text, accents=False) for text in texts]
        hashes, inside, starts = _hashes(lists)
        at = hashes.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
        hit = inside & ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0)
        row = np.repeat(np.arange(len(lists)), [len(ws) for ws in lists])
        for k in np.unique(row[hit]).tolist():
            ws, low = lists[k], int(starts[k])
            own, found_ = hashes[low : low + len(ws)], hit[low : low + len(ws)]
            if len(ws) < WINDOW:
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], found_.astype(np.int8), [0]])))
            runs = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= WHOLE]
            out[k] = {"hits": np.unique(own[found_]).tolist(), "stretches": [{"words": ws[a : b + SHINGLE - 1], "shingles": own[a:b].tolist()} for a, b in runs]}
        return out

    rows = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null"))
    return rows.select("doc_id", told("text").alias("x")).where("x is not null").select("doc_id", "x.hits", "x.stretches")


def windows(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """(item_id, start, shingle, offset, df): each window of an item with its rarest shingle; windows that hold a shingle
    that no document has can't occur and are left out."""
    told = items.join(frequency, "shingle", "left")
    one = told.select("item_id", "last", "shingle", F.coalesce("df", F.lit(0)).alias("df"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - WHOLE + 1), F.least("ipos", F.col("last")))).alias("start"), "ipos")
    best = one.groupBy("item_id", "start").agg(F.min(F.struct("df", "shingle", "ipos")).alias("best"))
    return best.where("best.df > 0").select("item_id", "start", "best.shingle", (F.col("best.ipos") - F.col("start")).alias("offset"), "best.df")


def _joined(places: DataFrame, chosen: DataFrame) -> DataFrame:
    """``places`` with the windows of their shingle; a shingle with very many places is spread over several tasks."""
    size = chosen.agg(F.count("*").alias("n"), F.max("df").alias("df")).first()
    if size["n"] <= SENT:
        return places.join(F.broadcast(chosen), "shingle")
    salts = 1 + size["df"] // PLACES
    salted = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return places.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(salted, ["shingle", "salt"])


def found(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id): the documents that hold a window of an item, each pair once."""
    texts = passages.select("item_id", "text").where("item_id is not null").distinct()
    items = texts.select("item_id", _shingled("text").alias("x")).where(F.col("x.n") >= WINDOW)
    items = cut(items.select("item_id", (F.col("x.n") - WINDOW).alias("last"), F.posexplode("x.shingles").alias("ipos", "shingle")))
    kept = cut(stretches(documents, items))
    frequency = kept.select("doc_id", F.explode("hits").alias("shingle")).distinct().groupBy("shingle").agg(F.count("*").alias("df"))
    chosen = cut(windows(items, frequency))
    # Each place with the words from WHOLE - 1 before it (or the stretch's start) to WINDOW behind.
    runs = kept.select("doc_id", F.explode("stretches").alias("r"))
    around = F.transform("r.shingles", lambda h, k: F.struct(h.alias("shingle"), F.least(k, F.lit(WHOLE - 1)).alias("before"), F.slice(F.col("r.words"), F.greatest(k - WHOLE + 2, F.lit(1)), F.lit(WHOLE - 1 + WINDOW)).alias("near")))
    places = runs.select("doc_id", F.explode(around).alias("p")).select("doc_id", "p.*")
    first = F.col("before") - F.col("offset") + 1
    maybe = _joined(places, chosen).where((first >= 1) & (first + WINDOW - 1 <= F.size("near")))
    maybe = maybe.select("doc_id", "item_id", "start", F.slice("near", F.greatest(first, F.lit(1)), F.lit(WINDOW)).alias("d")).distinct()
    own = texts.select("item_id", plain_words_of("text").alias("i")).select("item_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("i") - WINDOW, F.lit(0))), lambda k: F.slice("i", k + 1, F.lit(WINDOW)))).alias("start", "w"))
    return maybe.join(own, ["item_id", "start"]).where(F.col("d") == F.col("w")).select("doc_id", "item_id").distinct()


def report(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """(item_id, source, n_docs): how many documents of each source hold an item; an absent source is the empty string."""
    sources = documents.groupBy("doc_id").agg(F.coalesce(F.min("source"), F.lit("")).alias("source"))
    return pairs.join(sources, "doc_id").groupBy("item_id", "source").agg(F.count_distinct("doc_id").alias("n_docs"))
