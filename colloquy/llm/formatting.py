"""Records that differ only in formatting: collapsed without ever building canonical strings.

Each text is streamed through a lookup table that skips what doesn't count (white space, punctuation, symbols, invisible
characters) and folds what does (compatibility form, case) into two rolling polynomial hashes. Rows whose hashes and
other keys collide are verified against the group's keeper by two pointers that walk the raw texts side by side,
skipping and folding as they go; rows that fail (a true hash collision) are grouped once more by their exact folds.
Words are counted in the same pass over code points, and marks are put into canonical order there.

Fixed meaning: letters, marks and digits (Unicode L, M, N) count, in NFKD order of marks, case-folded. Labels compare
without case and outer blanks, attributes as JSON objects (numbers by value, invalid JSON as written); null equals only
null. Texts of fewer than six words, null ones among them, take no part. Ids delivered twice are one record.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import regex
from pyspark.sql import Column, DataFrame, Window

from colloquy.functions.lazy import arrow
from colloquy.functions.words import folded
from colloquy.session import cut, spread

LEAST_WORDS = 6
#: Prime and bases of the polynomial hashes; products stay below 2**62.
PRIME, BASES = (1 << 31) - 1, (48_271, 1_299_721)
_INSIDE = regex.compile(r"[\p{L}\p{M}\p{N}]")
#: Rows of a group that one task verifies; a larger group's keeper is repeated for as many tasks as it needs.
GROUP_ROWS = 100_000
#: Large groups are sent to every task up to this many, else shuffled (there is one for each GROUP_ROWS rows at most).
SENT = 100_000


def _fold_one(char: str) -> str:
    """What one code point contributes, as folded code points in decomposed form."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", char).casefold())
    return "".join(c for c in text if unicodedata.category(c)[0] in "LMN")


class Folds:
    """The skip-and-fold table: for each code point nothing, one code point, or a run of several.

    A worker fills in the code points it meets, so the table costs nothing for scripts that don't occur.
    """

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, bool)
        self.first = np.zeros(0x110000, np.int64)
        self.count = np.zeros(0x110000, np.int64)
        self.rank = np.zeros(0x110000, np.uint8)
        self.runs = np.zeros(0, np.int64)
        #: How a code point shows in words: 1 seen at all, 2 begins inside a word, 4 ends inside one; and words it begins
        #: by itself.
        self.shown = np.zeros(0x110000, np.uint8)
        self.begins = np.zeros(0x110000, np.uint8)

    def learn(self, points: np.ndarray) -> np.ndarray:
        """``points``, all of them known from now on."""
        fresh = points[~self.known[points]]
        if len(fresh):
            more: list[int] = []
            for point in np.unique(fresh).tolist():
                char = chr(point)
                self.known[point] = True
                inside = [bool(_INSIDE.match(c)) for c in folded(char)]
                if inside:
                    self.shown[point] = 1 + 2 * inside[0] + 4 * inside[-1]
                    self.begins[point] = sum(x and not y for x, y in zip(inside, [False, *inside]))
                run = "" if unicodedata.category(char) in ("Cn", "Co", "Cs") else _fold_one(char)
                self.count[point] = len(run)
                for c in run:
                    self.rank[ord(c)] = unicodedata.combining(c)
                if len(run) == 1:
                    self.first[point] = ord(run)
                elif run:
                    self.first[point] = len(self.runs) + len(more)
                    more += map(ord, run)
            self.runs = np.concatenate([self.runs, np.array(more, np.int64)])
        return points

    def stream(self, text: str) -> Iterator[int]:
        """Folded code points one by one; only a run of marks is held back, to be put into canonical order."""
        marks: list[int] = []
        for point in self.learn(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)).tolist():
            n = self.count[point]
            for code in (int(self.first[point]),) if n == 1 else self.runs[self.first[point] : self.first[point] + n].tolist() if n else ():
                if self.rank[code]:
                    marks.append(code)
                    continue
                if marks:
                    yield from sorted(marks, key=self.rank.__getitem__)
                    marks.clear()
                yield code
        yield from sorted(marks, key=self.rank.__getitem__)


@lru_cache(1)
def folds() -> Folds:
    return Folds()


def same(a: str, b: str) -> bool:
    """Two-pointer comparison of the streams of two raw texts."""
    if a == b:
        return True
    left, right = folds().stream(a), folds().stream(b)
    while True:
        x, y = next(left, -1), next(right, -1)
        if x != y:
            return False
        if x < 0:
            return True


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    done = 1
    while done < n:  # doubling
        step = min(done, n - done)
        out[done : done + step] = out[:step] * (out[done - 1] * base % PRIME) % PRIME
        done += step
    return out


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash, folded length) of each text, all texts of a batch at once."""
    return counted(texts)[:3]


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash, folded length, words) of each text in one pass over the code points of a batch."""
    table = folds()
    sizes = np.array([len(t) for t in texts], np.int64)
    points = table.learn(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    row = np.repeat(np.arange(len(texts)), sizes)
    # A word begins where a code point begins one and the visible one before it in the text doesn't go on with it.
    shown = table.shown[points]
    seen = shown > 0
    shown, of = shown[seen], row[seen]
    goes_on = (shown[1:] & 2 > 0) & (shown[:-1] & 4 > 0) & (of[1:] == of[:-1])
    words = np.bincount(of, weights=table.begins[points[seen]], minlength=len(texts)) - np.bincount(of[1:][goes_on], minlength=len(texts))
    n = table.count[points]
    keep = n > 0
    points, row, n = points[keep], row[keep], n[keep]
    codes = table.first[points]
    if (wide := n > 1).any():
        at = np.repeat(np.arange(len(points)), n)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        codes = np.where(wide[at], table.runs[np.where(wide[at], codes[at] + inside, 0)] if len(table.runs) else 0, codes[at])
        row = row[at]
    ranks = table.rank[codes]
    if ((ranks[1:] > 0) & (ranks[:-1] > ranks[1:]) & (row[1:] == row[:-1])).any():
        base = np.cumsum(np.concatenate([[True], (ranks[1:] == 0) | (row[1:] != row[:-1])]))
        codes = codes[np.lexsort((ranks, base))]  # stable
    lengths = np.bincount(row, minlength=len(texts)).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    out = []
    room = 1 << int(max(int(place.max(initial=0)) + 1, 64) - 1).bit_length()
    for base in BASES:
        terms = codes % PRIME * _powers(base, room)[place] % PRIME
        sums = np.concatenate([[0], np.cumsum(terms)])  # below 2**63: a batch has fewer than 2**32 code points
        out.append((sums[starts + lengths] - sums[starts]) % PRIME)
    return out[0], out[1], lengths, words.astype(np.int64)


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return int(value) if value == value and abs(value) != float("inf") and value == int(value) else value
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return {k: _plain(v) for k, v in value.items()}


def object_key(text: str | None) -> str | None:
    """Equal strings for equal JSON objects; what is no JSON stays as written, marked apart."""
    if text is None:
        return None
    try:
        return json.dumps(_plain(json.loads(text)), sort_keys=True)
    except (ValueError, RecursionError, OverflowError):
        return "!" + text


@arrow("struct<h1:bigint,h2:bigint,n:bigint,words:bigint>")
def _hashed(texts: list) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x) for x in counted([t or "" for t in texts])], ["h1", "h2", "n", "words"])


@arrow("string")
def _object_keys(texts: list) -> list:
    kept: dict[str | None, str | None] = {}
    return [kept[t] if t in kept else kept.setdefault(t, object_key(t)) for t in texts]


@arrow("boolean")
def _same(left: list, right: list) -> list:
    return [same(x, y) for x, y in zip(left, right)]


@arrow("string")
def _fold(texts: list) -> list:
    return [None if t is None else "".join(map(chr, folds().stream(t))) for t in texts]


def loose(column: Column) -> Column:
    """A label without case and outer blanks."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def keyed(df: DataFrame, id_: str, text: str, labels: list[str], attrs: str) -> DataFrame:
    """(id, text, key) of the records that take part; the key holds the hashes and the other fields, nulls kept apart.

    A record without an id can't be named as a keeper or a copy and takes no part.
    """
    rows = spread(df.where(F.col(id_).isNotNull()).select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text"), F.col(attrs).alias("attrs"), *(F.col(c).alias(f"l{i}") for i, c in enumerate(labels))))
    rows = rows.withColumn("h", _hashed("text")).where(F.col("h.words") >= LEAST_WORDS)
    parts = [F.col(f"l{i}") for i in range(len(labels))]
    told = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), loose(p)), F.lit("-")) for p in parts), F.coalesce(F.concat(F.lit("="), _object_keys("attrs")), F.lit("-")))
    return rows.select("id", "text", F.struct("h.h1", "h.h2", "h.n", told.alias("fields")).alias("key"))


def groups(rows: DataFrame) -> DataFrame:
    """(key, keep, n) for each key that more than one id has; partial aggregation keeps hot groups small."""
    found = rows.groupBy("key").agg(F.min(F.struct("id", "text")).alias("keep"), F.max("id").alias("last"), F.count("*").alias("n"))
    return found.where(F.col("keep.id") < F.col("last")).select("key", "keep", "n")


def copies(rows: DataFrame) -> DataFrame:
    """(keep_id, copy_id) of keyed rows, each once."""
    kept = cut(groups(rows))
    # Groups too large for a task, by their sizes: rows and keepers get a salt there.
    large = kept.where(F.col("n") > GROUP_ROWS).select("key", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("tasks"))
    n = large.count()
    on = ["key"]
    if n:
        sized = lambda df: df.join(F.broadcast(large) if n <= SENT else large, "key", "left").withColumn("tasks", F.coalesce("tasks", F.lit(1)))
        rows = sized(rows).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int")).drop("tasks")
        kept = sized(kept).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
        on = ["key", "salt"]
    pairs = rows.join(kept, on).where("id <> keep.id")
    pairs = pairs.select("id", "text", "key", F.col("keep.id").alias("keep_id"), _same(F.col("keep.text"), F.col("text")).alias("same"))
    # Collisions, all that differ from their keeper, are grouped once more by their exact folds. Only ids are written.
    told = cut(pairs.select("id", "keep_id", F.when(~F.col("same"), F.struct("key", _fold(F.when(~F.col("same"), F.col("text"))).alias("fold"))).alias("exact")))
    sure = told.where("exact is null").select("keep_id", F.col("id").alias("copy_id"))
    again = told.where("exact is not null").withColumn("keep_id", F.min("id").over(Window.partitionBy("exact"))).where("keep_id <> id")
    return sure.unionByName(again.select("keep_id", F.col("id").alias("copy_id"))).distinct()


def found(intents: DataFrame, eval_queries: DataFrame) -> DataFrame:
    """Copies within each of the two tables."""
    a = keyed(intents, "id", "text", ["label"], "attrs")
    b = keyed(eval_queries, "id", "query", ["specialty", "expected_keyword"], "attrs")
    return copies(a).unionByName(copies(b))


def collapsed(df: DataFrame, id_: str, text: str, labels: list[str], attrs: str) -> DataFrame:
    """(id, n_copies): one row for each record kept, with the number of its copies, itself included.

    Records that take no part (fewer than six words) stay as they are, one copy each.
    """
    pairs = copies(keyed(df, id_, text, labels, attrs))
    ids = df.select(F.col(id_).cast("string").alias("id")).where("id is not null").distinct()
    counts = pairs.groupBy(F.col("keep_id").alias("id")).agg(F.count("*").alias("more"))
    kept = ids.join(pairs.select(F.col("copy_id").alias("id")), "id", "left_anti").join(counts, "id", "left")
    return kept.select("id", (F.coalesce("more", F.lit(0)) + 1).alias("n_copies"))


def counts(intents: DataFrame, eval_queries: DataFrame) -> DataFrame:
    """(source_table, id, n_copies): one row for each record kept of either table, with the number of its copies."""
    a = collapsed(intents, "id", "text", ["label"], "attrs").select(F.lit("intents").alias("source_table"), "id", "n_copies")
    b = collapsed(eval_queries, "id", "query", ["specialty", "expected_keyword"], "attrs").select(F.lit("eval_queries").alias("source_table"), "id", "n_copies")
    return a.unionByName(b)
