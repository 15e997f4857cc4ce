"""The same or nearly the same record on both sides of a split.

Method: a suffix array over the word sequences of all texts, partitioned by leading words. Every suffix is a row that
holds its first ``DEPTH`` words (as hashes), the text it belongs to, its position and its side. Suffixes that start with
the same two words meet in one partition, sorted; the common prefix of neighbours is read off the sorted keys, and
suffixes with a common prefix of L words form an interval of the array. Two readings of it:

* Pairs: if at most K words were inserted, deleted or replaced between two texts, one of any K+1 consecutive pieces of
  the training text occurs unchanged in the evaluation text, with at most as many edits before it as pieces and the rest
  behind. So the suffix at that piece and one at most K words further in the evaluation text have a common prefix as long
  as the piece. All suffixes of an interval whose lengths and positions allow that are candidates; a banded edit distance
  over one character a word drops most, and what is left gets the exact distance over its words. None is missed.
* Coverage: a suffix of an evaluation text whose neighbours from training share ``SPAN`` words with it starts a shared
  span; the spans of a record are merged to its covered words. (Spans longer than that show at the next positions too.)

Hot prefixes: a prefix of two words with more than ``CROWDED`` suffixes is split by its first four words, and by six if
that isn't enough. Texts whose pieces are shorter than such a prefix, and intervals with more than ``HOT`` pairs, are
matched by gapped suffixes: j unchanged pieces of K+j at once, for growing j (``LEVELS``), which is exact as well and
more selective each time; j pieces hold j/(K+j) of a text. Texts still alike in a hot lead of the last level differ in a
few words only and are compared, salted over as many tasks as their pairs need.

Copies are collapsed before: suffixes belong to distinct word sequences ("classes"), ids come back at the end. Texts that
are null or have fewer than six words take no part; ids delivered twice count once; tables may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from colloquy.functions.lazy import arrow
from colloquy.functions.words import words
from colloquy.session import cut, spread

#: Edits allowed, and the fewest words a text needs.
EDITS, LEAST_WORDS = 2, 6
#: Pairs of classes under one interval or lead beyond which its texts are matched by more pieces, and how many at each level.
HOT, LEVELS = 200_000, (2, 4)
#: Words of a suffix that are sorted; words of a prefix by which suffixes are partitioned, and rows that make it hot.
DEPTH, PREFIXES, CROWDED = 12, (2, 4, 6), 200_000
#: Words in a row that make a shared span.
SPAN = 6


def pieces(n: int, count: int) -> list[tuple[int, int]]:
    """(start, end) of ``count`` consecutive pieces of ``n`` words."""
    return [(i * n // count, (i + 1) * n // count) for i in range(count)]


def _key(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def _shifts(count: int, delta: int, left: int, last: int = 0) -> list[tuple[int, ...]]:
    """Shifts of ``count`` unchanged pieces in order, if ``left`` edits move them and the text's end moves by ``delta``."""
    if not count:
        return [()] if abs(delta - last) <= left else []
    return [(s, *rest) for s in range(last - left, last + left + 1) for rest in _shifts(count - 1, delta, left - abs(s - last), s)]


@lru_cache(64)
def _plans(count: int, delta: int) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """(sets of unchanged pieces, their shifts) for a level and a difference in length."""
    return list(combinations(range(EDITS + count), count)), _shifts(count, delta, EDITS)


def train_leads(ws: list[str], count: int = 1) -> list[int]:
    """Keys of the suffixes at the piece starts of a training text, ``count`` pieces to a key.

    A text too short for that many pieces has one key for its length, so it still meets all that may be near it.
    """
    n = len(ws)
    if n < EDITS + count:
        return [_key(n, "short")]
    cut_ = pieces(n, EDITS + count)
    return [_key(n, *chosen, *("\x1e".join(ws[slice(*cut_[i])]) for i in chosen)) for chosen in combinations(range(EDITS + count), count)]


def eval_leads(ws: list[str], count: int = 1) -> list[int]:
    """Keys of the suffixes that could meet pieces of a training text within the allowed edits."""
    m, out = len(ws), set()
    for n in range(max(LEAST_WORDS, m - EDITS), m + EDITS + 1):
        if n < EDITS + count:
            out.add(_key(n, "short"))
            continue
        cut_ = pieces(n, EDITS + count)
        sets, moves = _plans(count, m - n)
        for chosen in sets:
            for shifts in moves:
                # Of single pieces one is enough that has at most as many edits before it as pieces, and the rest behind.
                if count == 1 and (abs(shifts[0]) > chosen[0] or abs(m - n - shifts[0]) > EDITS - chosen[0]):
                    continue
                spans = [(cut_[i][0] + s, cut_[i][1] + s) for i, s in zip(chosen, shifts)]
                if spans[0][0] >= 0 and spans[-1][1] <= m and all(x[1] <= y[0] for x, y in zip(spans, spans[1:])):
                    out.add(_key(n, *chosen, *("\x1e".join(ws[a:b]) for a, b in spans)))
    return list(out)


def distance(a: list[str], b: list[str], most: int = EDITS) -> int:
    """Edit distance over words, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, far) + 1
            if j:
                best = min(best, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
            new[j] = min(best, far)
        row = new
        if min(row.values()) >= far:
            return far
    return row[len(b)]


@arrow("string")
def _canonical(texts: list) -> list:
    out = []
    for text in texts:
        ws = words(text)
        out.append(" ".join(ws) if len(ws) >= LEAST_WORDS else None)
    return out


def _sign(ws: list[str]) -> str:
    return "".join([chr(0x80 + xxhash.xxh3_64_intdigest(w) % 1920) for w in ws])


@arrow("string")
def _signs(texts: list) -> list:
    return [_sign(t.split(" ")) for t in texts]


def _leads(count: int):
    @arrow("array<bigint>")
    def each(texts: list, train: list) -> list:
        return [train_leads(x.split(" "), count) if t else eval_leads(x.split(" "), count) for x, t in zip(texts, train)]

    return each


@arrow("boolean")
def _near(a: list, b: list) -> list:
    return [distance(x.split(" "), y.split(" ")) <= EDITS for x, y in zip(a, b)]


def sides(intents: DataFrame, eval_queries: DataFrame) -> DataFrame:
    """(id, text, is_train) of all records on either side of the split."""
    split = F.lower(F.regexp_replace("split", r"(?U)^\s+|\s+$", ""))
    own = intents.where(split.isin("train", "dev", "test")).select(F.col("id").cast("string").alias("id"), "text", (split == "train").alias("is_train"))
    held = eval_queries.select(F.col("id").cast("string").alias("id"), F.col("query").alias("text"), F.lit(False).alias("is_train"))
    return spread(own.unionByName(held))


# ---- the array


@lru_cache(4096)
def _reachable(m: int) -> frozenset[int]:
    """Positions of an evaluation text of ``m`` words where an unchanged piece of a training text could be."""
    out = set()
    for n in range(max(LEAST_WORDS, m - EDITS), m + EDITS + 1):
        for i, (a, b) in enumerate(pieces(n, EDITS + 1)):
            out |= {a + s for s in range(-i, i + 1) if abs(m - n - s) <= EDITS - i and 0 <= a + s and b + s <= m}
    return frozenset(out)


SUFFIX = pa.schema([("cls", pa.binary()), ("n", pa.int32()), ("pos", pa.int32()), ("side", pa.int8()), ("key", pa.binary(4 * DEPTH)), ("sign", pa.string())])


def suffixes(classes: DataFrame, every: bool) -> DataFrame:
    """(cls, n, pos, side, key, sign) of the classes' suffixes of two words or more; side is 1 for training, 2 for
    evaluation, 3 for both. ``every`` is for coverage; else only those at which a piece can be, with signatures."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                texts, signs = part.column(1).to_pylist(), part.column(2)
                sides = np.array(part.column(3)).astype(np.int8)
                ws = [t.split(" ") for t in texts]
                sizes = np.array([len(w) for w in ws], np.int64)
                flat = np.array([xxhash.xxh32_intdigest(w) or 1 for one in ws for w in one] + [0] * DEPTH, np.uint32)
                starts = np.cumsum(sizes) - sizes
                if every:
                    row = np.repeat(np.arange(len(ws)), np.maximum(sizes - 1, 0))
                    pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1)
                else:
                    spots = [sorted(({a for a, _ in pieces(n, EDITS + 1)} if side & 1 else set()) | (_reachable(n) if side & 2 else set())) for n, side in zip(sizes.tolist(), sides.tolist())]
                    row = np.repeat(np.arange(len(ws)), [len(x) for x in spots])
                    pos = np.array([p for x in spots for p in x], np.int64)
                for low in range(0, len(row), 50_000):
                    r, p = row[low : low + 50_000], pos[low : low + 50_000]
                    ahead = p[:, None] + np.arange(DEPTH)
                    keys = np.where(ahead < sizes[r][:, None], flat[np.minimum(starts[r][:, None] + ahead, len(flat) - 1)], 0).astype(">u4")
                    picked = pa.array(r)
                    key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * DEPTH), len(r), [None, pa.py_buffer(keys.tobytes())])
                    sign = pa.nulls(len(r), pa.string()) if every else signs.take(picked)
                    cls = part.column(0).take(picked)
                    yield pa.RecordBatch.from_arrays([cls, pa.array(sizes[r], pa.int32()), pa.array(p, pa.int32()), pa.array(sides[r]), key.cast(pa.binary()), sign], names=SUFFIX.names)

    side = F.col("train").cast("int") + 2 * F.col("eval").cast("int")
    return spread(classes.select("cls", "text", "sign", side.alias("side"))).mapInArrow(each, "cls binary, n int, pos int, side byte, key binary, sign string")


def _keys(table: pa.Table) -> np.ndarray:
    """The sorted keys as rows of word hashes."""
    column = table.column("key").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], ">u4")[offsets[0] // 4 : offsets[-1] // 4].reshape(-1, DEPTH)


def common_prefixes(keys: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Words that each sorted suffix has in common with the one before it; ``left`` is the words each one has."""
    if not len(keys):
        return np.zeros(0, np.int64)
    same = keys[1:] == keys[:-1]
    first = np.where(same.all(axis=1), DEPTH, same.argmin(axis=1))
    return np.concatenate([[0], np.minimum(first, np.minimum(left[1:], left[:-1]))])


def _intervals(lcp: np.ndarray) -> np.ndarray:
    """For each common length L (row L) the interval that each suffix belongs to."""
    return np.stack([np.cumsum(lcp < size) for size in range(DEPTH + 1)])


MET = "kind byte, e binary, t binary, e_sign string, t_sign string, pos int"


def _rows(kind: int, e=None, t=None, e_sign=None, t_sign=None, pos=None) -> pa.RecordBatch:
    size = len(e if e is not None else t)
    fill = lambda x, type_: x if x is not None else pa.nulls(size, type_)
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int8)), fill(e, pa.binary()), fill(t, pa.binary()), fill(e_sign, pa.string()), fill(t_sign, pa.string()), fill(pos, pa.int32())], names=["kind", "e", "t", "e_sign", "t_sign", "pos"])


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _pairs_of(table: pa.Table, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of whole buckets (kind 0), and the classes that must be matched by gapped suffixes (1 and 2),
    as their pieces are shorter than ``least`` or more than ``most`` pairs are under one interval."""
    n, pos, side = (np.array(_column(table, c)).astype(np.int64) for c in ("n", "pos", "side"))
    cls, sign = _column(table, "cls"), _column(table, "sign")
    left = np.minimum(n - pos, DEPTH)
    intervals = _intervals(common_prefixes(_keys(table), left))
    wide = 3 * (int(n.max(initial=0)) + EDITS + 1)

    def told(at: np.ndarray, size: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(depth, key) of suffixes ``at`` as piece ``i`` of training texts of ``size`` words."""
        long = np.minimum((i + 1) * size // (EDITS + 1) - i * size // (EDITS + 1), DEPTH)
        return long, intervals[long, at] * wide + size * 3 + i

    train, evals, shallow = [], [], []
    own, held = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    for i in range(EDITS + 1):
        at = own[pos[own] == i * n[own] // (EDITS + 1)]
        long, key = told(at, n[at], i)
        train.append((at[long >= least], key[long >= least]))
        shallow.append((2, at[long < least]))
        for more in range(-EDITS, EDITS + 1):
            size = n[held] + more
            s = pos[held] - i * size // (EDITS + 1)
            ok = (size >= LEAST_WORDS) & (abs(s) <= i) & (abs(more + s) <= EDITS - i)
            at, size = held[ok], size[ok]
            long, key = told(at, size, i)
            ok = left[at] >= long
            evals.append((at[ok & (long >= least)], key[ok & (long >= least)]))
            shallow.append((1, at[ok & (long < least)]))
    t_at, t_key = (np.concatenate(x) for x in zip(*train))
    e_at, e_key = (np.concatenate(x) for x in zip(*evals))
    order = np.argsort(t_key, kind="stable")
    t_at, t_key = t_at[order], t_key[order]
    low, high = np.searchsorted(t_key, e_key, "left"), np.searchsorted(t_key, e_key, "right")
    some = high > low
    e_at, e_key, low, high = e_at[some], e_key[some], low[some], high[some]
    if len(e_key):
        _, which, members = np.unique(e_key, return_inverse=True, return_counts=True)
        hot = (high - low) * members[which] > most
        if hot.any():
            shallow += [(1, e_at[hot]), (2, t_at[np.isin(t_key, e_key[hot])])]
            e_at, low, high = e_at[~hot], low[~hot], high[~hot]
        count = high - low
        for a, b in _slices(count, 500_000):
            many = count[a:b]
            e = np.repeat(e_at[a:b], many)
            t = t_at[np.repeat(low[a:b], many) + np.arange(len(e)) - np.repeat(np.cumsum(many) - many, many)]
            e, t = pa.array(e), pa.array(t)
            yield _rows(0, cls.take(e), cls.take(t), sign.take(e), sign.take(t))
    for kind, at in shallow:
        if len(at):
            yield _rows(kind, **{"e" if kind == 1 else "t": cls.take(pa.array(np.unique(at)))})


def _slices(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` in sum."""
    ends = np.flatnonzero(np.diff(np.cumsum(count) // most)) + 1
    edges = [0, *ends.tolist(), len(count)]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def _covers_of(table: pa.Table, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """(kind 3) the evaluation suffixes whose interval of ``SPAN`` words holds a suffix from training."""
    n, pos, side = (np.array(_column(table, c)).astype(np.int64) for c in ("n", "pos", "side"))
    left = np.minimum(n - pos, DEPTH)
    interval = _intervals(common_prefixes(_keys(table), left))[SPAN]
    held = np.bincount(interval, weights=side & 1, minlength=int(interval.max(initial=0)) + 1) > 0
    at = np.flatnonzero((side & 2 > 0) & (left >= SPAN) & held[interval])
    if len(at):
        yield _rows(3, _column(table, "cls").take(pa.array(at)), pos=pa.array(pos[at], pa.int32()))


def _scan(rows: DataFrame, read, least: int) -> DataFrame:
    """Reads the sorted array of each partition by whole buckets of ``least`` leading words."""
    most = HOT

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size < 60_000:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            keys = _keys(table)
            same = (keys[:, :least] == keys[-1, :least]).all(axis=1)
            end = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
            if end:
                yield from read(table.slice(0, end).combine_chunks(), least, most)
            rest = table.slice(end)
            kept, size = rest.to_batches(), rest.num_rows
        if size:
            yield from read(pa.Table.from_batches(kept).combine_chunks(), least, most)

    return rows.mapInArrow(each, MET)


def _prefix(words_: int):
    return F.substring("key", 1, 4 * words_)


def array(classes: DataFrame, every: bool = False) -> DataFrame:
    """The readings of the whole array: rows of ``MET``."""
    read, out = (_covers_of if every else _pairs_of), None
    rest = suffixes(classes, every)
    for least, deeper in zip(PREFIXES, (*PREFIXES[1:], 0)):
        # Rows by prefix, by partial counts, so a hot prefix is one small row a task.
        counts = rest.groupBy(_prefix(least).alias("prefix")).agg(F.count("*").alias("rows"), F.max(F.col("side").bitwiseAND(1)).alias("own"))
        hot = cut(counts.where(F.col("rows") > CROWDED).select("prefix", "own"))
        none = hot.isEmpty()
        # Hot prefixes are broadcast, at most a row for every CROWDED suffixes: a join that shuffles by the same prefix would
        # take the place of the repartition, and adaptive execution may read its shuffle by mapper, so that buckets are cut.
        hot = F.broadcast(hot)
        cool = rest if none else rest.join(hot, _prefix(least) == F.col("prefix"), "left_anti")
        got = _scan(cool.repartition(_prefix(least)).sortWithinPartitions("key"), read, least)
        out = got if out is None else out.unionByName(got)
        if none:
            return out
        warm = rest.join(hot, _prefix(least) == F.col("prefix")).drop("prefix")
        if deeper:
            rest = warm.drop("own")
        elif every:  # whoever shares the deepest prefix shares a span
            held = warm.where((F.col("side").bitwiseAND(2) > 0) & (F.col("own") > 0) & (F.col("n") - F.col("pos") >= SPAN))
            return out.unionByName(held.select(F.lit(3).cast("byte").alias("kind"), F.col("cls").alias("e"), F.lit(None).cast("binary").alias("t"), F.lit(None).cast("string").alias("e_sign"), F.lit(None).cast("string").alias("t_sign"), "pos"))
        else:
            both = warm.select(F.explode(F.array(F.when(F.col("side").bitwiseAND(2) > 0, F.lit(1)), F.when(F.col("side").bitwiseAND(1) > 0, F.lit(2)))).alias("kind"), "cls").where("kind is not null")
            return out.unionByName(both.select(F.col("kind").cast("byte").alias("kind"), F.when(F.col("kind") == 1, F.col("cls")).alias("e"), F.when(F.col("kind") == 2, F.col("cls")).alias("t"), F.lit(None).cast("string").alias("e_sign"), F.lit(None).cast("string").alias("t_sign"), F.lit(None).cast("int").alias("pos")))
    return out


# ---- gapped suffixes, for what is hot


def _meet(train: DataFrame, evals: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Pairs of classes under the same lead whose signatures are within the allowed edits; with ``counts`` of the leads,
    the pairs of a hot one are spread over several tasks."""
    near = F.levenshtein(F.col("t.sign"), F.col("e.sign"), EDITS) >= 0
    on = F.col("e.lead") == F.col("t.lead")
    if counts is not None:
        salts = counts.where(F.col("t") * F.col("e") > HOT).select("lead", F.ceil(F.col("t") * F.col("e") / max(HOT, 1)).cast("int").alias("salts"))
        salts = salts.withColumn("salts", F.least("salts", F.lit(1_000)))
        of = lambda side: side.join(salts, "lead", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        train = of(train).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))
        evals = of(evals).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        on = on & (F.col("e.salt") == F.col("t.salt"))
    return evals.alias("e").hint("merge").join(train.alias("t"), on).where(near).select(F.col("e.cls").alias("e"), F.col("t.cls").alias("t"))


def gapped(train: DataFrame, evals: DataFrame) -> DataFrame:
    """(e, t) of classes (cls, text, sign) on both sides, by several unchanged pieces at once."""
    pairs = None
    for count in LEVELS:
        leads = _leads(count)
        t = train.select("cls", "sign", F.explode(leads("text", F.lit(True))).alias("lead"))
        e = evals.select("cls", "sign", F.explode(leads("text", F.lit(False))).alias("lead"))
        # Rows of both sides by lead, before any pair is made: partial counts, so a hot lead is one small row a task.
        both = t.select("lead", F.lit(1).alias("t"), F.lit(0).alias("e")).unionByName(e.select("lead", F.lit(0).alias("t"), F.lit(1).alias("e")))
        counts = both.groupBy("lead").agg(F.sum("t").alias("t"), F.sum("e").alias("e"))
        if count == LEVELS[-1]:
            met = _meet(t, e, counts)
            return met if pairs is None else pairs.unionByName(met)
        hot = cut(counts.where(F.col("t") * F.col("e") > HOT).select("lead"))
        if hot.isEmpty():
            met = _meet(t, e)
            return met if pairs is None else pairs.unionByName(met)
        met = _meet(t.join(hot, "lead", "left_anti"), e.join(hot, "lead", "left_anti"))
        pairs = met if pairs is None else pairs.unionByName(met)
        # A pair all of whose leads are hot has both texts in hot leads: those go on to the next level.
        on = lambda side, rows: rows.join(cut(side.join(hot, "lead", "left_semi").select("cls").distinct()), "cls", "left_semi")
        train, evals = on(t, train), on(e, evals)
    return pairs


def near_classes(classes: DataFrame) -> DataFrame:
    """(e, t): pairs of classes (evaluation, training) within the allowed edits by signature, each once."""
    near = (F.col("kind") > 0) | (F.levenshtein("t_sign", "e_sign", EDITS) >= 0)
    met = cut(array(classes).where(near).select("kind", "e", "t").distinct())
    pairs = met.where("kind = 0").select("e", "t")
    if met.where("kind = 1").isEmpty() or met.where("kind = 2").isEmpty():
        return pairs
    side = lambda kind, of: classes.where(of).join(met.where(F.col("kind") == kind).select(F.col("e" if kind == 1 else "t").alias("cls")), "cls", "left_semi").select("cls", "text", "sign")
    return pairs.unionByName(gapped(side(2, "train"), side(1, "eval"))).distinct()


def _records(intents: DataFrame, eval_queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (id, is_train, text, cls) that take part, and their classes (cls, text, train, eval, sign), both written."""
    rows = sides(intents, eval_queries).select("id", "is_train", _canonical("text").alias("text")).where("text is not null")
    # Words are cut once; what follows reads the result several times.
    rows = cut(rows.withColumn("cls", F.unhex(F.md5(F.col("text").cast("binary")))))
    classes = rows.groupBy("cls").agg(F.first("text").alias("text"), F.max("is_train").alias("train"), F.max(~F.col("is_train")).alias("eval"))
    return rows, cut(classes.withColumn("sign", _signs("text")))


def found(intents: DataFrame, eval_queries: DataFrame) -> DataFrame:
    """(first_id, second_id): all pairs of an evaluation and a training record within the allowed edits."""
    return _found(*_records(intents, eval_queries))


def _found(rows: DataFrame, classes: DataFrame) -> DataFrame:
    pairs = near_classes(classes)
    texts = classes.select("cls", "text")
    pairs = pairs.join(texts.toDF("e", "e_text"), "e").join(texts.toDF("t", "t_text"), "t")
    pairs = pairs.where(_near("e_text", "t_text")).select("e", "t")
    evals = rows.where("not is_train").select(F.col("cls").alias("e"), F.col("id").alias("e_id")).distinct()
    train = rows.where("is_train").select(F.col("cls").alias("t"), F.col("id").alias("t_id")).distinct()
    out = pairs.join(evals, "e").join(train, "t").where("e_id <> t_id")
    return out.select(F.least("e_id", "t_id").alias("first_id"), F.greatest("e_id", "t_id").alias("second_id")).distinct()


def _covered(classes: DataFrame) -> DataFrame:
    """(cls, n_words, n_covered) of the evaluation classes: words in spans of ``SPAN`` words or more that occur in training."""
    spans = array(classes, every=True).where("kind = 3").groupBy(F.col("e").alias("cls")).agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # A class's own positions, so the list is as long as the text at most. Spans overlap, so each adds up to the next start.
    reach = F.transform("at", lambda p, k: F.least(F.lit(SPAN), F.coalesce(F.get("at", k + 1) - p, F.lit(SPAN))))
    spans = spans.select("cls", F.aggregate(reach, F.lit(0), lambda s, x: s + x).alias("n_covered"))
    own = classes.where("eval").select("cls", F.size(F.split("text", " ")).alias("n_words"))
    return own.join(spans, "cls", "left").select("cls", "n_words", F.coalesce("n_covered", F.lit(0)).alias("n_covered"))


def covered(intents: DataFrame, eval_queries: DataFrame) -> DataFrame:
    """(id, n_words, n_covered) of every evaluation record of six words or more: how many of its words lie in spans of
    ``SPAN`` words or more that a training record has too. Of an id with several texts the most covered one counts."""
    return _covered_ids(*_records(intents, eval_queries))


def _covered_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    own = rows.where("not is_train").select("id", "cls").distinct().join(_covered(classes), "cls")
    best = own.groupBy("id").agg(F.max(F.struct("n_covered", "n_words")).alias("b"))
    return best.select("id", F.col("b.n_words").alias("n_words"), F.col("b.n_covered").alias("n_covered"))


def coverage(pairs: DataFrame, intents: DataFrame, eval_queries: DataFrame) -> DataFrame:
    """(split, source, n_records, n_leaked, n_links): overlaps of each evaluation split and source.

    Splits and sources compare without case and outer blanks; an absent one is the empty string.
    """
    return _by_source(_told(pairs, intents, eval_queries))


def _told(pairs: DataFrame, intents: DataFrame, eval_queries: DataFrame) -> DataFrame:
    """(id, split, source, links) of every evaluation record; links are null without a partner."""
    tidy = lambda c: F.coalesce(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))
    own = intents.select(F.col("id").cast("string").alias("id"), tidy("split").alias("split"), tidy("source").alias("source")).where("split in ('dev', 'test')")
    held = eval_queries.select(F.col("id").cast("string").alias("id"), tidy("split").alias("split"), tidy("source").alias("source"))
    records = own.unionByName(held).groupBy("id").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    ends = pairs.select(F.explode(F.array("first_id", "second_id")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    return records.join(ends, "id", "left")


def _by_source(told: DataFrame, *more: str) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return told.groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("links").alias("n_leaked"), zero("links").alias("n_links"), *map(zero, more))


def report(intents: DataFrame, eval_queries: DataFrame) -> DataFrame:
    """``coverage`` with (n_words, n_covered): the words of the records of six words or more, and those in shared spans."""
    rows, classes = _records(intents, eval_queries)
    told = _told(_found(rows, classes), intents, eval_queries).join(_covered_ids(rows, classes), "id", "left")
    return _by_source(told, "n_words", "n_covered")
