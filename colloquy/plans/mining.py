"""Batch mining of chat sessions into candidate pairs, stage by stage, and the streaming queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from colloquy.functions import text as T
from colloquy.operators import store
from colloquy.plans.registry import Registry
from colloquy.session import cut, table
from colloquy.streaming import turns as S

R = Registry()
#: Rows a side of the blocks in which questions meet centers; it bounds a task's matrices, and no result depends on it.
BLOCK = 512
#: Rounds of k-means at most, as in the reference; it ends as soon as no question changes its cluster.
ROUNDS = 100


def segmented(logs: DataFrame) -> DataFrame:
    """(session_id, specialty, pos, text, reply): question turns with the first reply among the next three turns."""
    one = logs.groupBy("session_id").agg(F.first("turns").alias("turns"), F.lower(F.trim(F.first("specialty"))).alias("specialty"))
    rows = one.select("session_id", "specialty", "turns", F.posexplode("turns").alias("pos", "t"))
    asked = rows.where((F.lower(F.trim("t.role")) == "user") & F.col("t.text").isNotNull()).where(T.is_question(F.col("t.text")))
    bots = F.filter(F.slice("turns", F.col("pos") + 2, 3), lambda x: F.lower(F.trim(x["role"])) == "bot")
    return asked.select("session_id", "specialty", "pos", F.col("t.text").alias("text"), F.coalesce(F.get(bots, F.lit(0))["text"], F.lit("")).alias("reply"))


def normalised(questions: DataFrame) -> DataFrame:
    """Scrubbed and lower-case questions; equal ones are one row with a count and their longest reply."""
    clean = questions.withColumn("clean", T.normalised(F.col("text"))).where("clean <> ''")
    return clean.groupBy("specialty", "clean").agg(F.count("*").alias("n"), F.max_by("reply", F.struct(F.length("reply"), "reply")).alias("reply"))


def weighted(rows: DataFrame) -> DataFrame:
    """``rows`` with a key of the specialty, a place i in it, and a unit vector (ids, ws) of weighted words and word pairs.

    Frequencies are those over all turns. A null specialty has a key of its own. Words are runs of letters and digits of
    any script. The place is that in alphabetical order; its window sorts keys and questions only.
    """
    key = F.coalesce(F.concat(F.lit("="), "specialty"), F.lit(""))
    rows = rows.withColumn("key", key)
    words = F.regexp_extract_all("clean", F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    terms = rows.select("key", "clean", "n", F.explode(T.word_ngrams(words, 1, 2)).alias("term")).groupBy("key", "clean", "n", F.xxhash64("term").alias("id")).agg((1 + F.log(F.count("*"))).alias("tf"))
    idf = terms.groupBy("id").agg(F.sum("n").alias("df")).join(F.broadcast(rows.agg(F.sum("n").alias("all")))).select("id", (F.log((1 + F.col("all")) / (1 + F.col("df"))) + 1).alias("idf"))
    pairs = terms.join(idf, "id").groupBy("key", "clean").agg(F.sort_array(F.collect_list(F.struct("id", (F.col("tf") * F.col("idf")).alias("w")))).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    vectors = pairs.withColumn("length", length).select("key", "clean", F.col("v.id").alias("ids"), F.transform("v", lambda x: x["w"] / F.col("length")).alias("ws"))
    places = rows.select("key", "clean").withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("clean")) - 1)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return rows.join(places, ["key", "clean"]).join(vectors, ["key", "clean"], "left").select("key", "i", "specialty", "clean", "n", "reply", empty("ids", "long"), empty("ws", "double"))


def _halved(centers: DataFrame) -> DataFrame:
    """``centers`` (key, j, ids, ws) with half their squared length."""
    return centers.withColumn("half", F.aggregate("ws", F.lit(0.0), lambda s, x: s + x * x) / 2)


def nearest(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(key, i, j): the nearest of all centers of the key; the smaller one wins ties.

    Every block of points meets every block of centers, each pair of blocks in a group of its own.
    """

    def each(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "i": [], "j": [], "far": []})
        right = right.sort_values("j")
        known = np.unique(np.concatenate([*left["ids"], np.zeros(1, np.int64)]).astype(np.int64))

        def matrix(pdf: pd.DataFrame) -> np.ndarray:
            out = np.zeros((len(pdf), len(known)))
            for r, (ids, ws) in enumerate(zip(pdf["ids"], pdf["ws"])):
                at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                both = known[at] == ids
                out[r, at[both]] = np.asarray(ws)[both]
            return out

        far = np.round(right["half"].to_numpy() - matrix(left) @ matrix(right).T, 9)
        at = far.argmin(1)
        return pd.DataFrame({"key": left["key"], "i": left["i"], "j": right["j"].to_numpy()[at], "far": far[np.arange(len(at)), at]})

    part = lambda c: F.floor(F.col(c) / BLOCK)
    grid = centers.groupBy("key").agg(F.max(part("j")).alias("cs")).join(points.groupBy("key").agg(F.max(part("i")).alias("ps")), "key")
    spans = lambda df, c, n: df.join(grid, "key").withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n))))
    left = spans(points.select("key", "i", "ids", "ws", part("i").alias("p")), "c", "cs").drop("cs", "ps")
    right = spans(centers.select("key", "j", "ids", "ws", "half", part("j").alias("c")), "p", "ps").drop("cs", "ps")
    right = right.toDF(*right.columns)  # columns of its own, as the first centers are points
    best = left.groupBy("key", "p", "c").cogroup(right.groupBy("key", "p", "c")).applyInPandas(each, "key string, i long, j long, far double")
    return best.groupBy("key", "i").agg(F.min(F.struct("far", "j"))["j"].alias("j"))


def moved(points: DataFrame, at: DataFrame, centers: DataFrame) -> DataFrame:
    """Centers as means of their turns; one without a question stays where it is."""
    own = points.join(at, ["key", "i"])
    sizes = own.groupBy("key", "j").agg(F.sum("n").alias("turns"))
    sums = own.select("key", "j", "n", F.explode(F.arrays_zip("ids", "ws")).alias("x")).groupBy("key", "j", F.col("x.ids").alias("id")).agg(F.sum(F.col("n") * F.col("x.ws")).alias("w"))
    lists = sums.groupBy("key", "j").agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("v"))
    new = sizes.join(lists, ["key", "j"], "left").select("key", "j", F.coalesce("v.id", F.array().cast("array<long>")).alias("ids1"), F.coalesce(F.transform("v", lambda x: x["w"] / F.col("turns")), F.array().cast("array<double>")).alias("ws1"))
    return _halved(centers.drop("half").join(new, ["key", "j"], "left").select("key", "j", F.coalesce("ids1", "ids").alias("ids"), F.coalesce("ws1", "ws").alias("ws")))


def clustered(rows: DataFrame) -> DataFrame:
    """(specialty, cluster, clean, n, reply, closeness): k-means over each whole specialty, a quarter as many clusters as
    distinct questions, which weigh as many turns as they have.

    The first centers are every fourth question in alphabetical order. Rounds go on until nothing moves; points, centers
    and sums stay distributed, and only the number of moves reaches the driver.
    """
    points = cut(weighted(rows))
    centers = cut(_halved(points.where("i % 4 = 0").select("key", (F.col("i") / 4).cast("long").alias("j"), "ids", "ws")))
    at = None
    for _ in range(ROUNDS):
        now = cut(nearest(points, centers))
        if at is not None and now.join(at.withColumnRenamed("j", "was"), ["key", "i"]).where("j <> was").isEmpty():
            break
        at, centers = now, cut(moved(points, now, centers))
    own = points.join(at, ["key", "i"])
    terms = own.select("key", "i", "j", F.explode(F.arrays_zip("ids", "ws")).alias("x")).select("key", "i", "j", F.col("x.ids").alias("id"), "x.ws")
    means = centers.select("key", "j", (F.sqrt(2 * F.col("half")) + 1e-9).alias("length"), F.explode(F.arrays_zip("ids", F.col("ws").alias("cs"))).alias("x")).select("key", "j", "length", F.col("x.ids").alias("id"), "x.cs")
    close = terms.join(means, ["key", "j", "id"]).groupBy("key", "i").agg(F.sum(F.col("ws") * F.col("cs") / F.col("length")).alias("closeness"))
    out = own.join(close, ["key", "i"], "left")
    return out.select("specialty", F.concat_ws("/", "key", "j").alias("cluster"), "clean", "n", "reply", F.coalesce("closeness", F.lit(0.0)).alias("closeness"))


def selected(clusters: DataFrame) -> DataFrame:
    """(specialty, cluster, question, answer, count): the question closest to its center with its reply, else the longest one."""
    best = F.max_by(F.struct("clean", "reply"), F.struct(F.round("closeness", 9), F.col("n"), "clean"))
    out = clusters.groupBy("specialty", "cluster").agg(best.alias("b"), F.max_by("reply", F.struct(F.length("reply"), "reply")).alias("longest"), F.sum("n").alias("count"))
    answer = F.when(F.trim("b.reply") != "", F.col("b.reply")).otherwise(F.col("longest"))
    return out.select("specialty", "cluster", F.col("b.clean").alias("question"), answer.alias("answer"), "count").where(F.trim("answer") != "")


def published(candidates: DataFrame) -> DataFrame:
    """Polished candidates with running ids, most frequent first."""
    rows = candidates.select("specialty", T.polished(F.col("question"), 1).alias("question"), T.polished(F.col("answer")).alias("answer"), "count", (-F.col("count")).alias("__o"))
    return store.numbered(rows, "cand", ["__o", "specialty", "question", "answer"]).drop("__o")


@R.query("""with l as (select session_id, any_value(turns) as turns from chat_logs group by session_id), u as (select session_id, unnest(turns) as t from l) select count(*) as n_questions, count(distinct session_id) as n_sessions from u
where lower(trim(t.role)) = 'user' and t.text is not null and (strpos(t.text, '?') > 0 or regexp_matches(regexp_replace(lower(t.text), '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g'), '^(what|why|how|when|where|can|should|do|does|is|are|kya|kab|kaise|kaisa|kahan) '))""")
def pipeline_segments(spark: SparkSession, d: str) -> DataFrame:
    return segmented(table(spark, d, "chat_logs")).agg(F.count("*").alias("n_questions"), F.count_distinct("session_id").alias("n_sessions"))


@R.query()
def pipeline_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All stages: segment, normalise, cluster, select, polish, publish."""
    return published(selected(clustered(normalised(segmented(table(spark, d, "chat_logs"))))))


@R.query("select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = S.drained(S.tumbling(S.stream(spark, d, "events")), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R.query("with t as (select distinct turn_id, session_id, role from chat_turns) select session_id, count(*) as n from (select distinct turn_id, session_id from chat_turns) group by session_id")
def stream_session_counts(spark: SparkSession, d: str) -> DataFrame:
    """Turns deduplicated in the stream, counted by session afterwards."""
    return S.drained(S.deduplicated(S.stream(spark, d, "chat_turns")).select("turn_id", "session_id"), "append").groupBy("session_id").agg(F.count("*").alias("n"))


@R.query("select distinct turn_id, session_id from chat_turns")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return S.drained(S.deduplicated(S.stream(spark, d, "chat_turns")).select("turn_id", "session_id"), "append")


@R.query("select session_id, count(*) as n, max_by(role, struct_pack(a := logged_at, b := turn_id)) as last_role from chat_turns where role is not null group by session_id")
def stateful_turn_count(spark: SparkSession, d: str) -> DataFrame:
    rows = S.stream(spark, d, "chat_turns").where("role is not null").select("session_id", "turn_id", "role", "logged_at")
    return S.drained(S.counted(rows), "update", ["session_id"], "n")
