"""Queries of conversation: analysis of a message, gates on ranked answers, latent channels, held-out taggers."""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from colloquy.functions import text as T
from colloquy.functions.lazy import arrow
from colloquy.operators import chain, learn, tagging
from colloquy.operators import search as S
from colloquy.plans import searches as P
from colloquy.plans.registry import Registry
from colloquy.plans.texts import faqs
from colloquy.session import cut, spread, table

R = Registry()
_BUCKET = "case when score >= 0.18 then 'confident' when score >= 0.08 then 'best_guess' else 'none' end"
_RANKED = lambda k: f"with {P._FAQS}, {P._BM25}, {P._TFIDF}, {P._HYBRID}, {P._RANK('(select q, doc, round(score, 9) as score from hy)', k)}"


@R.query("with x as (select distinct id, query from eval_queries where query is not null) select id, list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: len(t) >= 4)[1:5] as words from x")
def topic_words(spark: SparkSession, d: str) -> DataFrame:
    """The first five words of four letters or more: a feature of the operator, not a cap."""
    rows = table(spark, d, "eval_queries").where("query is not null").select("id", "query").distinct()
    return rows.select("id", F.slice(F.filter(T.tokens(F.col("query"), False), lambda t: F.length(t) >= 4), 1, 5).alias("words"))


@R.query(f"""{_RANKED(1)} select q, doc, round(score, 6) as score, round(score / (score + 0.25), 6) as confidence, {_BUCKET} as bucket, score < 0.45 as mined, score < 0.45 as reranked, score < 0.30 as fed_back from r""")
def score_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The best answer of each query with its confidence and bucket, and which gates it opens: mining as a new question,
    learnt re-ranking, and relevance feedback."""
    top = P._blended(spark, d, 1)
    s = F.col("score")
    bucket = T.bucket(s)
    return top.select("q", "doc", F.round(s, 6).alias("score"), F.round(T.confidence(s), 6).alias("confidence"), bucket.alias("bucket"), ((bucket == "none") | (s < 0.45)).alias("mined"), (s < 0.45).alias("reranked"), (s < 0.30).alias("fed_back"))


@R.query(f"""{_RANKED(4)}, t as (select q, score as top from r where rank = 1), n as (select r.q, doc, rank, row_number() over (partition by r.q order by rank) as place from r join t using (q) where rank > 1 and top < 0.35 and score >= 0.7 * top) select q, doc, place from n where place <= 3""")
def disambiguation(spark: SparkSession, d: str) -> DataFrame:
    """Up to three alternatives of four ranked answers within 30 % of the best, where the best is weak."""
    ranked = P._blended(spark, d, 4)
    of = Window.partitionBy("q")
    near = ranked.withColumn("top", F.max("score").over(of)).where((F.col("rank") > 1) & (F.col("top") < 0.35) & (F.col("score") >= 0.7 * F.col("top")))
    return near.withColumn("place", F.row_number().over(of.orderBy("rank")).cast("bigint")).where("place <= 3").select("q", "doc", "place")


@R.query(f"{_RANKED(1)} select q, doc, round(score, 6) as score from (select q, doc, round(score, 9) as score from tw qualify row_number() over (partition by q order by round(score, 9) desc, doc) = 1) where score >= 0.6")
def near_duplicate_probe(spark: SparkSession, d: str) -> DataFrame:
    """Queries that the corpus already holds: the best cosine, if it is 0.6 or more."""
    best = P._best(spark, d, {"word": P._WORD}, 1)[-1]
    return best.where("score >= 0.6").select("q", "doc", F.round("score", 6).alias("score"))


@R.query("""with k as (select distinct lower(trim(specialty)) as specialty, lower(expected_keyword) as keyword from eval_queries where specialty is not null and coalesce(expected_keyword, '') <> ''),
f as (select distinct id, lower(trim(specialty)) as specialty, lower(coalesce(question, '') || ' ' || coalesce(answer, '')) as t from faqs_cardiovascular)
select k.specialty, keyword, min(f.id) as positive, count(distinct f.id) as candidates from k join f on k.specialty = f.specialty and strpos(f.t, keyword) > 0 group by all""")
def keyword_positives(spark: SparkSession, d: str) -> DataFrame:
    """The first pair of its specialty that holds a query's expected keyword, for each distinct keyword: each pair is
    scanned once for all keywords of its specialty, which are few, as they are distinct."""
    wanted = table(spark, d, "eval_queries").where("specialty is not null and coalesce(expected_keyword, '') <> ''").select(F.lower(F.trim("specialty")).alias("specialty"), F.lower("expected_keyword").alias("keyword")).distinct()
    text = F.lower(F.concat(F.coalesce("question", F.lit("")), F.lit(" "), F.coalesce("answer", F.lit(""))))
    pairs = table(spark, d, "faqs_cardiovascular").select("id", F.lower(F.trim("specialty")).alias("specialty"), text.alias("t")).distinct()
    met = pairs.join(S.small(wanted), "specialty").where(F.contains(F.col("t"), F.col("keyword")))
    return met.groupBy("specialty", "keyword").agg(F.min("id").alias("positive"), F.count_distinct("id").alias("candidates"))


_COUNTS = "(select id, w, count(*)::double as n from (select id, unnest(regexp_extract_all(lower({0}), '[a-z0-9]+')) as w from f) group by all)"


@R.query(f"""with f as (select distinct id, question, answer from faqs_cardiovascular where question is not null and answer is not null), g as {_COUNTS.format('answer')}, r as {_COUNTS.format('question')},
a as (select id, sum(n) as words, count(*) as kinds, sqrt(sum(n * n)) as norm from g group by id), b as (select id, sqrt(sum(n * n)) as norm from r group by id), c as (select id, count(*) as both_, sum(g.n * r.n) as dot from g join r using (id, w) group by id),
s as (select f.id, coalesce(words, 0) as words, coalesce(both_, 0) / greatest(1, coalesce(kinds, 0))::double as overlap, coalesce(dot / (a.norm * b.norm), 0) as cosine from f left join a using (id) left join b using (id) left join c using (id))
select id, round(overlap, 6) as overlap, round(cosine, 6) as cosine, case when words < 6 then 'too_short' when overlap < 0.25 then 'low_overlap' when cosine < 0.30 then 'low_grounding' else 'grounded' end as verdict from s""")
def grounding_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether an answer is grounded in what was asked: its length, its share of shared words and their cosine, all from
    the two texts in one row."""
    own = lambda c: T.tokens(F.col(c), False)
    rows = faqs(spark, d).where("question is not null and answer is not null").select("id", own("answer").alias("g"), own("question").alias("r"))
    times = lambda ts, w: F.size(F.filter(ts, lambda x: x == w)).cast("double")
    kinds = rows.select("id", "g", "r", F.array_distinct("g").alias("gk"), F.array_distinct("r").alias("rk"), F.array_intersect("g", "r").alias("both"))
    norm = lambda k, ts: F.sqrt(F.aggregate(k, F.lit(0.0), lambda s, w: s + times(F.col(ts), w) * times(F.col(ts), w)))
    dot = F.aggregate("both", F.lit(0.0), lambda s, w: s + times(F.col("g"), w) * times(F.col("r"), w))
    told = kinds.select("id", F.size("g").alias("words"), (F.size("both") / F.greatest(F.lit(1), F.size("gk"))).alias("overlap"), F.coalesce(F.try_divide(dot, norm("gk", "g") * norm("rk", "r")), F.lit(0.0)).alias("cosine"))
    verdict = F.when(F.col("words") < 6, "too_short").when(F.col("overlap") < 0.25, "low_overlap").when(F.col("cosine") < 0.30, "low_grounding").otherwise("grounded")
    return told.select("id", F.round("overlap", 6).alias("overlap"), F.round("cosine", 6).alias("cosine"), verdict.alias("verdict"))


@R.query("with f as (select distinct id, lower(trim(specialty)) as specialty from faqs_cardiovascular) select coalesce(specialty, '') as specialty, count(distinct id) as n, (select count(distinct id) from f) as total from f group by 1")
def specialty_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of each specialty, and of all."""
    one = table(spark, d, "faqs_cardiovascular").select("id", F.coalesce(F.lower(F.trim("specialty")), F.lit("")).alias("specialty")).distinct()
    total = one.agg(F.count_distinct("id").alias("total"))  # one row
    return one.groupBy("specialty").agg(F.count_distinct("id").alias("n")).join(F.broadcast(total))


# ---- a message as a whole


def _slots(entities: Column) -> list[Column]:
    first = lambda label: F.lower(F.get(F.filter(entities, _labelled(label)), F.lit(0))["text"])
    names = {"body_part": "BODY", "symptom": "SYMPTOM", "condition": "CONDITION", "drug": "DRUG", "procedure": "PROCEDURE", "person": "PERSON"}
    return [first(label).alias(name) for name, label in names.items()]


@R.query()
def entity_slots(spark: SparkSession, d: str) -> DataFrame:
    """The first entity of each kind and the slots of numbers, of every distinct utterance."""
    rows = spread(table(spark, d, "intents").where("text is not null").select("id", "text").distinct()).select("id", "text", tagging.entities_of("text").alias("entities"))
    return rows.select("id", *_slots(F.col("entities")), T.slots(F.col("text")).alias("s")).select("*", "s.*").drop("s")


@R.query()
def entity_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every utterance cut into plain and entity segments, which put together give the text again."""

    @arrow("array<struct<text:string,label:string>>")
    def cut_(texts: list) -> list:
        out = []
        for text in texts:
            parts, at = [], 0
            for e in tagging.entities(text):
                parts += [{"text": text[at : e["start"]], "label": None}, {"text": text[e["start"] : e["end"]], "label": e["label"]}]
                at = e["end"]
            out.append([p for p in [*parts, {"text": text[at:], "label": None}] if p["text"]])
        return out

    rows = spread(table(spark, d, "intents").where("text is not null").select("id", "text").distinct())
    return rows.select("id", F.posexplode(cut_("text")).alias("seg_no", "s")).select("id", "seg_no", "s.text", "s.label")


def analysed(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the analysis of a text column: one projection, so what only one field needs is made once and unused
    fields are never computed."""
    t = F.coalesce(F.col(text), F.lit(""))
    score = T.compound(T.sentiment_score(t))
    level = T.urgency(t)
    rows = rows.withColumn("entities", tagging.entities_of(t)).withColumn("compound", score).withColumn("level", level)
    e = F.col("entities")
    topic = F.coalesce(*[F.lower(F.get(F.filter(e, _labelled(label)), F.lit(0))["text"]) for label in ("CONDITION", "PROCEDURE", "DRUG", "SYMPTOM", "BODY")])
    negated = F.exists(T.negation_flags(T.negation_tokens(t)), lambda x: x)
    opener = F.when(F.col("level") == 2, "noted").when((F.col("level") < 2) & (T.sentiment_label(F.col("compound")) == "negative"), "sympathy").otherwise("")
    return rows.select(
        "*", T.tokens(t, False).alias("tokens"), T.rule_intent(t).alias("intent"), T.question_type(t).alias("question_type"), T.sentiment_label(F.col("compound")).alias("sentiment"), (F.col("compound") <= -0.4).alias("distressed"),
        T.urgency_cues(t).alias("cues"), negated.alias("negated"), topic.alias("topic"), F.struct(*_slots(e)).alias("slots"), T.slots(t).alias("numbers"), opener.alias("opener"),
    )


def _labelled(label: str):
    return lambda e: e["label"] == label


@R.query()
def analysis(spark: SparkSession, d: str) -> DataFrame:
    """The analysis of every distinct evaluation query."""
    return analysed(spread(table(spark, d, "eval_queries").select("id", F.col("query").alias("text")).distinct()))


# ---- latent channels


@R.query()
def lsa_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five pairs nearest to each query in a latent space of twelve topics."""
    docs, post, _, queries = P._pairs(spark, d)
    n, df = docs.agg(F.count("*").alias("n")), post.groupBy("term").agg(F.count("*").alias("df"))
    weights = cut(S.tfidf(post, n, df=df))
    loadings, values = learn.latent(weights, powers=2)
    return P._rounded(S.nearest(learn.projected(weights, loadings, len(values)), learn.projected(S.tfidf(queries, n, "q", "qtf", df), loadings, len(values), "q")))


@R.query()
def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five pairs nearest to each query by the mean of their words' vectors, which come from positive pointwise
    information factorised to twenty-four dimensions."""
    docs, post, _, queries = P._pairs(spark, d)
    lists = docs.select(F.col("doc"), T.tokens(T.indexed(F.col("question"), F.col("answer"))).alias("toks"))
    scores = learn.ppmi(learn.cooccurrence(lists.select(F.col("doc").alias("id"), "toks")))
    loadings, values = learn.latent(scores.toDF("doc", "term", "w"), 24, 4, 2)
    root = np.sqrt(values).tolist()
    vectors = loadings.select("term", F.array(*[F.get("v", F.lit(c)) * x for c, x in enumerate(root)]).alias("v"))
    mean = lambda rows, key, tf: learn.projected(rows.select(key, "term", F.col(tf).cast("double").alias("w")), vectors, len(root), key)
    return P._rounded(S.nearest(mean(post, "doc", "tf"), mean(queries, "q", "qtf")))


# ---- taggers on held-out rows


def _chain(rows: DataFrame) -> chain.Chain:
    fitted = chain.sample(rows)
    return chain.Chain(sorted({t for _, ts in fitted for t in ts})).fit(fitted)


@R.query()
def crf_ner(spark: SparkSession, d: str) -> DataFrame:
    """Tags of all complete rows by the linear-chain field, fitted on at most 2,000 of the rows that aren't held out."""
    rows = chain.complete(table(spark, d, "ner_examples"))
    model = _chain(rows)

    @arrow("array<string>")
    def decode(lists: list) -> list:
        return [model.decode(ts) for ts in lists]

    return spread(rows).select("id", decode("tokens").alias("tags"), "held")


@R.query()
def ner_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Entity scores of three taggers on the held-out fifth; each is fitted on the rest only."""
    rows = cut(chain.complete(table(spark, d, "ner_examples")))
    field, perceptron = _chain(rows), tagging.Perceptron().fit(chain.sample(rows), 4)
    markov, by_token = tagging.hidden_markov(tagging.tagged_tokens(rows.where("not held")))

    @arrow("array<array<string>>")
    def decode(lists: list, counts: list) -> list:
        return [[field.decode(ts), perceptron.decode(ts), markov.decode([dict(x) for x in cs])] for ts, cs in zip(lists, counts)]

    held = rows.where("held").select(F.struct("id", "tags").alias("id"), "tokens")
    told = spread(tagging.with_counts(held, by_token)).withColumn("g", decode("tokens", "counts"))
    one = told.select(F.col("id")["tags"].alias("gold"), F.posexplode("g").alias("k", "guess"))
    return chain.entity_scores(one.select(F.element_at(F.array(*map(F.lit, ("crf", "perceptron", "hmm"))), F.col("k") + 1).alias("tagger"), "gold", "guess"))
