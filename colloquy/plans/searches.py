"""Queries of retrieval, ranking and its evaluation.

Queries of a search are every row whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from colloquy.functions import lexicons as L
from colloquy.functions import text as T
from colloquy.operators import bags
from colloquy.operators import search as S
from colloquy.plans.registry import Registry, quoted
from colloquy.plans.texts import faqs
from colloquy.session import cut, table

R = Registry()
_STOP = quoted(L.STOPWORDS)
_TOKENS = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda z: z not in ({_STOP}))"

# Passages against documents.
_DOCS = f"""d as (select doc_id as doc, {_TOKENS("coalesce(text, '')")} as ts from documents), qs as (select item_id as q, {_TOKENS('text')} as ts from eval_passages where item_id % 20 = 0),
p as (select doc, term, count(*) as tf from (select doc, unnest(ts) as term from d) group by all), qt as (select q, term, count(*) as qtf from (select q, unnest(ts) as term from qs) group by all)"""
# Evaluation queries against question-answer pairs.
_FAQS = f"""c as (select distinct id, question, answer from faqs_cardiovascular), d as (select id as doc, question, answer, {_TOKENS("concat_ws(' ', coalesce(question, ''), coalesce(question, ''), coalesce(answer, ''))")} as ts from c),
qs as (select id as q, any_value(lower(expected_keyword)) as kw, {_TOKENS('any_value(query)')} as ts from eval_queries where query is not null and cast(right(id, 9) as bigint) % 20 = 0 group by id),
p as (select doc, term, count(*) as tf from (select doc, unnest(ts) as term from d) group by all), qt as (select q, term, count(*) as qtf from (select q, unnest(ts) as term from qs) group by all)"""
_BM25 = """ln_ as (select doc, sum(tf) as len from p group by doc), nn as (select (select count(*) from d) as n, (select sum(tf) from p) / (select count(*) from d) as avgdl), df as (select term, count(*) as df from p group by term),
bm as (select q, p.doc, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) as score from qt join p using (term) join df using (term) join ln_ on p.doc = ln_.doc, nn group by q, p.doc)"""
_TFIDF = """dw0 as (select doc, p.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as r from p join df using (term), nn), dw as (select doc, term, r / (sqrt(sum(r * r) over (partition by doc)) + 1e-9) as w from dw0),
qw0 as (select q, qt.term, (1 + ln(qtf)) * (ln((1 + n) / (1 + df)) + 1) as r from qt join df using (term), nn), qw as (select q, term, r / (sqrt(sum(r * r) over (partition by q)) + 1e-9) as w from qw0),
tw as (select q, doc, sum(qw.w * dw.w) as score from qw join dw using (term) group by q, doc)"""
_HYBRID = "bx as (select q, max(score) as top from bm group by q), hy as (select q, doc, sum(s) as score from (select q, doc, 0.65 * score as s from tw union all select q, doc, 0.35 * case when top > 0 then score / (top + 1e-9) else score end from bm join bx using (q)) group by q, doc)"
_RANK = lambda of, k: f"r as (select *, row_number() over (partition by q order by score desc, doc) as rank from {of} qualify rank <= {k})"


def _passages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return docs, cut(S.postings(docs, "doc", T.tokens(F.col("text")))), _passage_terms(spark, d)


def _passage_terms(spark: SparkSession, d: str) -> DataFrame:
    """(q, term, qtf) of the passages whose number is divisible by 20."""
    return S.postings(table(spark, d, "eval_passages").where("item_id % 20 = 0"), "item_id", T.tokens(F.col("text")), "q", "qtf").drop("len")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """(q, query, kw): evaluation queries whose number is divisible by 20."""
    rows = table(spark, d, "eval_queries").where("query is not null and cast(right(id, 9) as bigint) % 20 = 0")
    return rows.groupBy(F.col("id").alias("q")).agg(F.first("query").alias("query"), F.first(F.lower("expected_keyword")).alias("kw"))


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = faqs(spark, d).withColumnRenamed("id", "doc")
    post = cut(S.postings(docs, "doc", T.tokens(T.indexed(F.col("question"), F.col("answer")))))
    asked = _questions(spark, d)
    return docs, post, asked, cut(S.postings(asked, "q", T.tokens(F.col("query")), "q", "qtf").drop("len"))


def _word_cosine(docs: DataFrame, post: DataFrame, queries: DataFrame) -> DataFrame:
    n = docs.agg(F.count("*").alias("n"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return S.cosine(S.tfidf(queries, n, "q", "qtf", df), S.tfidf(post, n, df=df))


def _best(spark: SparkSession, d: str, variants: dict, k: int) -> tuple[DataFrame, bags.Corpus, DataFrame, DataFrame]:
    """(question-answer pairs, their bags, evaluation queries, the ``k`` best pairs of each query by each variant)."""
    docs = faqs(spark, d).withColumnRenamed("id", "doc")
    corpus = bags.Corpus(bags.documents(docs, "doc", T.tokens(T.indexed(F.col("question"), F.col("answer")))))
    asked = cut(_questions(spark, d))
    return docs, corpus, asked, bags.ranked(corpus, asked.select("q", bags.bag(T.tokens(F.col("query"))).alias("bag")), variants, k)


def _rounded(ranked: DataFrame) -> DataFrame:
    return ranked.select("q", "doc", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@R.query(f"with {_DOCS}, {_BM25}, {_RANK('(select q, doc, round(score, 9) as score from bm)', 10)} select q, doc, rank, round(score, 6) as score from r")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    queries = _passage_terms(spark, d)
    scores = S.bm25(queries, *S.sought(docs, "doc", T.tokens(F.col("text")), queries)).withColumn("score", F.round("score", 9))
    return _rounded(S.top_k(scores, 10))


@R.query(f"with {_DOCS}, {_BM25}, {_TFIDF}, {_RANK('(select q, doc, round(score, 9) as score from tw)', 10)} select q, doc, rank, round(score, 6) as score from r")
def tfidf_word_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.top_k(_word_cosine(*_passages(spark, d)).withColumn("score", F.round("score", 9)), 10))


_GRAMS = "list_concat(list_concat(list_transform(generate_series(1, length(s) - 2), lambda i: substr(s, i, 3)), list_transform(generate_series(1, length(s) - 3), lambda i: substr(s, i, 4))), list_transform(generate_series(1, length(s) - 4), lambda i: substr(s, i, 5)))"
_CHARS = f"""c as (select distinct id, question, answer from faqs_cardiovascular), d as (select id as doc, regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9]+') as ts from c),
qs as (select id as q, regexp_extract_all(lower(any_value(query)), '[a-z0-9]+') as ts from eval_queries where query is not null and cast(right(id, 9) as bigint) % 20 = 0 group by id),
gr as (select distinct t, unnest({_GRAMS}) as term from (select t, ' ' || t || ' ' as s from (select unnest(ts) as t from d union select unnest(ts) from qs))), gc as (select t, term, count(*) as m from (select t, unnest({_GRAMS}) as term from (select t, ' ' || t || ' ' as s from (select unnest(ts) as t from d union select unnest(ts) from qs))) group by all),
p as (select doc, term, sum(m) as tf from (select doc, unnest(ts) as t from d) join gc using (t) group by all), qt as (select q, term, sum(m) as qtf from (select q, unnest(ts) as t from qs) join gc using (t) group by all)"""


@R.query(f"with {_CHARS}, {_BM25}, {_TFIDF}, {_RANK('(select q, doc, round(score, 9) as score from tw)', 5)} select q, doc, rank, round(score, 6) as score from r")
def tfidf_char_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine over character n-grams of the questions; the grams of a token are made once for each distinct token."""
    words = lambda c: T.tokens(F.col(c), False)
    corpus = bags.Corpus(bags.documents(faqs(spark, d), "id", words("question")), chars=True)
    return _rounded(bags.ranked(corpus, _questions(spark, d).select("q", bags.bag(words("query")).alias("bag")), {"word": _WORD}, 5))


#: Shares of the word cosine and of BM25.
_BLEND, _WORD = (0.65, 0.35), (1.0, 0.0)


def _blended(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The ``k`` best pairs of each query by the blend of both channels."""
    return _best(spark, d, {"blend": _BLEND}, k)[-1]


@R.query(f"with {_FAQS}, {_BM25}, {_TFIDF}, {_HYBRID}, {_RANK('(select q, doc, round(score, 9) as score from hy)', 5)} select q, doc, rank, round(score, 6) as score from r")
def hybrid_blend(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_blended(spark, d, 5))


@R.query(f"""with {_FAQS}, {_BM25}, {_TFIDF}, a as (select q, doc, row_number() over (partition by q order by round(score, 9) desc, doc) as k from bm qualify k <= 10), b as (select q, doc, row_number() over (partition by q order by round(score, 9) desc, doc) as k from tw qualify k <= 10),
u as (select q, doc, sum(1.0::double / (60 + k)) as score from (select * from a union all select * from b) group by q, doc), {_RANK('(select q, doc, round(score, 9) as score from u)', 5)} select q, doc, rank, round(score, 6) as score from r""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    both = _best(spark, d, {"bm25": bags.RAW, "word": _WORD}, 10)[-1].select("q", "doc", (1.0 / (60 + F.col("rank"))).alias("score"))
    scores = both.groupBy("q", "doc").agg(F.round(F.sum("score"), 9).alias("score"))
    return _rounded(S.top_k(scores, 5))


@R.query(f"""with {_FAQS}, {_BM25}, {_TFIDF}, {_HYBRID}, {_RANK('(select q, doc, round(score, 9) as score from hy)', 3)}, o as (select q, doc, term, tf from r join p using (doc)), on_ as (select q, count(*) as m from r group by q), od as (select q, term, count(*) as odf from o group by q, term),
w0 as (select q, doc, term, m, (1 + ln(tf)) * (ln((1 + m) / (1 + odf)) + 1) as x from o join od using (q, term) join on_ using (q)), w1 as (select q, term, m, x / (sqrt(sum(x * x) over (partition by q, doc)) + 1e-9) as w from w0),
w2 as (select q, term, sum(w) / any_value(m) as w from w1 where length(term) >= 3 group by q, term), w3 as (select q, term, row_number() over (partition by q order by round(w, 9) desc, term) as place from w2 qualify place <= 9),
w4 as (select q, term, row_number() over (partition by q order by place) as rank from w3 anti join qt using (q, term)) select q, term, rank from w4 where rank <= 3""")
def prf_expand(spark: SparkSession, d: str) -> DataFrame:
    """Terms that pseudo-relevance feedback from the top three documents adds to each query."""
    _, corpus, asked, ranked = _best(spark, d, {"blend": _BLEND}, 3)
    queries = S.postings(asked, "q", T.tokens(F.col("query")), "q", "qtf")
    return S.feedback_terms(ranked, bags.postings(corpus.docs, ranked), queries).select("q", "term", F.col("rank").cast("bigint").alias("rank"))


_HITS = f"""{_FAQS}, {_BM25}, {_TFIDF}, {_HYBRID}, {_RANK('(select q, doc, round(score, 9) as score from hy)', 5)}, h as (select r.q, min(rank) filter (coalesce(kw, '') = '' or strpos(lower(coalesce(d.question, '') || ' ' || coalesce(d.answer, '')), kw) > 0) as hit from r join d using (doc) join qs on r.q = qs.q group by r.q),
a as (select qs.q, hit from qs left join h using (q))"""


def _hits(docs: DataFrame, asked: DataFrame, ranked: DataFrame) -> DataFrame:
    """(variant, q, hit): rank of the first document that holds the expected keyword; no row if none was ranked."""
    text = F.lower(F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))))
    # Only texts that are ranked anywhere are shuffled.
    own = docs.join(S.small(ranked.select("doc").distinct()), "doc", "left_semi").select("doc", text.alias("t"))
    kw = asked.select("q", F.coalesce("kw", F.lit("")).alias("kw"))
    hit = F.min(F.when((F.col("kw") == "") | F.contains(F.col("t"), F.col("kw")), F.col("rank"))).alias("hit")
    return ranked.join(own, "doc").join(kw, "q").groupBy("variant", "q").agg(hit)


@R.query(f"with {_HITS} select count(*) as n, round(avg((hit = 1)::int::double), 6) as dummy, round(avg(coalesce((hit = 1)::int, 0)::double), 6) as p_at_1, round(avg(coalesce((hit <= 5)::int, 0)::double), 6) as recall_at_5, round(avg(coalesce(1.0::double / hit, 0)), 6) as mrr from a".replace("round(avg((hit = 1)::int::double), 6) as dummy, ", ""))
def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    docs, _, asked, ranked = _best(spark, d, {"blend": _BLEND}, 5)
    hits = asked.select("q").join(_hits(docs, asked, ranked), "q", "left")
    return hits.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce((F.col("hit") == 1).cast("double"), F.lit(0.0))), 6).alias("p_at_1"), F.round(F.avg(F.coalesce((F.col("hit") <= 5).cast("double"), F.lit(0.0))), 6).alias("recall_at_5"), F.round(F.avg(F.coalesce(1 / F.col("hit"), F.lit(0.0))), 6).alias("mrr"))


_VARIANTS = {"full": (0.65, 0.35), "word_only": (1.0, 0.0), "bm25_only": (0.0, 1.0), "even": (0.5, 0.5)}


@R.query(f"""with {_FAQS}, {_BM25}, {_TFIDF}, v(variant, a, b) as (values {", ".join(f"('{k}', {a}::double, {b}::double)" for k, (a, b) in _VARIANTS.items())}), bx as (select q, max(score) as top from bm group by q),
sc as (select q, doc, sum(tws) as tws, sum(bms) as bms from (select q, doc, score as tws, 0::double as bms from tw union all select q, doc, 0, case when top > 0 then score / (top + 1e-9) else score end from bm join bx using (q)) group by q, doc),
r as (select variant, q, doc, row_number() over (partition by variant, q order by round(a * tws + b * bms, 9) desc, doc) as rank from sc, v qualify rank <= 5),
h as (select variant, r.q, min(rank) filter (coalesce(kw, '') = '' or strpos(lower(coalesce(d.question, '') || ' ' || coalesce(d.answer, '')), kw) > 0) as hit from r join d using (doc) join qs on r.q = qs.q group by variant, r.q),
g as (select variant, qs.q, hit from v cross join qs left join h using (variant, q))
select variant, count(*) as n, round(avg(coalesce((hit = 1)::int, 0)::double), 6) as p_at_1, round(avg(coalesce(1.0::double / hit, 0)), 6) as mrr from g group by variant""")
def ablation(spark: SparkSession, d: str) -> DataFrame:
    """The channels are scored once and blended anew for each variant; the variants are four rows."""
    docs, _, asked, ranked = _best(spark, d, _VARIANTS, 5)
    hits = _hits(docs, asked, ranked)
    every = asked.select("q", F.explode(F.array(*map(F.lit, _VARIANTS))).alias("variant")).join(hits, ["variant", "q"], "left")
    return every.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce((F.col("hit") == 1).cast("double"), F.lit(0.0))), 6).alias("p_at_1"), F.round(F.avg(F.coalesce(1 / F.col("hit"), F.lit(0.0))), 6).alias("mrr"))


@R.query(f"""with {_FAQS}, s as (select q, list_distinct(ts) as a from qs), t as (select doc, list_distinct(ts) as b from d), i as (select q, doc, count(*) as both_ from (select q, unnest(a) as term from s) join (select doc, unnest(b) as term from t) using (term) group by q, doc),
j as (select q, doc, both_ / (len(a) + len(b) - both_)::double as score from i join s using (q) join t using (doc)), {_RANK('(select q, doc, round(score, 9) as score from j)', 3)} select q, doc, rank, round(score, 6) as score from r""")
def jaccard_topk(spark: SparkSession, d: str) -> DataFrame:
    """Token-set overlap of each query with all pairs, by postings of the query's terms."""
    return _rounded(_best(spark, d, {"overlap": bags.OVERLAP}, 3)[-1])


@R.query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v, label from embeddings), n as (select vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e),
s as (select a.vec_id as q, b.vec_id as doc, round(list_dot_product(a.v, b.v), 9) as score from n a, n b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by q order by score desc, doc) as rank from s qualify rank <= 5) select q, doc, rank, round(score, 6) as score from r""")
def cosine_knn(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of the query set, in blocks of matrix products."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.transform("v", lambda x: x / norm).alias("v"))
    unit = unit.withColumnRenamed("vec_id", "doc")
    return _rounded(S.nearest(unit, unit.where("doc % 20 = 0").select(F.col("doc").alias("q"), "v"), 5, itself=False))


@R.query("""with e as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), c as (select label, i, avg(x) as m from e group by label, i),
s as (select label, vec_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) as score from e join c using (label, i) group by label, vec_id) select label, vec_id, round(score, 6) as score from s qualify row_number() over (partition by label order by round(score, 9) desc, vec_id) = 1""")
def centroid_select(spark: SparkSession, d: str) -> DataFrame:
    """The member of each group that is closest to its mean vector."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    scored = e.join(e.groupBy("label", "i").agg(F.avg("x").alias("m")), ["label", "i"]).groupBy("label", "vec_id").agg((F.sum(F.col("x") * F.col("m")) / (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("m") * F.col("m"))))).alias("score"))
    order = Window.partitionBy("label").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return scored.withColumn("k", F.row_number().over(order)).where("k = 1").select("label", "vec_id", F.round("score", 6).alias("score"))


@R.query()
def mmr(spark: SparkSession, d: str) -> DataFrame:
    """Diversified top five of a pool of fifteen for each query."""
    _, corpus, _, pool = _best(spark, d, {"blend": _BLEND}, 15)
    return S.maximal_marginal(pool.select("q", "doc", "score"), bags.weighted(corpus, pool))
