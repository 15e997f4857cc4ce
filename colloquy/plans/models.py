"""Queries of language models, statistics, classifiers, taggers and graphs."""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from colloquy.functions import lexicons as L
from colloquy.functions import morph
from colloquy.functions import text as T
from colloquy.functions.lazy import arrow
from colloquy.operators import learn, search, tagging
from colloquy.plans.registry import Registry, quoted
from colloquy.plans.texts import faqs
from colloquy.session import spread, table

R = Registry()


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """(sid, toks): questions and answer sentences of the pairs, each distinct text once."""
    f = faqs(spark, d)
    texts = f.select(F.col("question").alias("s")).unionByName(f.select(F.explode(T.sentences(F.col("answer"))).alias("s"))).where("s is not null").distinct()
    return texts.select(F.col("s").alias("sid"), T.tokens(F.col("s"), False).alias("toks")).where(F.size("toks") > 0)


_SENT = """f as (select distinct id, question, answer from faqs_cardiovascular), sp as (select unnest(string_split(regexp_replace(answer, '([.!?])[\\t\\n\\f\\r ]+', '\\1' || chr(31), 'g'), chr(31))) as s from f where answer is not null),
tx as (select question as s from f where question is not null union select regexp_replace(s, '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g') from sp where regexp_replace(s, '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g') <> ''),
tk as (select s, regexp_extract_all(lower(s), '[a-z0-9]+') as k from tx), pd as (select list_concat(list_concat(['<s>', '<s>'], k), ['</s>']) as t from tk where len(k) > 0),
g as (select t[i - 2] as a, t[i - 1] as b, t[i] as w from (select t, unnest(generate_series(3, len(t))) as i from pd)), tri as (select a, b, w, count(*) as n from g group by all),
bi as (select b, w, sum(n) as n from tri group by all union all select '<s>', '<s>', sum(n) from tri where a = '<s>' and b = '<s>')"""
_KN = """uni as (select w, count(*) as l from bi group by w), ty as (select count(*) as types from bi), cx as (select b, sum(n) as total, count(*) as kinds from bi group by b), sn as (select b, w, count(*) as cont from tri group by b, w), t3 as (select a, b, sum(n) as total3, count(*) as kinds3 from tri group by a, b)"""
_P = """with_p as (select x.*, case when total3 is null then p2 else greatest(coalesce(n3, 0) - 0.8, 0) / total3 + 0.8 * kinds3 / total3 * p2 end as p from (select y.*, case when total is null then p1 else greatest(coalesce(cont, 0) - 0.5, 0) / total + 0.5 * kinds / total * p1 end as p2 from
(select h.*, greatest(1, coalesce(l, 0))::double / types as p1, total::double as total, kinds, cont, total3::double as total3, kinds3, tri.n as n3 from h left join uni on h.w = uni.w cross join ty left join cx on h.b = cx.b left join sn on h.b = sn.b and h.w = sn.w left join t3 on h.a = t3.a and h.b = t3.b left join tri on h.a = tri.a and h.b = tri.b and h.w = tri.w) y) x)"""


@R.query(f"with {_SENT} select a, b, w, n from tri")
def ngram_lm_counts(spark: SparkSession, d: str) -> DataFrame:
    return learn.gram_counts(learn.grams(_sentences(spark, d)))[0]


@R.query(f"""with {_SENT}, {_KN}, q as (select id, regexp_extract_all(lower(query), '[a-z0-9]+') as k from (select distinct id, query from eval_queries where query is not null)),
qp as (select id, len(k) as m, list_concat(list_concat(['<s>', '<s>'], k), ['</s>']) as t from q where len(k) > 0), h as (select id, m, t[i - 2] as a, t[i - 1] as b, t[i] as w from (select id, m, t, unnest(generate_series(3, len(t))) as i from qp)), {_P}
select id, round(exp(-sum(ln(greatest(1e-9, p))) / any_value(m)), 4) as perplexity from with_p group by id""")
def lm_perplexity(spark: SparkSession, d: str) -> DataFrame:
    model = learn.KneserNey(*learn.gram_counts(learn.grams(_sentences(spark, d))))
    q = table(spark, d, "eval_queries").where("query is not null").select("id", "query").distinct().select("id", T.tokens(F.col("query"), False).alias("k")).where(F.size("k") > 0)
    t = F.concat(F.array(F.lit("<s>"), F.lit("<s>")), "k", F.array(F.lit("</s>")))
    rows = q.select("id", F.size("k").alias("m"), t.alias("t")).select("id", "m", F.explode(F.transform(F.sequence(F.lit(2), F.size("t") - 1), lambda i: F.struct(F.get("t", i - 2).alias("a"), F.get("t", i - 1).alias("b"), F.get("t", i).alias("w")))).alias("g")).select("id", "m", "g.*")
    return model.p(rows).groupBy("id").agg(F.round(F.exp(-F.sum(F.log(F.greatest(F.lit(1e-9), "p"))) / F.first("m")), 4).alias("perplexity"))


@R.query(f"""with {_SENT}, {_KN}, top as (select a, b, sum(n) as m from tri where b not in ('<s>', '</s>') group by a, b order by m desc, a, b limit 20), h as (select tri.a, tri.b, tri.w from tri join top using (a, b) where tri.w not in ('<s>', '</s>')), {_P},
r as (select a, b, w, round(p, 9) as p, row_number() over (partition by a, b order by round(p, 9) desc, w) as k from with_p) select a, b, w, round(p, 6) as p, k from r where k <= 5""")
def autocomplete(spark: SparkSession, d: str) -> DataFrame:
    """The five likeliest next words after each of the twenty commonest contexts."""
    tri, bi = learn.gram_counts(learn.grams(_sentences(spark, d)))
    top = tri.where(~F.col("b").isin("<s>", "</s>")).groupBy("a", "b").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "a", "b").limit(20).select("a", "b")
    rows = tri.join(F.broadcast(top), ["a", "b"]).where(~F.col("w").isin("<s>", "</s>")).select("a", "b", "w")
    w = Window.partitionBy("a", "b").orderBy(F.desc("p"), "w")
    return learn.KneserNey(tri, bi).p(rows).withColumn("p", F.round("p", 9)).withColumn("k", F.row_number().over(w).cast("bigint")).where("k <= 5").select("a", "b", "w", F.round("p", 6).alias("p"), "k")


@R.query(f"""with {_SENT}, {_KN}, h as (select a, b, w from (select a, b, w from tri union select c.a, c.b, bi.w from (select distinct a, b from tri) c join bi on c.b = bi.b) where w not in ('<s>', '</s>')), {_P},
r as (select a, b, w, round(p, 9) as p, row_number() over (partition by a, b order by round(p, 9) desc, w) as k from with_p) select a, b, w, round(p, 6) as p, k from r where k <= 5""")
def autocomplete_all(spark: SparkSession, d: str) -> DataFrame:
    """The five likeliest next words after every context; those seen after its last word compete too, as in the reference."""
    tri, bi = learn.gram_counts(learn.grams(_sentences(spark, d)))
    after = tri.select("a", "b").distinct().join(bi.select("b", "w"), "b").select("a", "b", "w")
    rows = tri.select("a", "b", "w").unionByName(after).distinct().where(~F.col("w").isin("<s>", "</s>"))
    w = Window.partitionBy("a", "b").orderBy(F.desc("p"), "w")
    return learn.KneserNey(tri, bi).p(rows).withColumn("p", F.round("p", 9)).withColumn("k", F.row_number().over(w).cast("bigint")).where("k <= 5").select("a", "b", "w", F.round("p", 6).alias("p"), "k")


@R.query(f"""with e as (select item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda z: z not in ({quoted(L.STOPWORDS)})) as t from eval_passages), u as (select item_id, generate_subscripts(t, 1) as i, unnest(t) as tok from e),
o as (select a.tok as x, b.tok as y, count(*) as n from u a join u b on a.item_id = b.item_id and b.i - a.i between 1 and 4 group by all), s as (select x, y, sum(n) as n from (select x, y, n from o union all select y, x, n from o) group by all),
m as (select x, sum(n) as r from s group by x), t as (select sum(n) as t from s), v as (select s.x, s.y, greatest(0, ln(n * t::double / (m.r * k.r / t::double))) as v from s join m on s.x = m.x join m k on s.y = k.x, t) select x, y, round(v, 6) as v from v where v > 0""")
def ppmi(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "eval_passages")).select(F.col("item_id").alias("doc"), T.tokens(F.col("text")).alias("toks"))
    return learn.ppmi(learn.cooccurrence(docs)).select("x", "y", F.round("v", 6).alias("v"))


_TAGGED = "x as (select distinct id, tokens, tags from ner_examples where len(tokens) = len(tags)), u as (select id, generate_subscripts(tokens, 1) as pos, lower(unnest(tokens)) as token, unnest(tags) as tag from x), k as (select * from u where token is not null and tag is not null)"


@R.query(f"with {_TAGGED}, p as (select *, coalesce(lag(tag) over (partition by id order by pos), '<s>') as prev from k) select 'move' as kind, prev as a, tag as b, count(*) as n from p group by all union all select 'emit', token, tag, count(*) from k group by all")
def hmm_counts(spark: SparkSession, d: str) -> DataFrame:
    k = tagging.tagged_tokens(table(spark, d, "ner_examples"))
    moves = tagging.transitions(k).select(F.lit("move").alias("kind"), F.col("prev").alias("a"), F.col("tag").alias("b"), "n")
    return moves.unionByName(tagging.emissions(k).select(F.lit("emit").alias("kind"), F.col("token").alias("a"), F.col("tag").alias("b"), "n"))


_SPLIT = """i as (select distinct id, text, lower(trim(label)) as label from intents where text is not null and label is not null), o as (select *, row_number() over (partition by label order by md5(id), id) as k, count(*) over (partition by label) as m from i), s as (select id, text, label, k <= greatest(1, floor(m * 0.2 + 0.5)) as held from o)"""


def _split(spark: SparkSession, d: str) -> DataFrame:
    """(id, text, label, held): a stratified fifth of each label is held out, by hash order.

    The place of a row within its label comes from a window over hashes; only ids and hashes are sorted, texts join back.
    """
    i = table(spark, d, "intents").where("text is not null and label is not null").select("id", "text", F.lower(F.trim("label")).alias("label")).distinct()
    w = Window.partitionBy("label")
    places = i.select("id", "label").withColumn("k", F.row_number().over(w.orderBy(F.md5(F.col("id").cast("binary")), "id"))).withColumn("m", F.count("*").over(w))
    return i.join(places, ["id", "label"]).select("id", "text", "label", (F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("m") * 0.2 + 0.5))).alias("held"))


@R.query(f"with {_SPLIT} select id, label, held from s")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("id", "label", "held")


_NB = f"""{_SPLIT}, tt as (select id as doc, label, held, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda z: z not in ({quoted(L.STOPWORDS)}))) as term from s), tf as (select doc, label, held, term, 1 + ln(count(*)) as x from tt group by all),
tr as (select * from tf where not held), pr as (select label, ln(count(distinct doc) / (select count(distinct doc) from tr)::double + 1e-12) as prior from tr group by label), sm as (select label, term, sum(x) as s from tr group by all),
vv as (select count(distinct term) as v from tr), bs as (select label, sum(s) + 0.3 * any_value(v) as den from sm, vv group by label), vc as (select distinct term from tr),
ev as (select distinct doc, label as truth from tf where held), ts as (select t.* from tf t join vc using (term) where held), sc as (select e.doc, e.truth, p.label, p.prior + coalesce(sum(ts.x * ln((coalesce(sm.s, 0) + 0.3) / b.den)), 0) as score from ev e cross join pr p join bs b on p.label = b.label
left join ts on ts.doc = e.doc left join sm on sm.label = p.label and sm.term = ts.term group by e.doc, e.truth, p.label, p.prior), pd as (select doc, truth, label as guess, score from sc qualify row_number() over (partition by doc order by round(score, 9) desc, label) = 1)"""


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    s = _split(spark, d)
    tf = s.select(F.col("id").alias("doc"), "label", "held", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc", "label", "held", "term").agg((1 + F.log(F.count("*"))).alias("x"))
    train, test = tf.where("not held"), tf.where("held")
    guess = learn.bayes_predict(test.select("doc", "term", "x"), learn.bayes(train), train.select("term").distinct())
    return test.select("doc", F.col("label").alias("truth")).distinct().join(guess.select("doc", F.col("label").alias("guess"), "score"), "doc")


@R.query(f"with {_NB} select doc, truth, guess, round(score, 6) as score from pd")
def nb_predict(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d).withColumn("score", F.round("score", 6))


@R.query(f"""with {_NB}, a as (select truth as label, count(*) as support, count_if(truth = guess) as tp from pd group by truth), b as (select guess as label, count(*) as made from pd group by guess),
c as (select coalesce(a.label, b.label) as label, coalesce(support, 0)::bigint as support, case when made > 0 then coalesce(tp, 0) / made::double else 0 end as p, case when support > 0 then tp / support::double else 0 end as r from a full join b using (label))
select label, support, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from c""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    out = learn.report(_predicted(spark, d).select("truth", "guess"))
    return out.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@R.query(f"with {_NB} select truth, guess, count(*) as n from pd group by all")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(spark, d).groupBy("truth", "guess").agg(F.count("*").alias("n"))


def _lloyd_sql(k: int = 4, rounds: int = 3) -> str:
    """The same rounds as unrolled SQL."""
    dist = "round(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9)"
    parts = ["p as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings)", f"c0 as (select row_number() over (order by id) - 1 as k, v as c from p order by id limit {k})"]
    for i in range(rounds + 1):
        parts.append(f"a{i} as (select id, v, k from (select id, v, k, row_number() over (partition by id order by {dist}, k) as o from p, c{i}) where o = 1)")
        if i < rounds:
            parts.append(f"m{i} as (select k, list(m order by j) as c from (select k, j, avg(x) as m from (select k, generate_subscripts(v, 1) as j, unnest(v) as x from a{i}) group by k, j) group by k), c{i + 1} as (select c{i}.k, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} using (k))")
    return f"with {', '.join(parts)} select id, k::int as cluster from a{rounds}"


@R.query(_lloyd_sql())
def kmeans_lloyd_fixed_init(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    centers = [r["v"] for r in points.orderBy("id").limit(4).collect()]
    return learn.lloyd(points, centers)[0]


@R.query()
def textrank_keywords(spark: SparkSession, d: str) -> DataFrame:
    @arrow("array<struct<word:string,score:double>>")
    def rank(lists: list) -> list:
        return [[{"word": w, "score": s} for w, s in learn.keywords([t for t in ts if len(t) > 2])] for ts in lists]

    return spread(table(spark, d, "eval_passages")).select("item_id", F.explode(rank(T.tokens(F.col("text")))).alias("k")).select("item_id", "k.*")


@R.query()
def extractive_summary(spark: SparkSession, d: str) -> DataFrame:
    @arrow("string")
    def summary(lists: list) -> list:
        words = lambda s: tagging._WORD.findall(s.lower())
        return [" ".join(ss[i] for i in learn.central([words(s) for s in ss])) for ss in lists]

    return spread(faqs(spark, d)).select("id", summary(T.sentences(F.col("answer"))).alias("summary"))


@R.query()
def dict_ner(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "intents").where("text is not null").select("id", "text").distinct()
    return spread(texts).select("id", F.explode(tagging.entities_of("text")).alias("e")).select("id", "e.*")


@R.query()
def lemma_stem(spark: SparkSession, d: str) -> DataFrame:
    """Lemmas, stems and canonical forms of the distinct tokens of the pairs."""
    words = morph.lemma_of(_sentences(spark, d).select(F.explode("toks").alias("token")).distinct())
    return words.select("token", "lemma", morph.stems("token").alias("stem"), morph.canonicals("token").alias("canonical"))


@R.query()
def spell_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Corrections of query tokens that the corpus lacks: within two edits, the most frequent, then the first.

    Candidates share a deletion neighbour (the token with up to one character left out at each side, twice), so no
    token meets the whole vocabulary.
    """
    vocabulary = _sentences(spark, d).select(F.explode("toks").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.length("word") >= 2)
    asked = table(spark, d, "eval_queries").where("query is not null").select(F.explode(T.tokens(F.col("query"))).alias("token")).distinct().where(F.length("token") >= 4)
    unknown = asked.join(vocabulary.select(F.col("word").alias("token")), "token", "left_anti")

    @arrow("array<string>")
    def neighbours(words: list) -> list:
        out = []
        for w in words:
            once = {w[:i] + w[i + 1 :] for i in range(len(w))}
            out.append(sorted({w} | once | {v[:i] + v[i + 1 :] for v in once for i in range(len(v))}))
        return out

    left = unknown.select("token", F.explode(neighbours("token")).alias("key"))
    right = vocabulary.select("word", "n", F.explode(neighbours("word")).alias("key"))
    near = left.join(right, "key").select("token", "word", "n").distinct().withColumn("edits", morph.distances("token", "word")).where("edits <= 2")
    w = Window.partitionBy("token").orderBy("edits", F.desc("n"), "word")
    return near.withColumn("k", F.row_number().over(w)).where("k = 1").select("token", "word", "edits")


@R.query()
def noun_verb_phrases(spark: SparkSession, d: str) -> DataFrame:
    return spread(faqs(spark, d)).select("id", F.explode(tagging.phrases_of("answer")).alias("p")).select("id", "p.*")


@R.query()
def svo_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples of the answers' sentences, over the tags of a hidden Markov tagger that learnt from lexicon tags."""
    cut_ = F.transform(T.sentences(F.col("answer")), lambda s, k: F.struct(k.alias("no"), s.alias("sentence")))
    rows = spread(faqs(spark, d)).select("id", F.explode(cut_).alias("x")).select(F.struct("id", "x.no", "x.sentence").alias("key"), T.tokens(F.col("x.sentence"), False).alias("tokens"))
    rows = rows.where((F.length("key.sentence") >= 6) & (F.size("tokens") >= 3)).withColumnRenamed("key", "id")
    found = tagging.triples_of(tagging.silver_tagged(rows, *tagging.silver_markov(_sentences(spark, d))))
    negated = F.exists(T.negation_flags(T.negation_tokens(F.col("sentence"))), lambda x: x)
    found = found.withColumnRenamed("id", "key").select("key.id", "subject", "predicate", "object", "key.sentence")
    return found.withColumn("negated", negated)


@R.query()
def hmm_pos(spark: SparkSession, d: str) -> DataFrame:
    """Parts of speech of all distinct sentences by the hidden Markov tagger."""
    texts = _sentences(spark, d)
    return tagging.silver_tagged(texts.select(F.col("sid").alias("id"), F.col("toks").alias("tokens")), *tagging.silver_markov(texts)).select(F.col("id").alias("sentence"), "tags")


@R.query()
def triple_counts(spark: SparkSession, d: str) -> DataFrame:
    """(specialty, n): triples of the answers by specialty."""
    kinds = table(spark, d, "faqs_cardiovascular").groupBy("id").agg(F.min("specialty").alias("specialty"))
    return svo_triples(spark, d).join(kinds, "id").groupBy("specialty").agg(F.count("*").alias("n"))


@R.query()
def hmm_decode(spark: SparkSession, d: str) -> DataFrame:
    """Tags of all token lists by the hidden Markov tagger."""
    rows = table(spark, d, "ner_examples").where("tokens is not null and size(tokens) > 0").select("id", "tokens").distinct()
    model, by_token = tagging.hidden_markov(tagging.tagged_tokens(table(spark, d, "ner_examples")))

    @arrow("array<string>")
    def decode(lists: list) -> list:
        return [model.decode([dict(x) for x in counts]) for counts in lists]

    return spread(tagging.with_counts(rows, by_token)).select("id", decode("counts").alias("tags"))


@R.query()
def perceptron_ner(spark: SparkSession, d: str) -> DataFrame:
    """Tags of all token lists by the averaged structured perceptron."""
    examples = table(spark, d, "ner_examples")
    model = tagging.fit_perceptron(examples)

    @arrow("array<string>")
    def decode(lists: list) -> list:
        return [model.decode([(t or "").lower() for t in ts]) for ts in lists]

    return spread(examples.where("tokens is not null and size(tokens) > 0").select("id", "tokens").distinct()).select("id", decode("tokens").alias("tags"))


@R.query()
def lsa_topics(spark: SparkSession, d: str) -> DataFrame:
    """Six heaviest terms of each latent topic; signs are fixed by the largest loading."""
    docs = faqs(spark, d).withColumnRenamed("id", "doc")
    post = search.postings(docs, "doc", T.tokens(T.indexed(F.col("question"), F.col("answer"))))
    loadings, _ = learn.latent(search.tfidf(post, docs.agg(F.count("*").alias("n"))))
    one = loadings.select("term", F.posexplode("v").alias("topic", "loading"))
    order = Window.partitionBy("topic").orderBy(F.desc(F.round("loading", 9)), "term")
    return one.withColumn("rank", F.row_number().over(order)).where("rank <= 6").select("topic", "term", "rank", "loading")


@R.query()
def byte_pair_merges(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 merges over the counts of all words of the pairs."""
    counts = _sentences(spark, d).select(F.explode("toks").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(learn.merged_pairs(counts, 200))], "step int, left string, right string")


@R.query()
def byte_pair_parts(spark: SparkSession, d: str) -> DataFrame:
    """(word, parts): all distinct words of the pairs cut by the first 200 merges."""
    words = _sentences(spark, d).select(F.explode("toks").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    merges = learn.merged_pairs(words, 200)

    @arrow("array<string>")
    def parts(batch: list) -> list:
        return learn.encoded(batch, merges)

    return spread(words).select("word", parts("word").alias("parts"))


@R.query()
def mlp_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all vectors by a small network fitted on at most 2,000 of them, chosen by hash."""
    e = table(spark, d, "embeddings").where("label is not null")
    rows = e.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2_000).select("embedding", "label").collect()
    labels = sorted({r["label"] for r in rows})
    x, y = np.array([r["embedding"] for r in rows], float), np.array([labels.index(r["label"]) for r in rows])
    model = learn.Network([x.shape[1], 64, 32, len(labels)]).fit(x, y)

    @arrow("int")
    def guess(vectors: list) -> list:
        return [labels[i] for i in model.predict(np.array(vectors, float))]

    return spread(table(spark, d, "embeddings")).select("vec_id", guess("embedding").alias("guess"))


@R.query()
def logistic_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all vectors by multinomial logistic regression, fitted in a distributed way on all labelled rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("y"))
    n = rows.count()
    model = LogisticRegression(family="multinomial", regParam=1 / (2 * max(1, n)), standardization=False, labelCol="y", maxIter=60).fit(rows.where("y is not null"))
    return model.transform(rows).select("vec_id", F.col("prediction").cast("int").alias("guess"))


@R.query()
def word_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest words of every word that the pairs have three times, by skip-gram vectors of their sentences.

    Sentences count as often as they occur, as in the reference; fitting is Spark's with one partition, its default.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    f = faqs(spark, d)
    texts = f.select(F.col("question").alias("s")).unionByName(f.select(F.explode(T.sentences(F.col("answer"))).alias("s")))
    docs = spread(texts.select(T.tokens(F.col("s")).alias("toks")).where(F.size("toks") > 0), 2)
    model = Word2Vec(vectorSize=32, windowSize=5, minCount=3, seed=1, maxIter=2, inputCol="toks", outputCol="v").fit(docs)
    return learn.neighbours(model.getVectors().select("word", vector_to_array("vector").alias("vector")))


@R.query()
def dual_encoder_topk(spark: SparkSession, d: str) -> DataFrame:
    """Answers retrieved by two towers over hashed words, trained on at most 2,000 pairs chosen by hash.

    All answers are scored, in blocks of matrix products.
    """
    import zlib

    width = 256

    def hashed(texts: list) -> np.ndarray:
        x = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            for w in tagging._WORD.findall((t or "").lower()):
                x[i, zlib.crc32(w.encode()) % width] += 1
        return x

    f = faqs(spark, d).where("question is not null and answer is not null")
    sample = f.orderBy(F.xxhash64("id"), "id").limit(2_000).collect()
    model = learn.DualEncoder(width).fit(hashed([r["question"] for r in sample]), hashed([r["answer"] for r in sample]))
    asked = table(spark, d, "eval_queries").where("query is not null and cast(right(id, 9) as bigint) % 20 = 0").groupBy("id").agg(F.first("query").alias("query"))

    @arrow("array<double>")
    def of_query(texts: list) -> list:
        return model.embed(hashed(texts), "q").tolist()

    @arrow("array<double>")
    def of_answer(texts: list) -> list:
        return model.embed(hashed(texts), "a").tolist()

    queries = asked.select(F.col("id").alias("q"), of_query("query").alias("v"))
    return search.nearest(spread(f).select(F.col("id").alias("doc"), of_answer("answer").alias("v")), queries)


@R.query()
def attention_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Mean-pooled self-attention over hashed word vectors of the passages."""
    import zlib

    @arrow("array<double>")
    def pooled(lists: list) -> list:
        out = []
        for ts in lists:
            x = np.stack([np.random.default_rng(zlib.crc32(t.encode())).normal(size=32) for t in ts]) if ts else np.zeros((0, 32))
            out.append(learn.attended(x).tolist())
        return out

    return spread(table(spark, d, "eval_passages")).select("item_id", pooled(T.tokens(F.col("text"))).alias("vector"))
