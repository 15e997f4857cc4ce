"""Queries of the text operators, over whole tables. Turns delivered twice count once."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from colloquy.functions import lexicons as L
from colloquy.functions import text as T
from colloquy.plans.registry import Registry, mapped, quoted
from colloquy.session import spread, table

R = Registry()
TURNS_SQL = "t as (select distinct turn_id, session_id, specialty, role, text, logged_at from chat_turns)"
FAQ_SQL = "f as (select distinct id, question, answer from faqs_cardiovascular)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_turns").drop("received_at").distinct()


def faqs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "faqs_cardiovascular").select("id", "question", "answer").distinct()


@R.query("select lang, count(*) as n_docs, cast(sum(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) as bigint) as n_tokens from documents group by lang")
def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size(T.tokens(F.col("text"), False)).cast("bigint")).alias("n_tokens"))


@R.query(f"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents)
select term, count(*) as tf, count(distinct doc_id) as df from w where term not in ({quoted(L.STOPWORDS)}) group by term order by tf desc, term limit 50""")
def tokens_no_stopwords_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most frequent terms: a top-k report."""
    terms = spread(table(spark, d, "documents")).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    counts = terms.groupBy("term", "doc_id").count().groupBy("term").agg(F.sum("count").alias("tf"), F.count("*").alias("df"))
    return counts.orderBy(F.desc("tf"), "term").limit(50)


@R.query("with t as (select distinct id, label, text from intents) select id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), '^ +| +$', '', 'g') as key, strlen(text) as n_bytes from t where text is not null")
def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "intents").select("id", "label", "text").distinct().where("text is not null").select("id", T.dedup_key(F.col("text")).alias("key"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@R.query(f"""with {FAQ_SQL}, s as (select id, regexp_replace(coalesce(answer, ''), '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g') as a from f),
c as (select id, regexp_replace(regexp_replace(a, '[\\t\\n\\f\\r ]+', ' ', 'g'), '^ | $', '', 'g') as a from s),
p as (select id, case when a = '' then '' when regexp_matches(a, '[.!?]$') then a else a || '.' end as a from c),
x as (select id, a, list_filter(string_split(regexp_replace(a, '([.!?]) +', '\\1' || chr(31), 'g'), chr(31)), lambda z: z <> '') as parts from p)
select id, case when a = '' then '' else upper(left(array_to_string(parts[1:4], ' '), 1)) || substr(array_to_string(parts[1:4], ' '), 2) end as polished, cast(len(parts) as bigint) as n_sentences from x""")
def sentence_split_polish(spark: SparkSession, d: str) -> DataFrame:
    flat = T.strip(F.regexp_replace(F.coalesce(F.col("answer"), F.lit("")), r"\s+", " "))
    closed = F.when(flat == "", "").when(flat.rlike(r"[.!?]$"), flat).otherwise(F.concat(flat, F.lit(".")))
    return faqs(spark, d).select("id", T.polished(F.col("answer")).alias("polished"), F.size(T.sentences(closed)).cast("bigint").alias("n_sentences"))


@R.query(rf"""with {TURNS_SQL} select turn_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
'\b\d{{5}}[- ]?\d{{7}}[- ]?\d\b', '[ID]', 'g'), '\b\d{{10,13}}\b', '[PHONE]', 'g'), '\b[\w.+-]+@[\w-]+\.[\w.-]+\b', '[EMAIL]', 'g'), '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b', '[DATE]', 'g'),
'[\t\n\f\r ]+', ' ', 'g'), '^ | $', '', 'g')) as clean from t where text is not null""")
def phi_scrub(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).where("text is not null").select("turn_id", T.normalised(F.col("text")).alias("clean"))


@R.query(f"""with {TURNS_SQL} select turn_id, (strpos(text, '?') > 0 or regexp_matches(regexp_replace(lower(text), '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g'), '^({"|".join(L.QUESTION_STARTERS)}) ')) as is_question
from t where text is not null""")
def question_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).where("text is not null").select("turn_id", T.is_question(F.col("text")).alias("is_question"))


@R.query(f"""with {TURNS_SQL}, b as (select turn_id, regexp_replace(lower(text), '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g') as s from t where text is not null),
c as (select turn_id, right(s, 1) = '?' as q, regexp_replace(s, '[?.!,]+$', '') as s from b), e as (select *, regexp_extract_all(s, '[a-z0-9'']+') as w from c), g as (select *, replace(w[1], '''', '') as first from e)
select turn_id, case when len(w) = 0 then 'statement' {" ".join(f"when first = '{w}' then '{k}'" for w, k in L.WH.items())} when strpos(s, ' or ') > 0 and q then 'choice'
when first in ({quoted(L.AUXILIARIES)}) then 'yes_no' when first in ({quoted(L.ASKING)}) then 'what' when q then 'yes_no' else 'statement' end as qtype from g""")
def qtype(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).where("text is not null").select("turn_id", T.question_type(F.col("text")).alias("qtype"))


def _opens(words: list[str], gap: str) -> str:
    return "(" + " or ".join(f"s = '{w}' or starts_with(s, '{w}{gap}')" for w in words) + ")"


@R.query(f"""with {TURNS_SQL}, b as (select turn_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g'), '[?!.,]+$', ''), '[\\t\\n\\f\\r ]+', ' ', 'g') as s from t where text is not null),
e as (select *, regexp_extract_all(s, '[a-z]+') as w from b)
select turn_id, case when s = '' then 'question' when {" or ".join(f"strpos(s, {quoted([p])}) > 0" for p in L.META_PHRASES)} then 'meta' when list_has_any(w, [{quoted(L.MEDICAL_HINTS)}]) then 'question'
when len(w) <= 5 and {_opens(L.GREETINGS, " ")} then 'greeting' when len(w) <= 5 and {_opens(L.THANKS, " ")} then 'thanks' when {" or ".join(f"strpos(s, '{p}') > 0" for p in L.FRUSTRATION)} then 'frustration'
when len(w) <= 5 and {_opens(L.HELP, "")} then 'help' else 'question' end as intent from e""")
def rule_intent(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).where("text is not null").select("turn_id", T.rule_intent(F.col("text")).alias("intent"))


@R.query(rf"""with {TURNS_SQL} select turn_id, cast(case when regexp_matches(text, '(?i)\b(?:{"|".join(L.SEVERE)})\b') then 3 when regexp_matches(text, '(?i)\b(?:{"|".join(L.MODERATE)})\b') then 2
when regexp_matches(text, '(?i)\b(?:{"|".join(L.MILD)})\b') then 1 else 0 end as int) as level from t where text is not null""")
def urgency_levels(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).where("text is not null").select("turn_id", T.urgency(F.col("text")).alias("level"))


@R.query(f"""with {FAQ_SQL}, b as (select id, lower(coalesce(question, '') || ' ' || coalesce(answer, '')) as s from f),
e as (select id, [{", ".join("case when " + " or ".join(f"strpos(s, '{w}') > 0" for w in words) + f" then '{tag}' end" for tag, words in L.TAG_RULES.items())}] as x from b)
select id, coalesce(nullif(array_to_string(list_filter(x, lambda z: z is not null), ','), ''), 'general') as tags from e""")
def faq_tags(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.coalesce("question", F.lit("")), F.lit(" "), F.coalesce("answer", F.lit("")))
    return faqs(spark, d).select("id", F.array_join(T.tags(text), ",").alias("tags"))


_FLAGS_SQL = f"""{TURNS_SQL}, l as (select turn_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9'']+|[.,;:?!]'), lambda z: replace(z, '''', '')) as ts from t where text is not null),
k as (select turn_id, unnest(ts) as tok, generate_subscripts(ts, 1) as j from l),
c as (select *, case when tok in ({quoted(L.NEGATION_CUES)}) or (right(tok, 2) = 'nt' and tok <> 'isnt' and length(tok) > 3) then j end as cue, case when tok in ({quoted(L.NEGATION_BOUNDARIES)}) then j end as stop from k),
w as (select *, max(cue) over (partition by turn_id order by j rows between unbounded preceding and 1 preceding) as last, max(stop) over (partition by turn_id order by j) as bound from c),
g as (select *, coalesce(last >= j - 4 and last >= coalesce(bound, 0), false) as neg from w)"""


@R.query(f"with {_FLAGS_SQL} select turn_id, count(*) as n_tokens, cast(sum(neg::int) as bigint) as n_negated from g group by turn_id")
def negation_flags(spark: SparkSession, d: str) -> DataFrame:
    ts = T.negation_tokens(F.col("text"))
    rows = spread(turns(spark, d).where("text is not null")).select("turn_id", ts.alias("ts")).where(F.size("ts") > 0)
    flags = T.negation_flags(F.col("ts"))
    return rows.select("turn_id", F.size("ts").cast("bigint").alias("n_tokens"), F.size(F.filter(flags, lambda x: x)).cast("bigint").alias("n_negated"))


@R.query(f"""with {_FLAGS_SQL}, v(tok, val) as (values {mapped(L.POSITIVE | L.NEGATIVE)}), b(tok, boost) as (values {mapped(L.INTENSIFIERS | L.DIMINISHERS)}),
m as (select g.*, val, boost, sum(case when boost is null then 1 else 0 end) over (partition by turn_id order by j rows between unbounded preceding and 1 preceding) as run from g left join v using (tok) left join b using (tok)),
p as (select turn_id, val, neg, boost, exp(sum(ln(coalesce(boost, 1))) over (partition by turn_id, coalesce(run, 0))) as mult from m),
s as (select turn_id, sum(case when boost is null and val is not null then case when neg then -val else val end * mult else 0 end) as score from p group by turn_id)
select turn_id, round(tanh(score / 4), 6) as compound, case when round(tanh(score / 4), 9) >= 0.25 then 'positive' when round(tanh(score / 4), 9) <= -0.25 then 'negative' else 'neutral' end as label from s""")
def sentiment(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(turns(spark, d).where("text is not null")).where(F.size(T.negation_tokens(F.col("text"))) > 0)
    rows = rows.select("turn_id", T.compound(T.sentiment_score(F.col("text"))).alias("c"))
    return rows.select("turn_id", F.round("c", 6).alias("compound"), T.sentiment_label(F.round("c", 9)).alias("label"))


@R.query(r"""with x as (select distinct id, text from intents where text is not null) select id,
case when regexp_matches(text, '(?i)\b(\d+)\s*(?:times|x)\s*(?:a|per)\s*(day|week|month)\b') then regexp_extract(text, '(?i)\b(\d+)\s*(?:times|x)\s*(?:a|per)\s*(day|week|month)\b', 1) || 'x per ' || lower(regexp_extract(text, '(?i)\b(\d+)\s*(?:times|x)\s*(?:a|per)\s*(day|week|month)\b', 2)) end as frequency,
case when regexp_matches(text, '(?i)\b(\d+)\s*(minutes|minute|hours|hour|days|day|weeks|week|months|month|years|year)\b') then regexp_extract(text, '(?i)\b(\d+)\s*(minutes|minute|hours|hour|days|day|weeks|week|months|month|years|year)\b', 1) || ' ' || lower(regexp_extract(text, '(?i)\b(\d+)\s*(minutes|minute|hours|hour|days|day|weeks|week|months|month|years|year)\b', 2)) end as duration,
try_cast(nullif(regexp_extract(text, '(?i)\b(\d{1,3})\s*(?:years? old|y/o)\b', 1), '') as int) as age from x""")
def slots_regex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "intents").where("text is not null").select("id", "text").distinct().select("id", T.slots(F.col("text")).alias("s")).select("id", "s.*")


def _hits(name: str) -> str:
    words = L.SPECIALTY_KEYWORDS[name]
    single = [w for w in words if " " not in w]
    return f"len(list_intersect(w, [{quoted(single)}]))" + "".join(f" + (strpos(s, '{p}') > 0)::int" for p in words if " " in p)


@R.query(f"""with x as (select distinct id, text from intents where text is not null), e as (select id, lower(text) as s, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) as w from x),
h as (select id, {", ".join(f"{_hits(n)} as h{k}" for k, n in enumerate(L.SPECIALTY_KEYWORDS))} from e)
select id, case when greatest(h0, h1, h2) = 0 then '' when h0 >= h1 and h0 >= h2 then 'radiology' when h1 >= h2 then 'physiotherapy' else 'cardiovascular' end as specialty, cast(greatest(h0, h1, h2) as int) as hits from h""")
def specialty_router(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "intents").where("text is not null").select("id", "text").distinct().select("id", T.best_specialty(F.col("text")).alias("b"))
    return rows.select("id", F.when(F.col("b.hits") == 0, "").otherwise(F.col("b.specialty")).alias("specialty"), F.col("b.hits").alias("hits"))


@R.query(f"""with x as (select distinct id, text from intents where text is not null), e as (select id, array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') as s from x)
select id, array_to_string(list_sort(list_filter([{quoted(L.OUT_OF_SCOPE)}], lambda z: strpos(s, z) > 0)), ',') as hits from e""")
def scope_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "intents").where("text is not null").select("id", "text").distinct().select("id", F.array_join(T.out_of_scope(F.col("text")), ",").alias("hits"))


_URDU_SQL = ", ".join(f"('{w}', {k}, '{s}')" for w, v in L.ROMAN_URDU.items() for k, s in enumerate(v or [""]))


@R.query(f"""with {TURNS_SQL}, u(w, k, s) as (values {_URDU_SQL}), l as (select turn_id, text, regexp_extract_all(lower(text), '[a-z]+') as ws from t where text is not null),
p as (select turn_id, unnest(ws) as w, generate_subscripts(ws, 1) as j from l), h as (select turn_id, j, k, s from p join u using (w)),
n as (select turn_id, count(distinct j) as hits from h group by turn_id), o as (select turn_id, s, min(j * 10 + k) as ord from h where s <> '' group by turn_id, s),
a as (select turn_id, string_agg(s, ' ' order by ord) as more from o group by turn_id)
select turn_id, coalesce(hits, 0) >= 2 as known, text || coalesce(' ' || more, '') as expanded from l left join n using (turn_id) left join a using (turn_id)""")
def roman_urdu_expand(spark: SparkSession, d: str) -> DataFrame:
    return spread(turns(spark, d).where("text is not null")).select("turn_id", T.roman_urdu(F.col("text")).alias("x")).select("turn_id", "x.*")


@R.query(f"""with q as (select distinct id, query from eval_queries where query is not null), y(w, k, s) as (values {", ".join(f"('{w}', {k}, '{s}')" for w, v in L.SYNONYMS.items() for k, s in enumerate(v))}),
l as (select id, list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda z: z not in ({quoted(L.STOPWORDS)})) as ts, lower(query) as s from q),
p as (select id, unnest(ts) as w, generate_subscripts(ts, 1) as j from l), o as (select id, string_agg(y.s, ' ' order by j, k) as own from p join y using (w) group by id),
ph(w, n) as (values {", ".join(f"('{w}', {n})" for n, w in enumerate(w for w in L.SYNONYMS if " " in w))}), z as (select id, string_agg(y.s, ' ' order by n, k) as own from l, ph join y using (w) where strpos(l.s, ph.w) > 0 group by id)
select id, concat_ws(' ', nullif(array_to_string(ts, ' '), ''), o.own, z.own) as expanded from l left join o using (id) left join z using (id)""")
def synonym_expand(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_queries").where("query is not null").select("id", "query").distinct().select("id", T.expanded(F.col("query")).alias("expanded"))


@R.query(f"""with {TURNS_SQL}, b as (select turn_id, regexp_replace(regexp_replace(lower(text), '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g'), '[?!.]+$', '') as s from t where text is not null), e as (select *, regexp_extract_all(s, '[a-z0-9]+') as w from b)
select turn_id, s <> '' and ({" or ".join(f"starts_with(s, '{p}')" for p in L.FOLLOWUP_PHRASES)} or (len(w) > 0 and ((len(w) = 1 and w[1] in ({quoted(L.FOLLOWUP_STARTS + L.MORE_WORDS)})) or (len(w) <= 3 and w[1] in ({quoted(L.PRONOUNS)}))
or (len(w) <= 5 and list_has_any(w, [{quoted(L.MORE_WORDS)}]))))) as followup from e""")
def followups(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).where("text is not null").select("turn_id", T.is_followup(F.col("text")).alias("followup"))


@R.query(rf"""with {TURNS_SQL} select turn_id, regexp_replace(text, '(?i)\b(?:{"|".join(L.PRONOUNS)})\b', 'the scan', 'g') as resolved from t where text is not null""")
def pronouns_resolved(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).where("text is not null").select("turn_id", T.resolved(F.col("text"), F.lit("the scan")).alias("resolved"))


@R.query("""with w as (select distinct unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as token from faqs_cardiovascular), p as (select token, ' ' || token || ' ' as s from w),
g as (select token, unnest(list_concat(list_concat(list_transform(generate_series(1, length(s) - 2), lambda i: substr(s, i, 3)), list_transform(generate_series(1, length(s) - 3), lambda i: substr(s, i, 4))), list_transform(generate_series(1, length(s) - 4), lambda i: substr(s, i, 5)))) as gram from p)
select gram, count(*) as n_tokens from g group by gram""")
def char_grams(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens first, so the grams of a frequent word are made once."""
    words = table(spark, d, "faqs_cardiovascular").select(F.explode(T.tokens(F.col("question"), False)).alias("token")).distinct()
    return words.select(F.explode(T.char_ngrams(F.col("token"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n_tokens"))


@R.query("""with f as (select distinct id, question from faqs_cardiovascular), l as (select id, regexp_extract_all(lower(question), '[a-z0-9]+') as t from f where question is not null),
g as (select unnest(list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) as gram from l) select gram, count(*) as n from g group by gram""")
def word_grams(spark: SparkSession, d: str) -> DataFrame:
    rows = faqs(spark, d).where("question is not null").select("id", "question").distinct()
    return rows.select(F.explode(T.word_ngrams(T.tokens(F.col("question"), False), 1, 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@R.query(r"""with x as (select distinct unnest(tokens) as token from ner_examples) select token, regexp_replace(regexp_replace(regexp_replace(token, '\p{Lu}+', chr(1), 'g'), '\p{Ll}+', 'x', 'g'), '\p{Nd}+', 'd', 'g').replace(chr(1), 'X') as shape from x where token is not null""")
def word_shapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ner_examples").select(F.explode("tokens").alias("token")).where("token is not null").distinct().select("token", T.word_shape(F.col("token")).alias("shape"))
