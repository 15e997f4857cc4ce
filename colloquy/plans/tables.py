"""Queries of the store, of sessions, of dashboards and of plain relational coverage."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from colloquy.functions import text as T
from colloquy.operators import store
from colloquy.plans.registry import Registry
from colloquy.plans.texts import TURNS_SQL, turns
from colloquy.session import table

R = Registry()


@R.query("select doc_id, lang, n_chars from documents where source = 'leaflet-archive' and lang = 'en' order by n_chars desc nulls last, doc_id limit 50")
def store_find_project_sort_limit(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return store.find(df, {"source": "leaflet-archive", "lang": "en"}, ["lang", "n_chars"], "doc_id", ("n_chars", -1), 50)


@R.query("select doc_id, lang from documents where lang is distinct from 'en'")
def store_ne_missing(spark: SparkSession, d: str) -> DataFrame:
    return store.find(table(spark, d, "documents"), {"lang": {"$ne": "en"}}, ["lang"], "doc_id")


@R.query("""with f as (select distinct id, lower(trim(specialty)) as specialty, approved from faqs_cardiovascular), t as (select lower(trim(specialty)) as specialty, count(distinct turn_id) as chat_turns from chat_turns group by all),
s(specialty) as (values ('radiology'), ('physiotherapy'), ('cardiovascular')), c as (select specialty, count_if(approved) as approved, count_if(not approved) as pending, count_if(approved is null) as unknown from f group by specialty)
select s.specialty, coalesce(approved, 0)::bigint as approved, coalesce(pending, 0)::bigint as pending, coalesce(unknown, 0)::bigint as unknown, coalesce(chat_turns, 0)::bigint as chat_turns from s left join c using (specialty) left join t using (specialty)""")
def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts over a fixed list of specialties, zero where nothing is there; each source is read once."""
    tidy = F.lower(F.trim("specialty")).alias("specialty")
    f = table(spark, d, "faqs_cardiovascular").select("id", tidy, "approved").distinct()
    c = f.groupBy("specialty").agg(F.count_if("approved").alias("approved"), F.count_if(~F.col("approved")).alias("pending"), F.count_if(F.col("approved").isNull()).alias("unknown"))
    t = table(spark, d, "chat_turns").select(tidy, "turn_id").distinct().groupBy("specialty").agg(F.count("*").alias("chat_turns"))
    dims = spark.createDataFrame([(x,) for x in ("radiology", "physiotherapy", "cardiovascular")], "specialty string")
    return dims.join(c, "specialty", "left").join(t, "specialty", "left").na.fill(0)


_INTENT = "case when regexp_matches(lower(text), '^(what|why|how|when|where|who|which)\\b') then 'wh' when right(trim(text), 1) = '?' then 'asked' else 'told' end"


@R.query(f"""with {TURNS_SQL}, l as (select * from t where lower(trim(role)) = 'user' and text is not null qualify row_number() over (partition by specialty order by logged_at desc, turn_id desc) <= 200),
x as (select specialty, 'form' as dimension, {_INTENT} as label from l union all select specialty, 'length', case when length(text) < 20 then 'short' when length(text) < 60 then 'middle' else 'long' end from l union all select specialty, 'word', unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) from l),
c as (select specialty, dimension, label, count(*) as n from x group by all), r as (select *, n / max(n) over (partition by specialty, dimension)::double as share, row_number() over (partition by specialty, dimension order by n desc, label) as k from c)
select specialty, dimension, label, n, round(share, 6) as share from r where k <= 8""")
def distribution_topk(spark: SparkSession, d: str) -> DataFrame:
    """Distributions over the latest 200 user turns of each specialty: long form, counted once, top eight with shares."""
    w = Window.partitionBy("specialty").orderBy(F.desc("logged_at"), F.desc("turn_id"))
    latest = turns(spark, d).where((F.lower(F.trim("role")) == "user") & F.col("text").isNotNull()).withColumn("k", F.row_number().over(w)).where("k <= 200")
    form = F.when(F.lower("text").rlike(r"^(what|why|how|when|where|who|which)\b"), "wh").when(F.trim("text").endswith("?"), "asked").otherwise("told")
    size = F.when(F.length("text") < 20, "short").when(F.length("text") < 60, "middle").otherwise("long")
    words = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)), lambda x: F.struct(F.lit("word").alias("dimension"), x.alias("label")))
    pairs = F.concat(F.array(F.struct(F.lit("form").alias("dimension"), form.alias("label")), F.struct(F.lit("length").alias("dimension"), size.alias("label"))), words)
    counts = latest.select("specialty", F.explode(pairs).alias("p")).select("specialty", "p.*").groupBy("specialty", "dimension", "label").agg(F.count("*").alias("n"))
    v = Window.partitionBy("specialty", "dimension")
    out = counts.withColumn("share", F.round(F.col("n") / F.max("n").over(v), 6)).withColumn("k", F.row_number().over(v.orderBy(F.desc("n"), "label")))
    return out.where("k <= 8").drop("k")


@R.query("select event_type, event_id, ts, value from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as k from events) where k <= 5")
def latest_n_events(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k <= 5").select("event_type", "event_id", "ts", "value")


@R.query("select distinct id, question from faqs_cardiovascular where strpos(lower(question), 'pulse') > 0 or strpos(lower(answer), 'pulse') > 0")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "faqs_cardiovascular").where(F.lower("question").contains("pulse") | F.lower("answer").contains("pulse")).select("id", "question").distinct()


@R.query("""with i as (select distinct id, text, label from intents where text is not null) select id, text, label from i qualify row_number() over (partition by lower(regexp_replace(text, '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g')), lower(label) order by id) = 1""")
def exact_dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "intents").select("id", "text", "label").where("text is not null").distinct()
    return store.keep_first(df, F.struct(T.basic_clean(F.col("text")), F.lower("label")), [F.col("id")])


@R.query("""with a as (select distinct lower(trim(text)) as k from intents where text is not null), b as (select distinct id, query from eval_queries where query is not null) select id, query from b where lower(trim(query)) not in (select k from a)
qualify row_number() over (partition by lower(trim(query)) order by id) = 1""")
def anti_join_new_rows(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "intents").where("text is not null").select(F.lower(F.trim("text")).alias("k")).distinct()
    new = table(spark, d, "eval_queries").where("query is not null").select("id", "query").distinct().withColumn("k", F.lower(F.trim("query")))
    return store.keep_first(new.join(held, "k", "left_anti"), F.col("k"), [F.col("id")]).select("id", "query")


@R.query("""with l as (select session_id, any_value(turns) as turns from chat_logs group by session_id), u as (select session_id, generate_subscripts(turns, 1) - 1 as pos, unnest(turns) as t from l),
n as (select session_id, pos, lower(trim(t.role)) as role, coalesce(t.text, '') as text, lead(t, 1) over w as a, lead(t, 2) over w as b, lead(t, 3) over w as c from u window w as (partition by session_id order by pos))
select session_id, pos::int as pos, text, case when lower(trim(a.role)) = 'bot' then coalesce(a.text, '') when lower(trim(b.role)) = 'bot' then coalesce(b.text, '') when lower(trim(c.role)) = 'bot' then coalesce(c.text, '') else '' end as reply from n where role = 'user'""")
def turn_reply_lookahead(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn with the first reply among the next three turns; the turns are an array, so nothing is shuffled for it."""
    logs = table(spark, d, "chat_logs").groupBy("session_id").agg(F.first("turns").alias("turns"))
    rows = logs.select("session_id", "turns", F.posexplode("turns").alias("pos", "t")).where(F.lower(F.trim("t.role")) == "user")
    bots = F.filter(F.slice("turns", F.col("pos") + 2, 3), lambda x: F.lower(F.trim(x["role"])) == "bot")
    return rows.select("session_id", "pos", F.coalesce("t.text", F.lit("")).alias("text"), F.coalesce(F.get(bots, F.lit(0))["text"], F.lit("")).alias("reply"))


@R.query(f"""with {TURNS_SQL}, u as (select * from t where lower(trim(role)) = 'user' and text is not null),
l as (select turn_id, text, [lag(text, 1) over w, lag(text, 2) over w, lag(text, 3) over w] as p from u window w as (partition by session_id order by logged_at, turn_id))
select turn_id, list_filter(p, lambda z: z is not null and z <> text)[1] as previous from l""")
def previous_user_text(spark: SparkSession, d: str) -> DataFrame:
    """The latest different text among the three user turns before; the hottest session is one sorted, spilling window."""
    u = turns(spark, d).where((F.lower(F.trim("role")) == "user") & F.col("text").isNotNull())
    w = Window.partitionBy("session_id").orderBy("logged_at", "turn_id")
    before = F.filter(F.array(*[F.lag("text", k).over(w) for k in (1, 2, 3)]), lambda x: x.isNotNull())
    return u.withColumn("p", before).select("turn_id", F.get(F.filter("p", lambda x: x != F.col("text")), F.lit(0)).alias("previous"))


@R.query(f"""with {TURNS_SQL} select session_id, count(*) as n_turns, max_by(specialty, struct_pack(a := logged_at, b := turn_id)) as specialty, cast(max_by(turn_id, struct_pack(a := logged_at, b := turn_id)) as bigint) as last_turn, min(logged_at) as started from t group by session_id""")
def sessions_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the flat log without building their arrays: all partial aggregates, safe for the hot session."""
    order = F.struct("logged_at", "turn_id")
    return turns(spark, d).groupBy("session_id").agg(F.count("*").alias("n_turns"), F.max_by("specialty", order).alias("specialty"), F.max_by("turn_id", order).alias("last_turn"), F.min("logged_at").alias("started"))


@R.query(f"""with {TURNS_SQL}, n as (select *, case when lag(logged_at) over w is null or logged_at > lag(logged_at) over w + interval 30 minutes then 1 else 0 end as new from t window w as (partition by session_id order by logged_at, turn_id)),
g as (select *, sum(new) over (partition by session_id order by logged_at, turn_id) as part from n) select session_id, part::bigint as part, count(*) as n_turns, min(logged_at) as started, max(logged_at) as ended from g group by all""")
def sessions_by_gap(spark: SparkSession, d: str) -> DataFrame:
    """Sessions cut wherever nothing was said for half an hour."""
    w = Window.partitionBy("session_id").orderBy("logged_at", "turn_id")
    last = F.lag("logged_at").over(w)
    new = F.when(last.isNull() | (F.col("logged_at") > last + F.expr("interval 30 minutes")), 1).otherwise(0)
    parts = turns(spark, d).withColumn("new", new).withColumn("part", F.sum("new").over(w))
    return parts.groupBy("session_id", "part").agg(F.count("*").alias("n_turns"), F.min("logged_at").alias("started"), F.max("logged_at").alias("ended"))


@R.query(f"""with {TURNS_SQL}, h as (select session_id, count(*) as n from t group by session_id) select distinct f.id, f.specialty as specialty, case when f.id = c.id then 'changed' else f.question end as question, coalesce(c.n, 0)::bigint as used
from (select distinct id, specialty, question from faqs_cardiovascular) f left join (select id, count(*) as n from (select distinct id, question from faqs_cardiovascular where approved) group by id) c using (id)""")
def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "faqs_cardiovascular")
    base = f.select("id", "specialty", "question").distinct().withColumn("used", F.lit(0).cast("bigint"))
    changes = f.where("approved").select("id", "question").distinct().groupBy("id").agg(F.count("*").alias("used")).withColumn("question", F.lit("changed"))
    return store.upsert(base, changes, ["id"], add=("used",)).distinct()


@R.query("""with x as (select distinct id, tags, entities, text from ner_examples where tags is not null), u as (select id, generate_subscripts(tags, 1) as j, unnest(tags) as tag from x),
b as (select id, j, tag, lag(tag) over (partition by id order by j) as prev from u), s as (select *, case when tag like 'B-%' or (tag like 'I-%' and (prev is null or prev not in ('B-' || substr(tag, 3), tag))) then 1 else 0 end as start from b),
g as (select *, sum(start) over (partition by id order by j) as run from s where tag like 'B-%' or tag like 'I-%') select id, substr(any_value(tag), 3) as label, (min(j) - 1)::int as first_token, max(j)::int as end_token from g group by id, run""")
def bio_spans(spark: SparkSession, d: str) -> DataFrame:
    """Tag sequences to spans by gaps and islands, inside each row's array."""
    x = table(spark, d, "ner_examples").select("id", "tags").where("tags is not null").distinct()
    inside = lambda t: t.startswith("B-") | t.startswith("I-")
    u = x.select("id", "tags", F.posexplode("tags").alias("j", "tag")).where(inside(F.col("tag")))
    prev = F.get("tags", F.col("j") - 1)
    kind = F.substring("tag", 3, 100)
    start = F.col("tag").startswith("B-") | F.coalesce((prev != F.concat(F.lit("B-"), kind)) & (prev != F.concat(F.lit("I-"), kind)), F.lit(True))
    w = Window.partitionBy("id").orderBy("j")
    runs = u.withColumn("run", F.sum(start.cast("int")).over(w))
    return runs.groupBy("id", "run").agg(F.first(kind).alias("label"), F.min("j").alias("first_token"), (F.max("j") + 1).alias("end_token")).drop("run")


@R.query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by all""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@R.query("""select r_name, n_name, count(*) as n, round(sum(o_totalprice), 2) as total, grouping(r_name)::int * 2 + grouping(n_name)::int as level from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""")
def rollup_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Totals are taken by nation before the dimension tables are joined, so the rollup sees a few rows."""
    part = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    named = part.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.rollup("r_name", "n_name").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"), F.grouping_id().cast("int").alias("level"))


@R.query("select o_orderpriority, count(*) as with_late, (select count(*) from customer where c_custkey not in (select o_custkey from orders)) as customers_without from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45) group by o_orderpriority")
def semi_anti_orders(spark: SparkSession, d: str) -> DataFrame:
    orders, big = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    none = table(spark, d, "customer").join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").agg(F.count("*").alias("customers_without"))
    return orders.join(big, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("with_late")).join(F.broadcast(none))


@R.query("""with p as (select user_id, ts, event_id, value from events where event_type = (select min(event_type) from events)), v as (select * from events where event_type = (select max(event_type) from events))
select v.event_id, p.event_id as prior_id from v left join lateral (select event_id from p where p.user_id = v.user_id and p.ts <= v.ts order by p.ts desc, p.event_id desc limit 1) p on true""")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of one kind before each event of another: one union, one sort by user, no pair is made."""
    e = table(spark, d, "events")
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    rows = e.join(F.broadcast(ends)).where("event_type in (lo, hi)").withColumn("prior", F.col("event_type") == F.col("lo"))
    w = Window.partitionBy("user_id").orderBy("ts", F.desc("prior"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("prior_id", F.last(F.when(F.col("prior"), F.col("event_id")), ignorenulls=True).over(w)).where("not prior").select("event_id", "prior_id")


@R.query("(select c_nationkey as k from customer intersect select s_nationkey from supplier) except select n_nationkey from nation where n_regionkey = 1")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))
    return a.subtract(table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey"))
