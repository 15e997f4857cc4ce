"""Text operators as pure column expressions; everything here stays inside the JVM.

Null counts as the empty string unless a docstring says otherwise. White space is what ``\\s`` matches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column

from colloquy.functions import lexicons as L


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def basic_clean(c: Column) -> Column:
    """Lower case without outer blanks."""
    return F.lower(strip(c))


def tokens(c: Column, drop_stopwords: bool = True) -> Column:
    """Runs of ASCII letters and digits of the lower-case text, in order and with repeats."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(L.STOPWORDS)) if drop_stopwords else found


def indexed(question: Column, answer: Column) -> Column:
    """The text under which a pair is indexed: its question counts twice."""
    return F.concat_ws(" ", F.coalesce(question, F.lit("")), F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit("")))


def scrub(c: Column) -> Column:
    """Placeholders for identity numbers, telephone numbers, mail addresses and dates, in this order."""
    for pattern, mark in ((r"\b\d{5}[- ]?\d{7}[- ]?\d\b", "[ID]"), (r"\b\d{10,13}\b", "[PHONE]"), (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]"), (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "[DATE]")):
        c = F.regexp_replace(c, pattern, mark)
    return c


def normalised(c: Column) -> Column:
    """Scrubbed, white space collapsed, lower case."""
    return F.lower(strip(F.regexp_replace(scrub(F.coalesce(c, F.lit(""))), r"\s+", " ")))


def smart_clean(c: Column) -> Column:
    """Typographic quotes, dashes, ellipses and hard blanks made plain; runs of blanks and of blank lines collapsed."""
    c = F.translate(F.coalesce(c, F.lit("")), "‘’“”–—\xa0", "''\"\"-- ")
    c = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("…"), F.lit("...")), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(c)


def dedup_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", ""))


def sentences(c: Column) -> Column:
    """Split behind full stops, exclamation and question marks followed by white space."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def polished(c: Column, most: int = 4) -> Column:
    """White space collapsed, a full stop at the end, at most ``most`` sentences, first letter upper case; empty stays empty."""
    flat = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    closed = F.when(flat.rlike(r"[.!?]$"), flat).otherwise(F.concat(flat, F.lit(".")))
    short = F.array_join(F.slice(sentences(closed), 1, most), " ")
    return F.when(flat == "", "").otherwise(F.concat(F.upper(F.substring(short, 1, 1)), short.substr(F.lit(2), F.length(short))))


def _windows(length: Column, n: int, piece: Callable[[Column], Column]) -> Column:
    """``piece`` of each start of a window of ``n``, none if there are fewer elements."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), length - n + 1))
    return F.when(length >= n, F.transform(starts, lambda i: piece(i))).otherwise(F.array().cast("array<string>"))


def word_ngrams(tokens_: Column, low: int, high: int) -> Column:
    """n-grams of a token array, shorter ones first, joined by blanks."""
    join = lambda n: lambda i: F.array_join(F.slice(tokens_, i, n), " ")
    return F.concat(*[_windows(F.size(tokens_), n, join(n)) for n in range(low, high + 1)])


def char_ngrams(token: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of a token padded with one blank on each side."""
    padded = F.concat(F.lit(" "), token, F.lit(" "))
    part = lambda n: lambda i: padded.substr(i, F.lit(n))
    return F.concat(*[_windows(F.length(padded), n, part(n)) for n in range(low, high + 1)])


def word_shape(c: Column) -> Column:
    """X for capitals, x for small letters, d for digits, other characters as they are; runs collapsed."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{Lu}+", "\x01"), r"\p{Ll}+", "x"), r"\p{Nd}+", "d")
    return F.replace(c, F.lit("\x01"), F.lit("X"))


def is_question(c: Column) -> Column:
    t = basic_clean(c)
    return t.contains("?") | t.rlike("^(" + "|".join(L.QUESTION_STARTERS) + ") ")


def question_type(c: Column) -> Column:
    """what, why, how, when, where, who, which, choice, yes_no or statement."""
    t = basic_clean(c)
    marked, bare = t.endswith("?"), F.regexp_replace(t, r"[?.!,]+$", "")
    found = F.regexp_extract_all(bare, F.lit("[a-z0-9']+"), F.lit(0))
    first = F.replace(F.get(found, F.lit(0)), F.lit("'"), F.lit(""))
    out = F.when(F.size(found) == 0, "statement")
    for word, kind in L.WH.items():
        out = out.when(first == word, kind)
    return out.when(bare.contains(" or ") & marked, "choice").when(first.isin(L.AUXILIARIES), "yes_no").when(first.isin(L.ASKING), "what").when(marked, "yes_no").otherwise("statement")


def rule_intent(c: Column, product: str | None = None) -> Column:
    """meta, question, greeting, thanks, frustration or help, by ordered rules; asking what ``product`` is counts as meta."""
    meta = [*L.META_PHRASES, *(f"{what} {product.lower()}" for what in ("what is", "what's", "whats") if product)]
    t = F.regexp_replace(F.regexp_replace(basic_clean(c), r"[?!.,]+$", ""), r"\s+", " ")
    found = F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0))
    short = F.size(found) <= 5
    opens = lambda words, gap: reduce(lambda a, b: a | b, [(t == w) | t.startswith(w + gap) for w in words])
    has = lambda words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    return (
        F.when(t == "", "question").when(has(meta), "meta").when(F.arrays_overlap(found, F.array(*map(F.lit, L.MEDICAL_HINTS))), "question")
        .when(short & opens(L.GREETINGS, " "), "greeting").when(short & opens(L.THANKS, " "), "thanks").when(has(L.FRUSTRATION), "frustration").when(short & opens(L.HELP, ""), "help").otherwise("question")
    )


def _bordered(pattern: str) -> str:
    return rf"(?i)\b(?:{pattern})\b"


def urgency(c: Column) -> Column:
    """3 for a severe phrase, 2 for a moderate, 1 for a mild one, else 0."""
    t = F.coalesce(c, F.lit(""))
    return F.when(t.rlike(_bordered("|".join(L.SEVERE))), 3).when(t.rlike(_bordered("|".join(L.MODERATE))), 2).when(t.rlike(_bordered("|".join(L.MILD))), 1).otherwise(0)


def urgency_cues(c: Column) -> Column:
    """The matched phrases by tier; severe ones hide the lower tiers."""
    t = F.coalesce(c, F.lit(""))
    found = lambda patterns: F.filter(F.array(*[F.regexp_extract(t, _bordered(p), 0) for p in patterns]), lambda x: x != "")
    severe = found(L.SEVERE)
    return F.when(F.size(severe) > 0, severe).otherwise(F.concat(found(L.MODERATE), found(L.MILD)))


def tags(c: Column) -> Column:
    """Coarse tags by substrings, in the order of the rules; ``general`` if none."""
    t = F.lower(F.coalesce(c, F.lit("")))
    found = F.filter(F.array(*[F.when(reduce(lambda a, b: a | b, [t.contains(w) for w in words]), F.lit(tag)) for tag, words in L.TAG_RULES.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("general"))).otherwise(found)


def specialty_hits(c: Column) -> Column:
    """array<struct<hits,order,specialty>>: how many keywords of each specialty a text holds."""
    t = F.lower(F.coalesce(c, F.lit("")))
    found = F.array_distinct(F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0)))
    out = []
    for k, (name, words) in enumerate(L.SPECIALTY_KEYWORDS.items()):
        single = F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in words if " " not in w])))
        phrases = [t.contains(w).cast("int") for w in words if " " in w]
        out.append(F.struct(reduce(lambda a, b: a + b, phrases, single).alias("hits"), F.lit(-k).alias("rank"), F.lit(name).alias("specialty")))
    return F.array(*out)


def best_specialty(c: Column) -> Column:
    """struct<hits,rank,specialty> with most hits; the first specialty wins ties; hits may be 0."""
    return F.array_max(specialty_hits(c))


def out_of_scope(c: Column) -> Column:
    """The out-of-scope words that occur in any token of the text, sorted."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    blob = F.array_join(found, " ")
    return F.array_sort(F.filter(F.array(*map(F.lit, L.OUT_OF_SCOPE)), lambda w: F.contains(blob, w)))


def negation_tokens(c: Column) -> Column:
    """Lower-case words without apostrophes, and punctuation."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9']+|[.,;:?!]"), F.lit(0)), lambda t: F.replace(t, F.lit("'"), F.lit("")))


def is_cue(t: Column) -> Column:
    return t.isin(L.NEGATION_CUES) | (t.endswith("nt") & (t != "isnt") & (F.length(t) > 3))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def negation_flags(tokens_: Column) -> Column:
    """For each token whether one of the four tokens before it is a cue with no boundary in between."""
    return bound(tokens_, _negation_flags)


def _negation_flags(ts: Column) -> Column:
    def flag(t: Column, j: Column) -> Column:
        open_ = lambda i: is_cue(F.get(ts, i)) & ~F.exists(F.slice(ts, i + 2, j - i), lambda x: x.isin(L.NEGATION_BOUNDARIES))
        return F.when(j == 0, F.lit(False)).otherwise(F.exists(F.sequence(F.greatest(F.lit(0), j - L.NEGATION_WINDOW), F.greatest(F.lit(0), j - 1)), open_))

    return F.transform(ts, flag)


def sentiment_score(c: Column) -> Column:
    """Sum of word scores, flipped when negated, times the run of intensifiers and diminishers right before."""
    return bound(negation_tokens(c), _sentiment_of)


def _sentiment_of(ts: Column) -> Column:
    flags = negation_flags(ts)
    scores = F.create_map(*[F.lit(x) for w, v in (L.POSITIVE | L.NEGATIVE).items() for x in (w, v)])
    boosts = F.create_map(*[F.lit(x) for w, v in (L.INTENSIFIERS | L.DIMINISHERS).items() for x in (w, v)])
    items = F.arrays_zip(ts.alias("t"), flags.alias("n"))
    start = F.struct(F.lit(1.0).alias("mult"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        boost, raw = F.try_element_at(boosts, x["t"]), F.coalesce(F.try_element_at(scores, x["t"]), F.lit(0.0))
        signed = F.when(x["n"], -raw).otherwise(raw) * acc["mult"]
        return F.when(boost.isNotNull(), F.struct((acc["mult"] * boost).alias("mult"), acc["sum"].alias("sum"))).otherwise(F.struct(F.lit(1.0).alias("mult"), (acc["sum"] + F.when(raw == 0, 0.0).otherwise(signed)).alias("sum")))

    return F.aggregate(items, start, step)["sum"]


def compound(score: Column) -> Column:
    return F.tanh(score / 4)


def sentiment_label(value: Column) -> Column:
    return F.when(value >= 0.25, "positive").when(value <= -0.25, "negative").otherwise("neutral")


def slots(c: Column) -> Column:
    """struct<frequency,duration,age>: the first of each in the text, null where absent."""
    t = F.coalesce(c, F.lit(""))
    frequency, duration = r"(?i)\b(\d+)\s*(?:times|x)\s*(?:a|per)\s*(day|week|month)\b", r"(?i)\b(\d+)\s*(minutes|minute|hours|hour|days|day|weeks|week|months|month|years|year)\b"
    age = r"(?i)\b(\d{1,3})\s*(?:years? old|y/o)\b"
    none = lambda x, out: F.when(x != "", out)
    n, d = F.regexp_extract(t, frequency, 1), F.regexp_extract(t, duration, 1)
    return F.struct(none(n, F.concat(n, F.lit("x per "), F.lower(F.regexp_extract(t, frequency, 2)))).alias("frequency"), none(d, F.concat(d, F.lit(" "), F.lower(F.regexp_extract(t, duration, 2)))).alias("duration"), F.regexp_extract(t, age, 1).try_cast("int").alias("age"))


def resolved(c: Column, topic: Column) -> Column:
    """Every pronoun replaced by the topic; unchanged without a topic."""
    pieces = F.split(F.coalesce(c, F.lit("")), r"(?i)\b(?:" + "|".join(L.PRONOUNS) + r")\b")
    return F.when(topic.isNull() | (topic == "") | c.isNull(), c).otherwise(F.call_function("array_join", pieces, topic))


def is_followup(c: Column) -> Column:
    t = F.regexp_replace(basic_clean(c), r"[?!.]+$", "")
    found = F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0))
    first, n = F.get(found, F.lit(0)), F.size(found)
    phrase = reduce(lambda a, b: a | b, [t.startswith(p) for p in L.FOLLOWUP_PHRASES])
    alone = (n == 1) & first.isin(L.FOLLOWUP_STARTS + L.MORE_WORDS)
    led = first.isin(L.PRONOUNS) & (n <= 3)
    more = (n <= 5) & F.arrays_overlap(found, F.array(*map(F.lit, L.MORE_WORDS)))
    return (t != "") & (phrase | (n > 0) & (alone | led | more))


def roman_urdu(c: Column) -> Column:
    """struct<known,expanded>: whether at least two words are known, and the text with the new English senses appended."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    senses = F.create_map(*[x for w, v in L.ROMAN_URDU.items() for x in (F.lit(w), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    hits = F.filter(found, lambda t: F.map_contains_key(senses, t))
    more = F.array_distinct(F.flatten(F.transform(hits, lambda t: F.try_element_at(senses, t))))
    return F.struct((F.size(hits) >= 2).alias("known"), F.when(F.size(more) > 0, F.concat(c, F.lit(" "), F.array_join(more, " "))).otherwise(c).alias("expanded"))


def expanded(c: Column) -> Column:
    """Tokens, then their synonyms, then those of phrases the text holds."""
    t = F.lower(F.coalesce(c, F.lit("")))
    ts = tokens(c)
    senses = F.create_map(*[x for w, v in L.SYNONYMS.items() for x in (F.lit(w), F.array(*map(F.lit, v)))])
    own = F.flatten(F.transform(F.filter(ts, lambda x: F.map_contains_key(senses, x)), lambda x: F.try_element_at(senses, x)))
    phrases = [F.when(t.contains(w), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for w, v in L.SYNONYMS.items() if " " in w]
    return F.array_join(F.concat(ts, own, *phrases), " ")


def confidence(score: Column) -> Column:
    return score / (score + 0.25)


def bucket(score: Column) -> Column:
    return F.when(score >= 0.18, "confident").when(score >= 0.08, "best_guess").otherwise("none")
