"""Golden cases of the text and morphology operators, and their behaviour on odd input."""

import pytest
import pyspark.sql.functions as F

from colloquy.functions import morph
from colloquy.functions import text as T
from colloquy.functions.words import words
from colloquy.operators import learn, tagging

ODD = [None, "", "   ", "x" * 20_000, "🙂 ¿qué? ​", "A\r\nB"]


def one(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("flies", "fli"), ("hopping", "hop"), ("running", "run"), ("hi", "hi"), ("be", "be"), ("adjustment", "adjust"), ("homologous", "homolog"), ("controll", "control"), ("sky", "sky")])
def test_stem(word, want):
    assert morph.stem(word) == want


@pytest.mark.parametrize(("word", "want"), [("went", "go"), ("ran", "run"), ("better", "good"), ("kidneys", "kidney"), ("children", "child"), ("studies", "study"), ("quickly", "quick")])
def test_lemma(word, want):
    assert morph.lemma(word) == want


@pytest.mark.parametrize(("a", "b", "want"), [("ab", "ba", 1), ("chesst", "chest", 1), ("panin", "pain", 1), ("kitten", "sitting", 3), ("ca", "abc", 3), ("", "ab", 2)])
def test_osa(a, b, want):
    assert morph.osa(a, b, 3) == want


def test_negation(spark):
    ts = T.negation_tokens(F.col("t"))
    flags = one(spark, lambda c: F.transform(F.arrays_zip(ts.alias("t"), T.negation_flags(ts).alias("f")), lambda x: F.struct(x["t"], x["f"])), "no chest pain but I feel tired")
    told = {r[0]: r[1] for r in flags[0]}
    assert told["chest"] and told["pain"] and not told["tired"] and not told["but"]
    for text in ("I do not have any chest pain", "no fever today, I have a cough", "isnt it", ""):
        tokens = one(spark, T.negation_tokens, text)[0]
        assert one(spark, lambda c: T.negation_flags(T.negation_tokens(c)), text)[0] == tagging.negation_scopes(tokens)


def test_sentiment(spark):
    good, bad, flipped = one(spark, lambda c: T.compound(T.sentiment_score(c)), "thank you so much, I feel great", "I am really worried about my heart", "do not feel good")
    assert good > 0.3 and bad < -0.25 and flipped < 0


def test_rules(spark):
    assert one(spark, T.urgency, "crushing chest pain", "shortness of breath", "I am worried", "when should i take aspirin", None) == [3, 2, 1, 0, 0]
    assert one(spark, T.question_type, "What is it", "Why?", "is it safe", "tea or coffee?", "it hurts", None) == ["what", "why", "yes_no", "choice", "statement", "statement"]
    assert one(spark, T.rule_intent, "hi there", "thanks a lot", "this is useless", "who are you", "hi my knee pain", "help", None) == ["greeting", "thanks", "frustration", "meta", "question", "help", "question"]
    assert one(spark, lambda c: T.resolved(c, F.lit("angina")), "how do I treat it") == ["how do I treat angina"]
    assert one(spark, lambda c: T.resolved(c, F.lit(None).cast("string")), "treat it", None) == ["treat it", None]
    known = one(spark, T.roman_urdu, "sar mein dard ho raha hai", "what is an mri")
    assert known[0]["known"] and "pain" in known[0]["expanded"] and not known[1]["known"]


def test_scrub_is_idempotent(spark):
    once = one(spark, T.normalised, "Call 03001234567, mail a.b@c.org on 1/2/2025, id 12345-1234567-1")
    assert one(spark, T.normalised, *once) == once
    assert once[0] == "call [phone], mail [email] on [date], id [id]"


@pytest.mark.parametrize("f", [T.tokens, T.normalised, T.smart_clean, T.sentences, T.polished, T.question_type, T.rule_intent, T.urgency_cues, T.tags, T.best_specialty, T.out_of_scope, T.sentiment_score, T.slots, T.is_followup, T.roman_urdu, T.expanded, T.word_shape])
def test_odd_texts(spark, f):
    assert len(one(spark, f, *ODD)) == len(ODD)


def test_words():
    assert words(None) == [] == words("")
    assert words("Ｈello, wor­ld​! ½") == ["hello", "world", "1", "2"]
    assert words("Crème brûlée", accents=False) == ["creme", "brulee"]


def test_entities_and_phrases():
    found = tagging.entities("severe chest pain in my knee for 3 days")
    assert [(e["text"], e["label"]) for e in found] == [("chest pain", "SYMPTOM"), ("knee", "BODY"), ("3", "NUMBER"), ("days", "TIME")]
    assert tagging.entities(None) == tagging.entities("") == []
    assert [tagging.pos_tag(t) for t in "the pain is sharp".split()] == ["DT", "NN", "VB", "JJ"]
    assert tagging.phrases("the pain is sharp".split(), ["DT", "NN", "VB", "JJ"]) == [("NP", 0, 2), ("VP", 2, 3)]
    triple = tagging.triples("The doctor treated the pain.")[0]
    assert (triple["subject"], triple["predicate"], triple["object"], triple["negated"]) == ("the doctor", "treated", "the pain", False)
    # Longest first over the whole text, not from left to right.
    assert [e["text"] for e in tagging.entities("high blood pressure medicine")] == ["blood pressure medicine"]
    assert tagging.triples(None) == []


def test_graphs_and_models():
    assert learn.keywords(["a"]) == [("a", 1.0)] and learn.keywords([]) == []
    ranked = learn.keywords("chest pain spicy food chest pain".split())
    assert ranked[0][0] in ("chest", "pain")
    assert learn.central([["a"], ["b"]], 2) == [0, 1] and len(learn.central([["a", "b"], ["a"], ["b", "c"], []], 2)) == 2
    assert learn.byte_pairs({"low": 5, "lower": 2}, 2)[0] in [("l", "o"), ("o", "w")]
    assert learn.byte_pairs({}, 5) == []
    model = tagging.Perceptron().fit([(["take", "aspirin"], ["O", "B-DRUG"]), (["my", "knee"], ["O", "B-BODY"])], 5)
    assert model.decode(["take", "aspirin"]) == ["O", "B-DRUG"] and model.decode([]) == []
    hmm = tagging.HiddenMarkov({("<s>", "O"): 2, ("O", "B"): 2}, {("take", "O"): 2, ("aspirin", "B"): 2})
    assert hmm.decode(["take", "aspirin"]) == ["O", "B"]
