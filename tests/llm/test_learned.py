"""Operators that are learnt: held-out accuracy, fixed cases, and odd input."""

import random

import pytest

from colloquy.llm import language, pairs, personal
from colloquy.llm.personal_seeds import Maker
from colloquy.llm.seeds import SEEDS
from colloquy.llm.sentences import sentences

LOGS = "session_id string, turns array<struct<role:string,text:string,lang:string>>, text string, x int, spans int"


@pytest.fixture(scope="module")
def languages():
    return language.grown([])


@pytest.fixture(scope="module")
def spans():
    return personal.train(2_500, 3)


# ---- languages

MIXED = [
    ("Could you please explain this to me once more, aber ich habe das leider nicht richtig verstanden", {"en", "de"}),
    ("The nurse told us to come back on Monday mais je ne peux pas venir ce jour avec les enfants", {"en", "fr"}),
    ("I would like to know whether this is normal porque no me encuentro bien desde hace dos semanas", {"en", "es"}),
    ("please tell the doctor that he should call me kyunke mujhe raat ko bohat dard hota hai", {"en", "ur-latn"}),
    ("when can i go home from the hospital और मेरी माँ इस बात से बहुत परेशान हैं", {"en", "hi"}),
]


@pytest.mark.parametrize(("text", "want"), MIXED)
def test_mixed_texts(languages, text, want):
    assert {s[2] for s in languages.told(text)} == want


def test_held_out_languages():
    """Seeds of one half tell the sentences of the other half apart."""
    halves = {lang: text.strip().split("\n") for lang, text in SEEDS.items()}
    model = language.Languages({lang: " ".join(language.words(" ".join(lines[::2]))) for lang, lines in halves.items()})
    tests = [(s, lang) for lang in language.LATIN for line in halves[lang][1::2] for s in line.split(". ") if len(language.words(s)) >= 8]
    right = sum([s[2] for s in model.told(text)] == [lang] for text, lang in tests)
    assert right / len(tests) > 0.95


def test_odd_language_texts(languages):
    assert languages.told(None) == languages.told("") == languages.told(" 🙂 ") == []
    assert languages.told("12 34 56") and languages.told("شکریہ آپ کا")[0][2] == "ur" and languages.told("धन्यवाद जी")[0][2] == "hi"
    long = "what is the best way to treat this pain " * 2000
    assert {s[2] for s in languages.told(long)} == {"en"}
    # Borrowed words, names and medicines make no second language.
    assert {s[2] for s in languages.told("Pexiverol کی گولی پانی کے ساتھ لیں اور Selmo کلینک آئیں")} == {"ur"}


@pytest.mark.parametrize(("tag", "want"), [("en", "en"), ("EN-gb", "en"), (" ur_Latn ", "ur-latn"), ("UR-PK", "ur"), ("und", None), ("", None), (None, None), ("unknown", None), ("it", "it")])
def test_labels(tag, want):
    assert language.label(tag) == want


def test_language_rows(spark):
    text = "please tell me what i have to do before the appointment"
    intents = spark.createDataFrame([("a", text, "en", 1), ("b", text, "de", 1), ("c", text, None, 1), ("d", None, "en", 1), ("e", "hi", None, 1), ("b", text, "de", 1)], "id string, text string, lang string, given int")
    logs = spark.createDataFrame([("s", [("user", MIXED[0][0], "en"), None, ("bot", None, None)], "t", 1, 1), ("z", None, "t", 1, 1)], LOGS)
    got = {tuple(r) for r in language.found(intents, logs).collect()}
    assert got == {("b", -1, "en"), ("c", -1, "en"), ("s", 0, "en"), ("s", 0, "de")}
    assert language.labelled(intents, logs).where("rec_id = 's'").count() == 2
    assert language.found(intents.limit(0), logs.limit(0)).count() == 0


# ---- personal information


def test_held_out_spans(spans):
    maker, hit, made, true = Maker(77), 0, 0, 0
    for _ in range(500):
        text, gold = maker.turn()
        got = set(personal.spans(spans, text))
        hit, made, true = hit + len(got & set(gold)), made + len(got), true + len(gold)
    assert hit / made > 0.97 and hit / true > 0.97


def test_marginals_are_probabilities(spans):
    """Against a sum over all segmentations."""
    import itertools
    import math

    turn = personal.Turn("my name is Zubin Kor, call 0399 555077")
    turn.spans = sorted(turn.spans, key=lambda s: len(s[3]))[:9]
    scores, after = spans.scores(turn), spans.weights["after"]
    total, mass, best = 0.0, [0.0] * len(turn.spans), (-1e9, ())
    for r in range(len(turn.spans) + 1):
        for chosen in itertools.combinations(range(len(turn.spans)), r):
            taken = [k for c in chosen for k in range(turn.spans[c][0], turn.spans[c][1])]
            if len(taken) == len(set(taken)):
                kinds = ["none", *(turn.spans[c][2] for c in sorted(chosen, key=lambda c: turn.spans[c][0]))]
                score = sum(scores[c] for c in chosen) + sum(after.get(f"{a}>{b}", 0.0) for a, b in zip(kinds, kinds[1:]))
                best = max(best, (score, chosen))
                total += math.exp(score)
                for c in chosen:
                    mass[c] += math.exp(score)
    chances, pairs = spans.marginals(turn)
    assert chances == pytest.approx([m / total for m in mass])
    assert sum(pairs.values()) == pytest.approx(sum(chances), abs=1e-4)
    assert set(spans.best(turn)) == {turn.spans[c][:3] for c in best[1]}


def test_redaction(spans):
    text = "my name is Zubin Korran and my email is zubin.korran@mail.example"
    found = personal.spans(spans, text)
    assert personal.redacted(text, found) == "my name is [NAME] and my email is [EMAIL]"
    assert personal.spans(spans, None) == personal.spans(spans, " ") == personal.spans(spans, "🙂") == [] and personal.redacted(None, []) is None
    assert not [s for s in personal.spans(spans, "i take 500 mg twice, booking 2031039 says bed 14 ward 39, helpline 1122")]
    assert len(personal.spans(spans, "ok thanks " * 3000)) == 0


def test_span_rows(spark):
    logs = spark.createDataFrame([("s", [("user", "call me on +92 399 555023", "en"), None, ("bot", None, None), ("bot", "", "x")], "t", 1, 1)] * 2 + [("z", None, "t", 1, 1)], LOGS)
    assert [tuple(r) for r in personal.found(logs).collect()] == [("s", 0, "phone", 11, 25)]
    assert {(r["turn_pos"], r["text"]) for r in personal.cleaned(logs).collect()} == {(0, "call me on [PHONE]"), (3, "")}
    assert personal.found(logs.limit(0)).count() == 0


# ---- pairs


def faq_rows(rnd, n=300):
    topics = ["angina", "heart failure", "a weak pulse", "high cholesterol", "chest pain"]
    questions = ["What is {t}?", "How is {t} treated?", "Is exercise safe with {t}?", "Which tests show {t}?"]
    answers = ["Most people with {t} are checked with an ECG.", "Light walking for {n} minutes a day helps the blood flow.", "You should not stop the tablets suddenly.", "Call the emergency number if the pain lasts more than {n} minutes.", "Your doctor may suggest a monitor for {n} hours."]
    fill = lambda s, t: s.format(t=t, n=rnd.randrange(2, 60))
    return [(fill(rnd.choice(questions), t), " ".join(fill(a, t) for a in rnd.sample(answers, 3))) for t in (rnd.choice(topics) for _ in range(n))]


def test_defects():
    rnd = random.Random(4)
    model = pairs.train(faq_rows(rnd))
    q = "How is chest pain treated?"
    sound = [a for _, a in faq_rows(rnd, 60)]
    assert sum(model.defect(q, a) is not None for a in sound) <= 1
    assert sum(model.defect(q, a.rstrip(".")) is not None for a in sound) <= 2
    assert [model.defect(q, a) for a in (None, "", " - ", "N/A", "<p></p>", "to be added")] == ["empty"] * 6
    assert [model.defect(q, a) for a in (q, q.upper(), "Q: " + q, "How is chest pain treated")] == ["copied"] * 4
    assert [model.defect(q, a) for a in ("I'm sorry, but I can't help with that.", "We are unable to respond to questions of this kind.")] == ["refusal"] * 2
    cut = [pairs.cut_inside(a, rnd) for a in sound]
    assert sum(model.defect(q, c) == "truncated" for c in cut) >= 0.9 * len(cut)
    assert model.defect(q, "Rufen Sie den Notruf, wenn Sie schlecht Luft bekommen, und warten Sie nicht.") == "other_language"


def test_pair_rows(spark):
    rows = [(f"p{i}", q, a, "x") for i, (q, a) in enumerate(faq_rows(random.Random(5), 120))]
    rows += [("n1", "What is it?", None, "x"), ("n2", None, "Take it.", "x"), ("n1", "What is it?", None, "x"), ("n3", None, None, "x"), (None, "What?", "", "x"), ("n4", "What is it?", "word " * 20_000 + "end.", "x")]
    df = spark.createDataFrame(rows, "id string, question string, answer string, defect string")
    got = {tuple(r) for r in pairs.found(df).collect()}
    assert {("n1", "empty"), ("n3", "empty")} <= got and not any(i is None for i, _ in got)
    assert pairs.found(df.limit(0)).count() == 0


# ---- sentences


def cut(text):
    return [text[a:b] for a, b in sentences(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. A. Smith came at 5 p.m. today. He left.", ["Dr. A. Smith came at 5 p.m. today.", "He left."]),
        ("Take 2.5 mg, e.g. with water. Why? Because!", ["Take 2.5 mg, e.g. with water.", "Why?", "Because!"]),
        ("She said: “I felt nothing. It was over.” and went home. Good.", ["She said: “I felt nothing. It was over.” and went home.", "Good."]),
        ("Ab dem 16. Tag ist es gut. Am 3. März auch. Raum Nr. 7. Ende.", ["Ab dem 16. Tag ist es gut.", "Am 3. März auch.", "Raum Nr. 7.", "Ende."]),
        ("« C'est vrai ? » demande-t-il. Oui !", ["« C'est vrai ? » demande-t-il.", "Oui !"]),
        ("¿Cuánto? ¡Cuidado! El Sr. Gil viene.", ["¿Cuánto?", "¡Cuidado!", "El Sr. Gil viene."]),
        ("医生说：“我看过了。没事。”请休息。注意！", ["医生说：“我看过了。没事。”", "请休息。", "注意！"]),
        ("医師は「見ました。」と言いました。はい。", ["医師は「見ました。」と言いました。", "はい。"]),
        ("कितना समय लगता है? ठीक है। चलो!", ["कितना समय लगता है?", "ठीक है।", "चलो!"]),
        ("نرس نے پوچھا، ”کوئی الرجی ہے؟“ اور لکھ لیا۔ ٹھیک ہے۔", ["نرس نے پوچھا، ”کوئی الرجی ہے؟“ اور لکھ لیا۔", "ٹھیک ہے۔"]),
        ("กินยา 2 เม็ดทุกวัน ห้ามหยุดยา\nใช้เวลานาน", ["กินยา 2 เม็ดทุกวัน", "ห้ามหยุดยา", "ใช้เวลานาน"]),
        ("A heading\n\n- one. two\n- three\nfour\n\nText goes\non here. End", ["A heading", "one. two", "three\nfour", "Text goes\non here.", "End"]),
        ("it ended.Then it began. see www.a.example for more.", ["it ended.", "Then it began.", "see www.a.example for more."]),
        ("﻿Hi.​\n\n​\n\nYou.", ["Hi.", "You."]),
    ],
)
def test_sentences(text, want):
    assert cut(text) == want


def test_odd_sentences():
    assert sentences(None) == sentences("") == sentences(" \n​ ") == []
    assert len(cut("This is a sentence. " * 3000)) == 3000
    rnd = random.Random(6)
    for _ in range(300):  # in order, without overlap, inside the text, nothing visible left out of running text
        text = "".join(rnd.choice(["a", "B", ". ", "? ", "\n", "\n\n", "“", "”", "(", ")", "1", "。", " ก", "​", "\r\n", "- "]) for _ in range(60))
        last = 0
        for s, e in sentences(text):
            assert last <= s < e <= len(text) and not text[s].isspace() and not text[e - 1].isspace()
            last = e


def test_sentences_see_the_whole_text():
    cut = lambda t: [t[a:b] for a, b in sentences(t)]
    assert cut("One two three." + " " * 70 + "Four five six.") == ["One two three.", "Four five six."]
    url = "https://example.org/" + "a/very/long/path/" * 6 + "page.Html"
    assert cut(f"Read {url} first. Then go on.") == [f"Read {url} first.", "Then go on."]
    said = "张医生" + "在门诊里非常耐心地对每一位前来复查的病人和家属" * 2 + "说。"
    assert cut(f"“请按时吃药。”{said}然后他走了。") == [f"“请按时吃药。”{said}", "然后他走了。"]
    # Case is judged by a share of the starts, not by the length of the text.
    one = "take it with water. do not stop it suddenly. call us if it hurts. "
    for n in (1, 4, 200):
        assert len(cut(one * n)) == len(cut(one * n + "ECG in room B. ")) - 1 == 3 * n


def test_many_open_marks_take_linear_time():
    assert len(sentences(":( \u201e " * 50_000)) == 1
    assert len(sentences("Look (here) " * 50_000 + "now. Then go.")) == 2
