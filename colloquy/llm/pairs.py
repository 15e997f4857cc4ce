"""Broken question-answer pairs: a multi-label linear classifier on hashed n-grams and pair features.

The training set is made here: a bounded sample of pairs (``SAMPLE``, chosen by hash) is cut into sound sentences; each
defect is then produced on purpose (answers cut inside their last sentence, answers that copy the question, answers
swapped in from another language, refusals, fillers), and so are sound oddities (short answers, lacking full stops,
markup, the question repeated before a real answer). One logistic model a defect is fitted by stochastic gradient
descent; its threshold is calibrated on a held-out part. A pair gets the defect with the largest margin over its
threshold, if any.

Null counts as an empty answer; a null question takes no part in pair features. Ids delivered twice count once; any
length of text is read whole.
"""

from __future__ import annotations

import html
import random

import numpy as np
import pyspark.sql.functions as F
import regex
import xxhash
from pyspark.sql import DataFrame

from colloquy.functions.lazy import arrow
from colloquy.functions.words import words
from colloquy.llm import language
from colloquy.llm.seeds import SEEDS
from colloquy.llm.sentences import sentences
from colloquy.session import spread

DEFECTS = ("empty", "truncated", "refusal", "copied", "other_language")
#: Pairs sampled for training; hashed features; passes; share held out for calibration.
SAMPLE, BUCKETS, EPOCHS, HELD_OUT = 6_000, 1 << 16, 8, 0.2

# Seeds of what a corpus of sound pairs can't show. Written for this project.
FILLERS = ["", " ", "-", "--", "---", ".", "...", "…", "?", "??", "n/a", "N/A", "na", "TBD", "tbd.", "to be added", "to be done", "to do", "TODO", "none", "None", "null", "NULL", "nil", "[answer]", "[text]", "(empty)", "{}", "[]", '""', "''", "no answer", "no answer yet", "answer pending", "coming soon", "xxx", "lorem ipsum", "<p></p>", "<br/>", "<br>", "<div> </div>", "&nbsp;", "unknown", "undefined", "not available", "placeholder", "k. A.", "keine Angabe", "folgt noch", "à compléter", "pas de réponse", "pendiente", "sin respuesta", "jawab nahi hai", "baad mein"]
REFUSALS = [
    "I'm sorry, but I can't help with that.", "I cannot answer medical questions.", "I can't answer this.", "I am not able to give advice about {t}.", "As an automated assistant I am not able to give advice about {t}.",
    "As an AI model I cannot give medical advice.", "My guidelines prevent me from talking about {t}.", "I do not have permission to discuss {t} or any other medicine.", "I am not allowed to talk about this.",
    "Unfortunately, we must decline to answer.", "We are unable to respond to questions of this kind.", "I must respectfully pass on this one.", "That is something I would rather not go into.", "Please ask someone else.",
    "This question cannot be answered here.", "No answer can be provided for this request.", "Sorry, no comment on heart matters.", "I won't discuss that topic.", "I would prefer not to answer.", "It is against our policy to comment on {t}.",
    "Sorry, I am unable to assist with this request.", "We do not answer such questions.", "I have to refuse this question.", "This is outside of what I may talk about.",
    "Dazu kann ich leider keine Auskunft geben.", "Als Assistent kann ich hier nicht weiterhelfen.", "Diese Frage darf ich nicht beantworten.", "Es tut mir leid, dabei kann ich nicht helfen.", "Bitte fragen Sie jemand anderen.", "Dazu möchte ich mich nicht äußern.",
    "Je ne peux pas répondre à cette question.", "Désolé, je ne suis pas en mesure d'aider ici.", "Je ne suis pas autorisé à parler de cela.", "Veuillez demander à quelqu'un d'autre.", "Je préfère ne pas répondre.",
    "No puedo responder a esta pregunta.", "Lo siento, no puedo ayudar con eso.", "No estoy autorizado a hablar de este tema.", "Por favor, pregunte a otra persona.", "Prefiero no contestar.",
    "Maaf kijiye, main is sawal ka jawab nahi de sakta.", "Is baare mein main kuch nahi bata sakta.", "Main is mamle mein madad nahi kar sakta.", "Meherbani kar ke kisi aur se poochein.", "Mujhe is par baat karne ki ijazat nahi.",
]
SOUND = [
    "Yes.", "No.", "No, never.", "Yes, always.", "Yes, but not with {t}.", "Only if your doctor agrees.", "Usually within {n} weeks.", "About {n} minutes", "About {n} days.", "Not before day {n}.", "An ECG, e.g. at {t}", "Sorry for the long wait: the tablet is safe at {n} mg.",
    "Twice a day", "After {n} days", "Rarely.", "It depends on the dose.", "Never more than {n} mg.", "It is unable to spread from person to person.", "Doctors cannot promise a cure, but symptoms often ease within {n} weeks.",
    "I am sorry to hear that; many patients feel the same in the first {n} days.", "Nobody can answer for sure, but most people recover.", "You can ask your doctor about {t} at any time.", "We cannot rule it out without an ECG.",
    "Ja.", "Nein, nie.", "Etwa {n} Minuten", "Nur wenn der Arzt zustimmt.", "Oui.", "Non, jamais.", "Environ {n} minutes", "Seulement si le médecin est d'accord.", "Sí.", "No, nunca.", "Unos {n} minutos", "Solo si el médico está de acuerdo.", "Ji haan.", "Nahi, kabhi nahi.", "Taqreeban {n} minute", "Sirf agar doctor ijazat de.",
]
#: What a cut text may end with.
TAILS = ["", "", "", "", "…", "...", " –", " -", ":", ",", " (", " [", "\n", " and"]

_TAG = regex.compile(r"<[^<>]{0,200}>")
_END = regex.compile(r"""[\s"'”’»)\]]*$""")
_NUMBER = regex.compile(r"\d+(?:[.,]\d+)*")
_CAPITAL = regex.compile(r"^\p{Lu}\p{Ll}+$")


def plain(text: str | None) -> str:
    """Without markup and entities."""
    if not text:
        return ""
    if "<" in text or "&" in text:
        text = html.unescape(_TAG.sub(" ", text))
    return text.replace("\xa0", " ").strip()


def bare(text: str) -> str:
    """Letters and digits only, as one string."""
    return "".join(words(text))


_PREFIX = regex.compile(r"(?i)^\s*(?:q|question|frage|pregunta|sawal)\s*[:.]\s*")


def endings(answers: list[str]) -> tuple[set[str], set[str]]:
    """The last words and last word pairs of complete sentences, and what may follow none."""
    last, pairs = set(), set()
    for text in answers:
        for s, e in sentences(text):
            part = text[s:e]
            if part.rstrip("\"'”»)")[-1:] in ".!?…。！？۔।":
                ws = _masked(part)
                if ws:
                    last.add(ws[-1])
                    pairs.add(" ".join(ws[-2:]))
    return last, pairs


def _masked(text: str) -> list[str]:
    return ["0" if w.isdigit() else w for w in words(_NUMBER.sub("0", text))]


class Features:
    """Hashed features of a pair; the known endings are learnt from the sample."""

    def __init__(self, last: set[str], pairs: set[str], texts: dict[str, str], shared: frozenset[str]) -> None:
        self.last, self.pairs, self.texts, self.shared = last, pairs, texts, shared
        self.languages = language.Languages(texts, shared)

    def state(self) -> tuple:
        return self.last, self.pairs, self.texts, self.shared

    def names(self, question: str | None, answer: str | None) -> list[str]:
        raw, q = plain(answer), plain(question)
        out = ["bias"]
        aw, qw = _masked(raw), _masked(q)
        letters = sum(c.isalpha() for c in raw)
        out.append(f"words={min(len(aw), 12)}")
        out.append(f"letters={min(letters, 8)}")
        if letters == 0:
            out.append("no letters")
        if len(aw) <= 4:
            out.append("whole=" + " ".join(aw))
        # The end.
        tail = raw.rstrip()
        stop = _END.sub("", tail)[-1:]
        kind = stop if stop in ".!?…:,;–-([" or stop in "。！？۔।" else "letter" if stop.isalpha() else "digit" if stop.isdigit() else "other"
        if tail.endswith("..."):
            kind = "..."
        seen = "none" if not aw else ("pair" if " ".join(aw[-2:]) in self.pairs else "word" if aw[-1] in self.last else "new")
        closed = kind in ".!?。！？۔।"
        out += [f"end={kind}", f"end={kind},{seen}", f"closed={closed},{seen}", f"last={seen}", f"closed={closed},{seen},{'short' if len(aw) < 5 else 'long'}"]
        if aw:
            out += [f"last={aw[-1]},{closed}", f"last2={' '.join(aw[-2:])},{closed}"]
        # The wording, unless it is little more than the question's.
        if not qw or len(set(aw) - set(qw)) > 2:
            for n in (1, 2, 3):
                for i in range(len(aw) - n + 1):
                    out.append(f"w{n}=" + " ".join(aw[i : i + n]))
        # The pair.
        if qw:
            aw = _masked(_PREFIX.sub("", raw))
            ba, bq = bare(_PREFIX.sub("", raw)), bare(_PREFIX.sub("", q))
            if ba and ba == bq:
                out += ["equal"] * 6
            share = len(set(aw) & set(qw)) / len(set(aw)) if aw else 0
            more = len(set(aw) - set(qw))
            out += [f"share={int(share * 5)}", f"more={min(more, 6)}", f"share={int(share * 5)},more={min(more, 6)}", f"starts={bool(bq) and ba.startswith(bq)},more={more > 2}"]
            (la, ma), (lq, mq) = self.languages.whole(words(raw)), self.languages.whole(words(q))
            sure = min(int(ma * 2), 4)
            out += [f"langs={la},{lq}", f"same={la == lq}", f"same={la == lq},{sure}", f"same={la == lq},{sure},{min(int(mq * 2), 4)}", f"same={la == lq},{len(aw) > 4}"]
        return out

    def ids(self, question: str | None, answer: str | None) -> np.ndarray:
        return np.array([xxhash.xxh32_intdigest(n) & (BUCKETS - 1) for n in self.names(question, answer)])


def cut_inside(text: str, rnd: random.Random) -> str | None:
    """``text`` stopped inside its last sentence, or None if that has fewer than four words."""
    spans = sentences(text)
    if not spans:
        return None
    s, e = spans[-1]
    marks = [m.start() for m in regex.finditer(r"\s+", text[s:e])]
    if len(marks) < 3:
        return None
    at = s + marks[rnd.randrange(0, len(marks) - (1 if rnd.random() < 0.9 else 0))]
    if rnd.random() < 0.3:  # inside a word
        nxt = regex.match(r"\s+\w+", text[at:])
        if nxt and nxt.end() > 4:
            at += rnd.randrange(3, nxt.end())
    return text[:at].rstrip() + rnd.choice(TAILS)


def _copy(question: str, rnd: random.Random) -> str:
    bare_ = question.rstrip(" ?.")
    return rnd.choice([question, question.lower(), question.upper(), bare_, bare_ + ".", bare_ + "??", bare_ + "...", "Q: " + question, "Question: " + bare_, f'"{question}"', f"<p>{question}</p>", question.replace(" ", "  "), f" {question}\n", question + " " + question])


def _by_language(texts: list[str], model: language.Languages) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for text in texts:
        out.setdefault(model.whole(words(text.replace("{t}", "").replace("{n}", "3")))[0], []).append(text)
    return out


def synthetic(pairs: list[tuple[str, str]], langs: list[str], model: language.Languages, seed: int = 7) -> list[tuple[str, str, str | None]]:
    """(question, answer, defect or None) made from sound pairs, ``langs`` being the languages of their answers."""
    rnd = random.Random(seed)
    by: dict[str, list[str]] = {}
    for (_, answer), lang in zip(pairs, langs):
        by.setdefault(lang, []).append(answer)
    for lang, text in SEEDS.items():
        by.setdefault(lang, []).extend(line.strip() for line in text.strip().split(". "))
    refusals, shorts = _by_language(REFUSALS, model), _by_language(SOUND, model)
    # Mostly in the language of the pair; refusals now and then in another one, which doesn't make them less of one.
    choose = lambda own, every, lang, rate: rnd.choice(own[lang] if lang in own and rnd.random() < rate else every)
    topics = [w for q, _ in pairs[:2000] for w in q.rstrip("?").split()[-2:] if _CAPITAL.match(w)] or ["this"]
    fill = lambda t: t.format(t=rnd.choice(topics), n=rnd.randrange(2, 60))
    vary = lambda t: rnd.choice([t, t, t, t.lower(), t.upper(), f"<p>{t}</p>", f" {t} ", t.rstrip(".")])
    out: list[tuple[str, str, str | None]] = []
    for (q, a), lang in zip(pairs, langs):
        out.append((q, a, None))
        short = a[slice(*rnd.choice(sentences(a)))]
        r = rnd.random()
        out.append((q, a.rstrip(".") if r < 0.4 else f"<p>{a}</p>" if r < 0.5 else a.replace(". ", ".\n") if r < 0.6 else f"{q} {a}" if r < 0.75 else short if r < 0.9 else short.rstrip("."), None))
        if (stopped := cut_inside(rnd.choice([a, short]), rnd)) is not None:
            out.append((q, stopped, "truncated"))
        if rnd.random() < 0.4:
            out.append((q, _copy(q, rnd), "copied"))
        if rnd.random() < 0.5:
            other = rnd.choice([x for x in by if x != lang])
            text = rnd.choice(by[other])
            out.append((q, text if rnd.random() < 0.5 or not sentences(text) else text[slice(*rnd.choice(sentences(text)))], "other_language"))
        if rnd.random() < 0.3:
            out.append((q, vary(rnd.choice(FILLERS)), "empty"))
        if rnd.random() < 0.4:
            out.append((q, vary(fill(choose(refusals, REFUSALS, lang, 0.8))), "refusal"))
        if rnd.random() < 0.4:
            out.append((q, vary(fill(choose(shorts, shorts["en"] if lang == "en" else shorts.get(lang, SOUND), lang, 1.0))), None))
    # Rare languages would see too little of their own seeds.
    for own, defect, times in ((refusals, "refusal", 25), (shorts, None, 12)):
        for lang, texts in own.items():
            if asked := [q for (q, _), found in zip(pairs, langs) if found == lang]:
                out += [(rnd.choice(asked), vary(fill(t)), defect) for t in texts for _ in range(times)]
    rnd.shuffle(out)
    return out


class Classifier:
    """One logistic model a defect over the same hashed features."""

    def __init__(self, weights: np.ndarray, limits: np.ndarray, features: Features) -> None:
        self.weights, self.limits, self.features = weights, limits, features

    def margins(self, question: str | None, answer: str | None) -> np.ndarray:
        return self.weights[self.features.ids(question, answer)].sum(0) - self.limits

    def defect(self, question: str | None, answer: str | None) -> str | None:
        if not bare(plain(answer)):
            return "empty"  # nothing that could be read
        margins = self.margins(question, answer)
        best = int(margins.argmax())
        return DEFECTS[best] if margins[best] > 0 else None


def train(pairs: list[tuple[str, str]], seed: int = 7) -> Classifier:
    """A classifier from sampled pairs; which of them are sound is decided by the seeds alone."""
    seeds = language.grown([])
    tagged = []
    for question, answer in pairs:
        for text in (question, answer):
            lang, margin = seeds.whole(words(text))
            if margin >= language.MARGIN:
                tagged.append((text, lang))
    model = language.grown(tagged)
    sound, langs = [], []
    for question, answer in pairs:
        text = plain(answer)
        ws = words(text)
        if len(ws) < 6 or text[-1:] not in ".!?。۔।" or text.endswith("..") or bare(question).startswith(bare(text)) or bare(text).startswith(bare(question)):
            continue
        (a, _), (q, _) = model.whole(ws), model.whole(words(question))
        if q in (a, "none"):
            sound.append((question, text))
            langs.append(a)
    features = Features(*endings([a for _, a in sound] + [s.format(t="it", n=3) for s in SOUND]), model.texts, model.shared)
    made = synthetic(sound, langs, model, seed)
    ids = [features.ids(q, a) for q, a, _ in made]
    labels = np.array([[d == x for x in DEFECTS] for _, _, d in made], np.float32)
    held = int(len(made) * HELD_OUT)
    weights = np.zeros((BUCKETS, len(DEFECTS)), np.float32)
    total = np.zeros_like(weights)
    rnd = random.Random(seed)
    order = list(range(held, len(made)))
    for epoch in range(EPOCHS):
        rnd.shuffle(order)
        rate = 0.15 / (1 + epoch)
        for i in order:
            z = np.clip(weights[ids[i]].sum(0), -30, 30)
            np.subtract.at(weights, ids[i], rate * (1 / (1 + np.exp(-z)) - labels[i]))
        total += weights
    weights = total / EPOCHS
    limits = np.zeros(len(DEFECTS), np.float32)
    if held:
        scores = np.stack([weights[x].sum(0) for x in ids[:held]])
        for k in range(len(DEFECTS)):
            limits[k] = _limit(scores[:, k], labels[:held, k] > 0)
    return Classifier(weights, limits, features)


def _limit(scores: np.ndarray, true: np.ndarray) -> float:
    """The threshold with the best F1 on held-out pairs, in the middle of the gap it lies in."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(true[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, true.sum()))
    best = int(f1.argmax()) if len(order) else 0
    low = scores[order[best + 1]] if best + 1 < len(order) else scores[order[best]] - 1
    return float((scores[order[best]] + low) / 2)


def sampled(faqs: DataFrame, most: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``most`` pairs with both texts, by hash of their ids: a bounded, documented sample."""
    rows = faqs.where("question is not null and answer is not null").select("id", "question", "answer")
    kept = rows.orderBy(F.xxhash64("id"), "id", "question", "answer").limit(most).collect()
    return list(dict.fromkeys((r["question"], r["answer"]) for r in kept))


def found(faqs: DataFrame) -> DataFrame:
    """(id, defect) of the broken pairs."""
    spark = faqs.sparkSession
    model = train(sampled(faqs))
    used = np.flatnonzero(np.abs(model.weights).sum(1))
    shared = spark.sparkContext.broadcast((used, model.weights[used], model.limits, model.features.state()))
    state: dict[str, Classifier] = {}

    @arrow("string")
    def defect(questions: list, answers: list) -> list:
        if "model" not in state:
            at, values, limits, features = shared.value
            weights = np.zeros((BUCKETS, len(DEFECTS)), np.float32)
            weights[at] = values
            state["model"] = Classifier(weights, limits, Features(*features))
        return [state["model"].defect(q, a) for q, a in zip(questions, answers)]

    rows = spread(faqs.select(F.col("id").cast("string").alias("id"), "question", "answer"))
    return rows.select("id", defect("question", "answer").alias("defect")).where("defect is not null and id is not null").distinct()
