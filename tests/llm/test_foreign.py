"""The learnt operators on wordings that share no template with their training material, marked by hand."""

import re

from colloquy.llm import language, personal
from colloquy.llm.seeds import SEEDS

MARKED = """
Hey, quick one. Could somebody leave a voicemail on [phone:+31 6 4821 7750] about the ECG?
The discharge letter belongs to [name:Marguerite Delacroix-Whitman], not to me.
Apologies, I typed it wrong: [email:h.okonkwo@clinic-mail.co.uk] is right.
For billing, my membership reads [identity:XK 4472910].
Our mum, [name:Siobhan O'Rourke], felt faint after the treadmill.
Parcel with the blood pressure cuff never came to [address:14 Kestrel Mews, 90210 Dunmore].
Pls correct the spelling, it should be [name:Thandiwe Nkosi].
I can be found at [address:77c Larkspur Terrace, 4410 Windhoek] most evenings.
Try the landline [phone:(021) 555-0188] before noon.
The lab mixed up [name:Ivan Petrov] and [name:Ivana Petrova].
Insurance wants [identity:A12-334-9087] quoted on every claim.
Her new contact is [email:lena_m+heart@posteo.example].
Does the echo hurt? Asking for a friend.
I swallowed two 75 mg tablets by mistake, 4 hours ago.
The clock in corridor 7 runs 12 minutes late.
Sleep was poor, 3 nights of 5, and my pulse sat near 98.
Which entrance is closest to bay 16?
Holding my breath for 20 seconds gives me a headache.
Queue number 4471 still waiting, desk 3.
Is Dr [name:Halvorsen] covering the weekend?
Sister [name:Agnieszka] was lovely to us.
Bill goes to [name:Rahul Venkataraman], flat owner, [address:Sector 12 House 48, Noida].
Good evening. [name:Yusuf Demir] here, stent in 2019.
Ring my carer on [phone:0161 496 0345], not on the old one.
Alternate cell: [phone:+61 491 570 156].
Write down [identity:78456 1239087 4] as the document number.
Is [email:reception@heartcare.example] monitored on Sundays?
My cousin [name:Beatriz Fonseca] translates for me.
Bitte rufen Sie mich zurück, Durchwahl [phone:030 901820 44].
Wohnhaft [address:Lindenstraße 44], zweiter Hof.
Le dossier est au nom de [name:Étienne Marchand].
Vous pouvez écrire à [email:e.marchand@poste.example].
La factura va a [address:Calle Olmo 18, 3.º B].
Mi hermana se llama [name:Lucía Ferreiro].
Mera bhai [name:Kamran Siddiqui] kal aaye ga.
Naya number likh lein [phone:0345 2217788].
Ich nehme seit drei Wochen Blutdrucktabletten und schlafe schlecht.
Le médecin m'a conseillé de marcher trente minutes.
No puedo respirar bien por la noche, qué hago.
Kya namak bilkul band karna zaroori hai?
"""


def marked(line):
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[(name|email|phone|identity|address):([^\]]+)\]", line):
        text += line[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + line[at:], spans


def test_spans_in_foreign_wordings():
    model, hit, made, true = personal.train(), 0, 0, 0
    for line in MARKED.strip().splitlines():
        text, gold = marked(line)
        got = personal.spans(model, text)
        hit, made, true = hit + len(set(got) & set(gold)), made + len(got), true + len(gold)
    # Measured: precision 0.96, recall 0.81 (names amid words of no known kind are missed most).
    assert hit >= 0.9 * made and hit >= 0.8 * true


def test_no_digit_is_left_beside_a_placeholder():
    model = personal.train()
    for text in ("my account number is 12345678901234567890", "my IBAN is DE89370400440532013000 thanks", "IBAN DE89370400440532013000", "card 4111 1111 1111 1111 1111 please", "my card number is " + " ".join(["4111"] * 20)):
        clean = personal.redacted(text, personal.spans(model, text))
        assert "[" in clean and not re.search(r"\d", clean), clean


def test_spans_by_shape():
    model = personal.train()
    cases = {
        "i live at Via Roma 12, 20121 Milano": "Via Roma 12, 20121 Milano", "we moved to 221B Baker Street": "221B Baker Street", "my name is rose baker": "rose baker",
        "Oluwaseun Adebayo-Kuti called yesterday": "Oluwaseun Adebayo-Kuti", "my name is Nguyen Thi Minh Khai": "Nguyen Thi Minh Khai", "我叫张伟": "张伟", "Via Roma 12, 20121 Milano": "Via Roma 12, 20121 Milano",
    }
    for text, want in cases.items():
        assert [text[a:b] for _, a, b in personal.spans(model, text)] == [want]


OTHERS = [
    "Мне нужно записаться на приём к врачу на следующей неделе пожалуйста", "Ik heb al drie dagen pijn op de borst en weet niet wat ik moet doen", "أشعر بألم شديد في صدري منذ ثلاثة أيام ولا أعرف ماذا أفعل",
    "Ho un forte dolore al petto da tre giorni e non so cosa fare", "Tenho uma dor forte no peito há três dias e não sei o que fazer", "Üç gündür göğsümde şiddetli bir ağrı var ne yapmam gerekiyor",
    "Jag har haft ont i bröstet i tre dagar och vet inte vad jag ska göra", "Mam silny ból w klatce piersiowej od trzech dni i nie wiem co robić", "zxqv blorp wug fep tiz kromulent snark",
]
KNOWN = {
    "I have had a strong pain in my chest for three days and don't know what to do": "en", "Seit drei Tagen habe ich starke Schmerzen in der Brust und weiß nicht was ich tun soll": "de",
    "J'ai une forte douleur à la poitrine depuis trois jours et je ne sais pas quoi faire": "fr", "Tengo un dolor fuerte en el pecho desde hace tres días y no sé qué hacer": "es", "mere seene mein teen din se bohat dard hai aur mujhe nahi pata kya karoon": "ur-latn",
    "मेरे सीने में तीन दिन से बहुत दर्द है और मुझे नहीं पता क्या करूँ": "hi", "میرے سینے میں تین دن سے شدید درد ہے اور مجھے نہیں معلوم کیا کروں": "ur",
}


def test_other_languages_are_rejected(spark):
    """Also without a label; texts in known languages and other words than the seeds' keep theirs."""
    model = language.Languages({lang: " ".join(language.words(text)) for lang, text in SEEDS.items()})
    assert [{lang for _, _, lang, _ in model.told(t)} for t in OTHERS] == [{"und"}] * len(OTHERS)
    assert {t: [lang for _, _, lang, _ in model.told(t)] for t in KNOWN} == {t: [lang] for t, lang in KNOWN.items()}
    intents = spark.createDataFrame([(f"o{i}", t, None, 1) for i, t in enumerate(OTHERS)] + [(lang, t, None, 1) for t, lang in KNOWN.items()], "id string, text string, lang string, given int")
    logs = spark.createDataFrame([], "session_id string, turns array<struct<role:string,text:string,lang:string>>")
    assert {(r["rec_id"], r["lang"]) for r in language.found(intents, logs).collect()} == {(lang, lang) for lang in KNOWN.values()}
