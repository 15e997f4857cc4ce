"""Synthetic turns with known personal information, from which the span model is trained. Written for this project.

Slots: {name} any form of a full name, {first}, {last}, {email}, {phone}, {id}, {addr}; {adr_de}, {adr_fr}, {adr_es} and
{adr_ur} addresses of one language; {nur}, {nhi} names in Urdu and Devanagari script; harmless: {med} a medicine,
{place} a clinic's name, {n} a number, {d} a decimal, {code} a code, {w} and {W} made-up words of running text, {cond} a disease named after someone.
"""

from __future__ import annotations

import random
from functools import lru_cache

from colloquy.llm.seeds import SEEDS

WITH = """
my name is {name} and i need to move my mri slot|my name is {name}|hello, i am {name} from ward {n}|this is {name}, cnic {id}, please send the report to {email}|this is {name} speaking
hi its {name} again|hi, it's {first} again|{name} here. when is my echo?|{first} here, can i come later?|thanks a lot, regards {first}|best wishes, {name}|yours, {first}|kind regards {name}
patient: {name} / tel {phone} / {addr}|patient {name}, phone {phone}, address {addr}|name: {name}|MR NUMBER ETC: NAME {name}, CELL {phone}, HOME {addr}|contact {name} on {phone}
my wife {name} and my brother {name} both want the same cardiologist|my son {first} is four years old|my mother {name} takes {med}|my father {name} had a stent, his passport is {id}
my daughter {first} and i will come on monday|tell {first} the {place} clinic moved|please ask {first} to call me|give this to {name} please|ask nurse {last} on ward {n}, she knows my {id}|nurse {last} was kind
is mrs {last} in today or only the Dr. from monday?|is mr {last} on duty|Dr {last} said i should stop {med} before the stress test|Dr. {name} told me to write to {email} about the knee|doctor {last} told me so
i saw Dr. {last} last week and Prof. {last} before that|Noted, Ms. {name}. The team will call.|Thank you {name}, we will ring {phone} tomorrow.|Thank you, Mr. {last}.|Dear {first}, your slot is confirmed.|Good morning {first}, how are you?
We have {email} on file for you.|Your appointment letter went to {addr}.|write to me: {email}|my email is {email}|mail {email} or {email}|not {email} any more, use {email} now|you can reach me at {email} or call {phone} after six
call me on {phone}|my phone number is {phone}|old number {phone} is dead, new one: {phone}|pls ring {phone}, ask for {name}|text {phone} when ready|deliver the crutches to {addr} and text {phone}
card no {id} and the number is {phone}, thanks|id {id}|my passport number is {id}|insurance number {id}|cnic {id}|my national card is {id}|i live at {addr} so can the physio come home|i live at {addr}
the bill should go to {addr}|send it to {addr} please|we moved to {addr} last year|home address: {addr}
mein Name ist {name} und Sie erreichen mich unter {phone}|ich heiße {name}|meine Versichertennummer ist {id}|mein Ausweis hat die Nummer {id}|bitte schicken Sie den Befund an {email}|ich wohne {adr_de} im zweiten Stock|ich wohne {adr_de}|Frau {last} hat angerufen|Herr {last} kommt morgen|meine Nummer ist {phone}
je m'appelle {name} et mon numéro est le {phone}|je suis {name}|mon numéro de sécurité sociale est {id}|envoyez le compte rendu à {email} svp|j'habite {adr_fr} près du parc|j'habite {adr_fr}|Mme {last} a appelé|ma carte porte le numéro {id}
me llamo {name} y mi teléfono es {phone}|soy {name}|mi documento es {id}|mi pasaporte es {id}|mande el informe a {email} por favor|vivo en {adr_es} desde hace poco|vivo en {adr_es}|la señora {last} llamó|mi número es {phone}
mera naam {name} hai aur number {phone} hai|mera naam {name} hai|shanakhti card {id} hai report bhej dein|mera card number {id} hai|report {email} par bhej dein meherbani|mera pata {adr_ur} hai physio ghar aa sakta hai?|mera number {phone} hai|main {name} bol raha hoon
میرا نام {nur} ہے اور نمبر {phone} ہے|میرا نام {name} ہے اور نمبر {phone} ہے|شناختی کارڈ {id} ہے رپورٹ بھیج دیں|رپورٹ {email} پر بھیج دیں|میرا پتہ {adr_ur} ہے
मेरा नाम {nhi} है और नंबर {phone} है|मेरा नाम {name} है और नंबर {phone} है|मेरा पहचान पत्र {id} है|रिपोर्ट {email} पर भेज दीजिए|मेरा पता {adr_ur} है
"""
WITH_MORE = """
{adr_any}|{adr_any}|{addr}|{name}|{phone}|{id}|{email}|{nzh}|{name}, {phone}|{name}\n{adr_any}\n{phone}
{name} is the patient|the patient is called {name}|the appointment is for {name}, born in march|i booked under {name}|under the name {name}|could you put {name} on the list|{name} will pick up the report|the chart of {name} is missing|signed by {name}|sincerely, {name}|this was written by {name}|{name} asked for a call back|it is {name} calling|you spoke to {name} yesterday|our neighbour {name} can drive her
reach {name} at {phone}|{name} ({phone})|{name}, {adr_any}|{name} lives at {adr_any}|ship it to {adr_any}|my new address is {adr_any}|pick her up at {adr_any} please|we live at {adr_any} now|resident of {adr_any}|home visit at {adr_any}
fax {phone}|whatsapp {phone}|cell: {phone}|dial {phone}|tel. {phone}|the best number is {phone}|my mobile: {phone}|phone number on file: {phone}
my iban is {id}|account {id}|account number {id}|card number {id}|social security number {id}|health insurance id {id}|the number on my card is {id}|driving licence {id}|nhs number {id}|member id {id}|policy {id}|steuernummer {id}|my tax number is {id}|dni {id}|nino {id}|kontonummer {id}
reply to {email} please|cc {email}|forward it to {email}|login is {email}|e-mail: {email}|{email} is my address
der Patient heißt {name}|das ist für {name}|wir wohnen in der {adr_any}|Anschrift: {adr_any}|Ruf mich an: {phone}|le patient s'appelle {name}|c'est pour {name}|adresse : {adr_any}|appelez-moi au {phone}|el paciente se llama {name}|es para {name}|dirección: {adr_any}|llámeme al {phone}|abito in {adr_any}|mi chiamo {name}|mieszkam przy {adr_any}|ik woon op {adr_any}
我叫{nzh}|我叫{nzh}，电话{phone}|患者{nzh}今天来复查|我是{nzh}|{nzh}先生您好|{nzh}女士的报告|请联系{nzh}，电话{phone}|我的名字是{nzh}
"""
WITHOUT = """
it is {w} by the {w}|it is {w} and {w} in the {w}|{w} {w}, it is {w} by {w} {w}|this is {w} {w} {w}|i am {w} about the {w}|is it {w} {w} or {w}|the {w} is {w} by {w}|{w} {w} im {w} {W} was {w} ich {w}|die {W} im {w} {W}|was ist mit {w} {W} am {w} {W}|der {W} {w} im {W}, {w} {w}|{W} {w} in der {W} {w}|bei {w} {W} im {w} {W} {w} Sie
{W} {w}, z. B. {w} {w}|{w} {w}, d. h. {w} {w} {w}|{w}, e. g. {w} {w}|{w} {w}, p. ex. {w}|{W} {w} u. a. {w} {w}|{W} {w} i. d. R. {w}|{W} {w} {w} {w} {w}, {w}.|{W} {w} {w}. {W} {w}, {w} {w}, {w}.|{W}, {w} {w} {w}|{W} {w} {w}: {w} {w}|{w}, {w} {w}, {w}
{w} {w} {w} {w} {w}|{W} {w} {w} {w}, {w} {w}|nurse {w} {w}, {w} {w} {w}|Nurse {w} {w}, "{w} {w}?"|doctor {w} {w} {w} {w}.|Dr {w} {w} {w}|der {W} {w} {n} {W}|Die {W} {w} {n} {W}, {w} {w}|Das {W} {w} {n} {W} im {W}.|{W} {w} {n} {w} {w}|{W} {w}'{w} {w} {w} {w}, {w} {w}|{w} {n} {w}, {n} {w}|{W} {w} {w} {W} {w}.|ein {W} {w} die {W} {w}|i {w} {w} the {w} {w}|{w} ki {w} {n} {w}
may i walk up the hill in the park|will the young baker rest this summer|mark the page with a rose|the ward is on the west side|hope to see you in june|the walker and the stone path|the pulse was {n}, {n} and {n} on {n} days|scores of {n} {n} {n} {n} {n}|{n} patients, {n} beds, {n} nurses|on {n}/{n}/20{n} at {n}:{n}|ticket {code}, room {n}, floor {n}|March {n}, {n} beds|Model {n}, Version {n}|Stage {n} and Type {n} diabetes|Vitamin B{n} and Omega {n}|Level {n}, Desk {n}|我今天头很痛怎么办|检查之前要不要空腹|请问什么时候可以复查|这个药一天吃几次
can i stop {med} before the stress test or not|is it normal to feel dizzy after {med}|i take {n} mg twice, {n}-{n} hours apart, since {n}-{n}-{n}|my bp was {n}/{n} at {t} and {n}/{n} at {t}|booking {code} says bed {n} ward {n}
my report token is {n}-{code} and the lab ticket is RX-{code}|helpline {n}{n} did not answer me yesterday evening|helpline 1122 is busy|helpline 911|my creatinine is {d} and egfr {n}, is contrast still fine?|the Holter box number {code} stopped at {n}:{n} last night
does {cond} or {cond} trouble show on a scan|they said it is a {cond} cyst or maybe {cond} trouble|what about {cond} disease|the {place} clinic sent me to floor {n} room {n} near the main road|the street outside ward {n} is closed, where do i park
There was an @ sign on the form, what is it for?|Room code A-{n}/{n}_x{n} opens the gym door.|Version {d}.{n} of the leaflet replaced the older one.|The {place} clinic offers a follow-up visit about {n} days after the scan.|Take {d} mg of {med} with a full glass of water.
{med} comes in two strengths, {n} mg and {n} mg.|Do not stop {med} on your own!|Is it safe to take {med} with grapefruit juice?|Over {n},000 scans a year pass through the {place} unit.|St. {place} Hospital keeps the results for {n} years, i.e. until the file is archived.
The pulse belt reads {d} vs. {d} on the older model, which nobody trusts.|Why does the left knee feel worse on Monday evenings?|Is the right shoulder warm or only sore?|If the dull pain lasts longer than {n} minutes, call the emergency line.|Most people drive again after {n} days; lorry drivers wait longer.
Patients with sharp cramp in the lower back should rest and call the ward.|The gym is kept at {d} °C ± 0.2 °C.|The report (see Fig. {n} on the card) lists every finding.|Bring your old films, your medicine list, etc. to the desk on level {n}.|Please arrive at {n} a.m. so that the nurse can check your blood pressure.
why do i feel aching pressure in my left heel at night|i dont have any burning rash today but i feel tired|my upper hip hurts after swimming alone, can i still come for physio|how long will the echo take and will it hurt|do i need to fast before my scan tomorrow|should i ice it|what about water|and then?|ok thanks
is the dye safe for kidney patients like my uncle|Both the α-blocker and the β-blocker lower the pulse 👩🏽‍⚕️.|Half a tablet (½ of {n} mg) is enough at night 🙂.|My mother-in-law's café serves low-salt naan and it's superb.|An echo uses sound waves; it does not use radiation.|Really?! Why wait? Ask for help!
Please tell the doctor one thing from me: it hurts|Sorry for asking again about this but my mother is worried|I already told the nurse yesterday that it is better|The report says everything is fine and i feel good|The session costs nothing for patients of ward {n}B.|The cuff reading was approx. {d} points lower after exercise.
Avoid salty food, e.g. crisps, pickles and canned soup, for at least {n} days.|Some bruising near the lower hip is expected, esp. with blood thinners, i.e. for {n} days.|A pacemaker clinic checks the battery every {n} weeks, incl. holidays.|Pack loose clothes, a towel, water, etc.|Wärme lockert den Muskel, Kälte beruhigt ihn.|Essen Sie z. B. Suppe, Reis oder Obst, d. h. nichts Fettes.|Mangez léger, p. ex. du riz ou une soupe.|Coma ligero, p. ej. arroz o sopa, durante {n} días.|Traiga placas antiguas, recetas, etc.
see you on Tuesday at {n} o'clock in the Heart Centre|the MRI and the CT scan were on Friday|my blood type is AB and my weight is {n} kg|ticket number {code} was called at desk {n}|invoice {code} from March {n}|room {n} on the third floor|Achilles tendon or Baker cyst|Ramadan begins in March and Eid in April|I use an Apple phone and Google
wie lange muss ich {med} noch einnehmen|muss ich vor der Untersuchung nüchtern bleiben|ich habe seit gestern stechende Schmerzen im rechten Arm was soll ich tun|Nehmen Sie {n},{n} mg {med} mit reichlich Wasser ein.|Der Termin ist am {n}. März um {n} Uhr.|Die Praxis {place} bietet etwa {n} Tage nach der Aufnahme einen Termin an.|Über {n}.000 Menschen kommen jedes Jahr zu uns.|Bringen Sie Ausweis, Medikamentenplan usw. bitte mit.|Ein Kontrastmittel ist nur selten nötig, vgl. S. {n} im Heft.|Setzen Sie {med} nicht eigenmächtig ab!
combien de temps dois-je prendre {med} encore|Prenez {n},{n} mg de {med} avec un grand verre d'eau.|Le centre {place} propose un contrôle environ {n} jours après l'examen.|Plus de {n} 000 examens sont faits chaque année.|La tension est passée de {n},{n} à {n},{n} en un mois.|N'arrêtez jamais {med} sans avis !|Combien de temps dure la séance ?
cuánto tiempo debo tomar {med} todavía|tengo un dolor agudo en el costado izquierdo desde ayer qué hago|Tome {n},{n} mg de {med} con un vaso de agua.|La clínica {place} ofrece una revisión unos {n} días después del estudio.|Más de {n}.000 estudios se hacen cada año.|¡No deje {med} por su cuenta!
{med} kitne din tak leni hai mujhe batayen|{med} ki {d} mg goli pani ke saath lein.|{place} clinic scan ke {n} din baad dobara bulata hai.|scan se pehle khana kha sakte hain ya nahi|dil ki dharkan bohat tez ho jati hai raat ko|Apni marzi se {med} band na karein!|Report {n} saal tak mehfooz rehti hai.
{med} کتنے دن تک لینی ہے مجھے بتائیں|میرے دائیں گھٹنے میں شدید درد ہو رہا ہے کیا کروں|{place} کلینک سکین کے {n} دن بعد دوبارہ بلاتا ہے۔|{med} کی {d} ملی گرام گولی پانی کے ساتھ لیں۔|اپنی مرضی سے {med} بند نہ کریں!|شکریہ|رپورٹ {n} سال تک محفوظ رہتی ہے۔|کتنی دیر لگتی ہے؟|مشین شور کرتی ہے مگر خطرناک نہیں ہے۔|نمک کم کریں، خاص طور پر اچار اور پاپڑ۔|پہلے ہموار زمین پر چلیں، پھر سیڑھیوں پر۔|{n} دن بعد گاڑی چلا سکتے ہیں۔|ڈھیلے کپڑے اور چپٹے جوتے پہن کر آئیں۔|سانس پھولے تو فوراً فون کریں۔
{med} कितने दिन तक लेनी है मुझे बताइए|मेरे बाएँ टखने में तेज दर्द हो रहा है क्या करूँ|{place} क्लिनिक स्कैन के {n} दिन बाद फिर बुलाता है।|{med} की {d} मि.ग्रा. गोली पानी के साथ लें।|अपनी मर्जी से {med} बंद न करें!|धन्यवाद|रिपोर्ट {n} साल तक सुरक्षित रहती है।|कितना समय लगता है?|मशीन शोर करती है लेकिन खतरनाक नहीं है।|नमक कम करें, खासकर अचार और पापड़।|पहले समतल जमीन पर चलें, फिर सीढ़ियों पर।|{n} दिन बाद गाड़ी चला सकते हैं।|ढीले कपड़े और चपटे जूते पहनकर आएँ।|साँस फूले तो तुरंत फोन करें।
"""

_ONSETS, _VOWELS, _CODAS = "b br c d dr f g gh h j k kh l m n p ph r s sh st t th tr v w x z".split(), "a e i o u ai ee oo".split(), ["", "", "n", "r", "l", "s", "k", "m", "ld", "nt", "sk"]
_LASTS = ["oski", "enko", "wick", "illi", "ani", "ora", "um", "mar", "ley", "sen", "son", "mann", "ez", "ov", "ini", "er", "ton", "rane", "vik", "tesh", "olan", "lan", "", ""]
_MEDS, _PLACES = ["pril", "olol", "statin", "zide", "dipan", "sartin", "loxan", "verol", "prine", "tamil", "rubine", "nastel", "mectol", "xaban", "cillin"], ["ford", "dale", "gard", "vik", "stow", "lon", "rin", "holt", "mere", "nesk", "ton", "burg"]
_UR, _HI = ["فد", "رق", "نم", "رہ", "مل", "کا", "زر", "مین", "طا", "رون", "وی", "سل", "ور", "نوک", "کل", "وان", "تھر", "لی", "برک", "سی", "او", "مر"], ["फ", "द", "रि", "क", "नि", "म", "रा", "मे", "ल", "का", "ज़", "मी", "ना", "यो", "र्व", "ओ", "के", "ब्रि", "सी", "वी", "थ्रु", "वि"]
#: Syllables of names in Han script, and everyday words that serve as names.
_ZH = ("王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗", "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华文玉建国")
EVERYDAY = "rose baker may hope will mark young day rich grace joy cook hunter miller page park hill brook field woods stone king bishop summer winter april june sunny iris daisy hazel olive ruby pearl frank grant chase dean drew faith glen heather ivy jack jasmine lance miles neil penny rusty violet west wade ward fox fisher carter mason parker porter potter shepherd taylor turner walker weaver butcher gardner".split()
_DIGITS = "zero one two three four five six seven eight nine".split()
COND = ["Cushing", "Raynaud", "Baker", "Achilles", "Crohn", "Parkinson", "Alzheimer", "Hodgkin", "Graves", "Addison", "Marfan", "Down", "Bell", "Dupuytren", "Sjögren", "Wilson", "Holter"]


class Maker:
    """Draws turns; each piece of personal information comes as (kind, start, end)."""

    def __init__(self, seed: int = 11) -> None:
        self.r = random.Random(seed)

    def _digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def _word(self, n: int) -> str:
        return "".join(self.r.choice(_ONSETS) + self.r.choice(_VOWELS) + self.r.choice(_CODAS) for _ in range(n))

    def _first(self) -> str:
        return self._word(self.r.choice([1, 2, 2, 2, 3])).capitalize() + self.r.choice(["", "", "a", "e", "in", "an"])

    def _last(self) -> str:
        return self._word(self.r.choice([1, 1, 2])).capitalize() + self.r.choice(_LASTS)

    def _case(self, text: str) -> str:
        return self.r.choice([text] * 5 + [text.lower()] * 3 + [text.upper()])

    def name(self) -> str:
        f, m, l = self._first(), self._first(), self._last()
        if self.r.random() < 0.05:
            return f"{f} {m} {self._first()} {l}"
        if self.r.random() < 0.09:
            out = f"{l}, {f}"
            return out.upper() if self.r.random() < 0.2 else out
        return self._case(self.r.choice([f"{f} {l}"] * 6 + [f"{f} {m} {l}"] * 3 + [f"{f[0]}. {l}", f"{f[0]}. {m[0]}. {l}", f"{f} {m[0]}. {l}", f"{f}-{m} {l}", f"{f} {l}-{self._last()}", self._plain_name()]))

    def _plain_name(self) -> str:
        """A name made of everyday words, as many names are."""
        return " ".join(w.capitalize() for w in self.r.sample(EVERYDAY, 2))

    def email(self) -> str:
        f, l, hosts = self._first().lower(), self._last().lower(), self._word(2)
        host = self.r.choice([hosts, "mx." + hosts, self._word(1) + "." + hosts]) + "." + self.r.choice(["example", "test", "invalid", "com", "org", "pk", "de"])
        local = self.r.choice([f"{f}.{l}", f"{f}.{l}", f"{f[0]}{l}{self._digits(2)}", f"{f}+{self._word(1)}", f"{f}{l}", f"{f.capitalize()}-{l.capitalize()}", f"{f}_{l}", f])
        style = self.r.random()
        if style < 0.6:
            out = f"{local}@{host}"
            return out.upper() if self.r.random() < 0.12 else out
        if style < 0.75:
            return f"{local} [at] {host.replace('.', ' [dot] ')}"
        if style < 0.87:
            return f"{local.replace('.', ' dot ')} at {host.replace('.', ' dot ')}"
        return f"{local.replace('.', '')}(at){host}"

    def phone(self) -> str:
        d, r = self._digits, self.r
        out = r.choice([
            f"+92-3{d(2)}-{d(6)}", f"+92 3{d(2)} {d(3)} {d(3)}", f"00923{d(2)} {d(6)}", f"03{d(9)}", f"03{d(2)} {d(6)}", f"03{d(2)}/{d(6)}", f"03{d(2)}.{d(3)}.{d(3)}", f"03{d(2)}-{d(7)}", f"(0{d(2)}) {d(3)}-{d(4)}", f"07{d(3)} {d(6)}", f"+44 7{d(3)} {d(6)}",
            f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 {d(2)} {d(5)} {d(3)}", f"{d(3)}-{d(4)}", f"555-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"0{d(2)} {d(7)}", f"0{d(10)}", f"0{d(3)} {d(3)} {d(3)}", "words", "urdu", "any", "any", "any",
        ])
        if out == "words":
            return " ".join(r.choice(_DIGITS) for _ in range(r.choice([7, 10, 10, 11])))
        if out == "urdu":
            return f"03{d(2)} {d(6)}".translate({48 + i: 0x6F0 + i for i in range(10)})
        if out == "any":
            # Any other grouping: a lead, then groups of two to five digits with one kind of gap.
            gap = r.choice([" ", " ", "-", ".", "/"])
            return r.choice(["0", "+" + r.choice("123456789") + d(1) + gap, "00" + r.choice("123456789") + d(1) + gap]) + gap.join(d(k) for k in r.choice([(2, 3, 4), (3, 4, 4), (2, 2, 2, 2, 2), (1, 4, 4), (3, 3, 3), (4, 3, 3), (2, 7), (3, 3, 4), (5, 5)]))
        return out

    def id(self) -> str:
        d, r = self._digits, self.r
        letters = "".join(r.choice("abcdefghjkmnprstuvwxyz") for _ in range(2))
        return r.choice([f"{d(5)}-{d(7)}-{d(1)}", f"{d(5)} {d(7)} {d(1)}", d(13), f"{d(3)} {d(3)} {d(4)}", f"9{d(2)} {d(3)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{letters} {d(7)}", f"{letters.upper()}{d(7)}", f"{letters.upper()} {d(7)}", f"{letters[0].upper()}{d(9)}", self._long_id(letters)])

    def _long_id(self, letters: str) -> str:
        """Numbers of cards and accounts: long, whole or in groups of four, with or without letters."""
        d, r = self._digits, self.r
        groups = r.choice([" ", "", "-"]).join(d(4) for _ in range(r.choice([4, 4, 5])))
        return r.choice([d(r.randrange(14, 24)), groups, f"{letters.upper()}{d(2)}" + r.choice(["", " "]).join([""] + [d(4) for _ in range(r.choice([4, 5]))]), f"{letters.upper()}{d(2)}{letters.upper()}{letters.upper()}{d(14)}", f"{d(2)} {d(6)} {letters[0].upper()} {d(3)}", f"{letters[0].upper()}{d(2)}{letters[1].upper()}{d(5)}"])

    def _place(self) -> str:
        return self._word(self.r.choice([1, 2])).capitalize() + self.r.choice(_PLACES)

    def addr(self) -> str:
        n, p, r = (lambda k=190: str(self.r.randrange(1, k))), self._place(), self.r
        road = r.choice(["Road", "Street", "street", "Lane", "Crescent", "Avenue", "Drive", "Close"])
        out = r.choice([f"{n()} {p} {road}", f"{n()} {p} {road}", f"{n()} {p} Ave Apt {n(30)}", f"Flat {n(30)}, {n()} {p} {road}", f"Unit {n(30)}/{n()} {p} {road}", f"House {n()}-{r.choice('ABCD')}, Street {n(20)}, {p} Colony", f"House {n()}, Block {r.choice('ABC')}, {p} Town", f"Apt {n(30)}, {n()} {p} {road}"])
        return self._case(out) if r.random() < 0.8 else out

    def adr_any(self) -> str:
        """An address of no country in particular: words and a house number, perhaps with a postal code and a town."""
        n, p, q, r = f"{self.r.randrange(1, 250)}{self.r.choice(['', '', '', 'a', 'B', 'C'])}", self._place(), self._word(self.r.choice([1, 2, 2])).capitalize(), self.r
        lead = self._word(1).capitalize()
        street = r.choice([f"{lead} {p} {n}", f"{lead} {p} {n}", f"{p} {n}", f"{n} {p} {lead}", f"{n} {p} Street", f"{n} {p} Road", f"{lead} {q} {p} {n}", f"{n}/{r.randrange(1, 40)} {p} Street"])
        post = r.choice([self._digits(5), self._digits(4), self._digits(6)])
        return r.choice([street, f"{street}, {post} {q}", f"{street}, {q}", f"{street}, {q} {post}"]) if any(w in street for w in (" Street", " Road")) else r.choice([f"{street}, {post} {q}", f"{street}, {post} {q}", f"{street}, {q}"])

    def adr_de(self) -> str:
        n, p = self.r.randrange(1, 190), self._place()
        return self.r.choice([f"{p}weg {n}", f"{p}straße {n}", f"Am {p}er Tor {n}{self.r.choice(['', 'a', 'b'])}", f"{p}platz {n}", f"An der {p} {n}", f"{p}er Allee {n}"])

    def adr_fr(self) -> str:
        n, p = self.r.randrange(1, 190), self._place()
        return self.r.choice([f"{n} rue de la {p}", f"{n} bis, avenue {p}", f"{n}, rue {p}", f"{n} boulevard {p}", f"{n} ter, place {p}"])

    def adr_es(self) -> str:
        n, p = self.r.randrange(1, 190), self._place()
        return self.r.choice([f"Calle {p} {n}, {self.r.randrange(1, 9)}.º {self.r.choice('ABCD')}", f"Avenida {p} {n}", f"Calle {p} {n}", f"Plaza {p} {n}, {self.r.randrange(1, 9)}.º {self.r.choice('ABCD')}"])

    def adr_ur(self) -> str:
        n, m, p = self.r.randrange(1, 190), self.r.randrange(1, 30), self._place()
        return self.r.choice([f"Makan number {n}, Gali {m}, {p} Mohalla", f"ghar {n} gali {m} {p.lower()} colony", f"ghar number {n}, gali {m}, {p} Colony", f"Makan {n}, Gali {m}, {p}"])

    def fill(self, slot: str) -> tuple[str, str | None]:
        r = self.r
        if slot == "name":
            return self.name(), "name"
        if slot in ("first", "last"):
            return self._case(self._first() if slot == "first" else self._last()), "name"
        if slot == "nzh":
            return r.choice(_ZH[0]) + "".join(r.choice(_ZH[1]) for _ in range(r.choice([1, 2, 2]))), "name"
        if slot == "nur" or slot == "nhi":
            part = lambda: "".join(r.choice(_UR if slot == "nur" else _HI) for _ in range(r.choice([2, 2, 3])))
            return f"{part()} {part()}", "name"
        if slot == "email":
            return self.email(), "email"
        if slot == "phone":
            return self.phone(), "phone"
        if slot == "id":
            return self.id(), "identity"
        if slot.startswith("ad"):
            return getattr(self, slot)(), "address"
        if slot == "med":
            return r.choice([str.lower, str.capitalize])(self._word(r.choice([1, 2])) + r.choice(_MEDS)), None
        if slot == "place":
            return self._place(), None
        if slot == "cond":
            return r.choice(COND), None
        if slot == "code":
            return self._digits(r.choice([4, 5, 6, 7])), None
        if slot in "wW":
            word = self._word(r.choice([1, 1, 2])) + r.choice(["", "", "ing", "ed", "e", "en", "s", "ung", "ar", "na", "ta", "a", "o"])
            return (word.capitalize() if slot == "W" else word), None
        if slot == "t":
            return f"{r.randrange(0, 24):02d}{r.choice(['00', '15', '30', '45'])}", None
        return (f"{r.randrange(1, 99)}.{r.randrange(0, 9)}" if slot == "d" else str(r.choice([r.randrange(1, 60), r.randrange(1, 200)]))), None

    def _strange(self, sentence: str, german: bool) -> str:
        """A harmless sentence with many of its words made up, so that unknown words alone make no name."""
        out = []
        for word in sentence.split(" "):
            core = word.strip(".,;:?!()")
            c = ord(core[0]) if core else 0
            if len(core) >= (4 if c < 0x600 else 3) and core[0].isalpha() and not set(core) & set("{}0123456789") and self.r.random() < 0.55:
                if c >= 0x600:
                    new = "".join(self.r.choice(_HI if c >= 0x900 else _UR) for _ in range(self.r.choice([2, 3])))
                else:
                    new = self._word(self.r.choice([1, 2, 2])) + self.r.choice(["", "", "ing", "ed", "e", "en", "s", "ly", "ung", "tion", "ar", "na", "ta"])
                    if core[0].isupper() or german and self.r.random() < 0.35:
                        new = new.capitalize()
                word = word.replace(core, new)
            if self.r.random() < 0.05:
                word = f"{self.r.randrange(1, 120)} {word}"
            out.append(word)
        text = " ".join(out)
        return text[:1].upper() + text[1:] if self.r.random() < 0.6 else text

    def _with_piece(self, sentence: str, spans: list[tuple[str, int, int]], at: int) -> str:
        """The sentence with a piece of personal information between any two of its words; its context tells nothing, so
        only pieces are taken that tell themselves by their shape."""
        words = sentence.split(" ")
        k = self.r.randrange(len(words) + 1)
        piece, kind = self.fill(self.r.choice(["phone", "email", "addr", "adr_any"]))
        if self.r.random() < 0.5:
            piece, kind = " ".join([self._first(), *([self._first()] if self.r.random() < 0.2 else []), self._last()]), "name"
        before, after = " ".join(words[:k]), " ".join(words[k:])
        if before and before[-1].isalnum() and self.r.random() < 0.15:
            before += ","
        start = at + len(before) + bool(before)
        spans.append((kind, start, start + len(piece)))
        gap = "" if not after or after[0] in ".,;:!?" else self.r.choice([" ", " ", " ", ", "])
        return f"{before} {piece}{gap}{after}" if before else f"{piece}{gap}{after}"

    def turn(self) -> tuple[str, list[tuple[str, int, int]]]:
        text, spans = "", []
        for k in range(self.r.choice([1, 1, 1, 2, 2])):
            text += self.r.choice([" ", ". ", "\n", " "]) if k else ""
            if self.r.random() < 0.35:
                lang, sentence = self.r.choice(_PLAIN)
                sentence = self._strange(sentence, lang == "de")
                if self.r.random() < 0.5:
                    sentence = self._with_piece(sentence, spans, len(text))
                text += sentence
                continue
            template = self.r.choice(_WITH if self.r.random() < 0.7 else _WITHOUT)
            if template in _HARMLESS and self.r.random() < 0.5:
                template = self._strange(template, " ich " in f" {template} " or "Sie" in template)
            upper = self.r.random()
            for i, part in enumerate(template.replace("}", "{").split("{")):
                if i % 2:
                    got, kind = self.fill(part)
                    if kind:
                        spans.append((kind, len(text), len(text) + len(got)))
                    text += got
                else:
                    text += part.capitalize() if upper < 0.08 and not text else part
        return text, spans


_WITH = [t.strip() for line in (WITH + WITH_MORE).strip().splitlines() for t in line.split("|") if t.strip()]
_WITHOUT = [t.strip() for line in WITHOUT.strip().splitlines() for t in line.split("|") if t.strip()]

_PLAIN = [(lang, part.strip() + end) for lang, body in SEEDS.items() for part in body.replace("؟", ".").replace("۔", ".").replace("।", ".").replace("\n", " ").split(".") if len(part) > 12 for end in (".", "")]

_HARMLESS = frozenset(_WITHOUT)


def literal_words() -> set[str]:
    """Lower-case words of the templates themselves, slots left out."""
    out: set[str] = set()
    for template in (*_WITH, *_WITHOUT):
        for i, part in enumerate(template.replace("}", "{").split("{")):
            if i % 2 == 0:
                out.update("".join(c if c.isalpha() or c == "'" or ord(c) > 0x900 else " " for c in part.lower()).split())
    return out


@lru_cache(1)
def introductions() -> frozenset[tuple[str, str]]:
    """The two words before a name in the templates; the first may be missing."""
    out = set()
    for template in _WITH:
        parts = template.replace("}", "{").split("{")
        for i in range(1, len(parts), 2):
            if parts[i] in ("name", "first", "last") and parts[i - 1].strip():
                words = parts[i - 1].lower().split()
                if words[-1][-1].isalpha() and parts[i - 1][-1] == " ":
                    out.add((words[-2] if len(words) > 1 else "", words[-1]))
    return frozenset(out)
