"""Sentence boundaries across languages and scripts, by cascading tables of break and no-break rules.

A text is cut into blocks at blank lines and at the ends of list lines; list marks belong to no sentence. Inside a block
every run of end marks is a candidate. Candidates inside quotations or brackets are dropped; for each other one the
tables are asked in order (quotations, then each language's own exceptions, then the general rules) and the first rule
whose patterns match before and after the position decides. Thai has no end marks: white space that touches Thai and no
digit is a boundary there.

All Latin-script tables cascade, because texts mix languages and carry wrong labels. Every pattern sees the whole text
around its position, however far apart words and blanks are. Texts in which hardly any line, or word behind an end mark,
starts with a capital are read by the rules for caseless text. Offsets count code points of the original text, invisible format characters
included. Null, empty and invisible texts give no sentence.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame

from colloquy.functions.lazy import arrow
from colloquy.session import spread

ENDS = ".!?…。！？｡؟۔।॥‼⁇⁈⁉"
CLOSERS = "\"”“’»›)]」』）】］》〉"
#: Opening marks and what closes them.
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "”": "“", '"': '"', "»": "«"}
BRACKETS = "([（"

# Abbreviations by language. Those of NEVER can't end a sentence; those of NUMBER don't when a figure
# follows; those of MAYBE end one if the next word starts like a sentence.
NEVER = {
    "en": "Dr Mr Mrs Ms Prof St Rev Gen Capt Lt Col Sgt vs approx incl esp e.g i.e cf viz resp Messrs Mt dept est",
    "de": "Dr med Prof Hr Fr bzw vgl ca inkl exkl evtl ggf sog Dipl Ing z.B d.h u.a i.d.R z.T o.ä zzgl bspw gem lt",
    "fr": "Dr Pr Mme Mlle MM ex env cf av St Ste p.ex c.-à-d",
    "es": "Dr Dra Sr Sra Srta Ud Uds D Dña ej aprox p.ej Prof avda",
    "ur-latn": "Dr Mr Mrs Prof",
    "hi": "डॉ श्री प्रो नं मि ग्रा कि मी से सु श्रीमती मि.ग्रा कि.ग्रा",
}
NUMBER = {"en": "no nos fig figs p pp vol ch sec eq art tel ext", "de": "nr abb kap tab s bd art abs", "fr": "n no art fig vol tél", "es": "n núm art fig pág tel", "hi": "नं"}
MAYBE = {"en": "etc a.m p.m inc ltd co jr sr m.d ph.d u.s u.k min max", "de": "usw etc u.ä", "fr": "etc", "es": "etc"}
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"
#: German words before an ordinal number.
DETERMINERS = "am dem der den des vom zum zur beim ab im die das jeder jeden jedem bis seit ihrem ihren seinem unserem einem"
#: Words that go on with a sentence after a quotation or an abbreviation, where case can't tell.
GOING_ON = "and or but so to for in on at of with that from until before after than said asked is was were are then as because which who und oder aber et ou mais y o pero aur ya lekin magar phir ke ki"
#: Verbs of saying, which go on with a sentence after what was said.
SAYING = "said says asked asks replied replies answered repeated added whispered called cried sagt sagte fragt fragte fragen meint meinte antwortet ruft dit demande demandent répond ajoute dice dijo pregunta preguntan responde añade kehta kehti poocha"
AFTER_STOP = "and or but so then et und y aur"
GOING_ON_OTHER = "और या लेकिन फिर कि तथा اور یا لیکن پھر کہ مگر"


@dataclass(frozen=True)
class Rule:
    """A position is decided by the first rule whose patterns match the text before it (read backwards from it) and after it."""

    table: str
    breaks: bool
    before: str
    after: str

    @property
    def stop_only(self) -> bool:
        """Whether the rule can only match behind a full stop."""
        return self.before.endswith((r"\.", "[.]"))


def _any(words: str) -> str:
    return "|".join(sorted((regex.escape(w) for w in words.split()), key=len, reverse=True))


_LETTER = r"(?<![\p{L}\p{M}\p{N}])"
_STARTS = r"(?:[«„“]\s?)?[\p{P}\p{S}]*(?:[\p{Lu}\p{Lt}\p{N}\p{Lo}\p{So}])"


def _rule(table: str, breaks: bool, before: str, after: str) -> Rule:
    return Rule(table, breaks, before, after)


Compiled = list[tuple[regex.Pattern, regex.Pattern, bool]]


def _compiled(rules: list[Rule]) -> Compiled:
    """(before, read backwards; after; whether it breaks) in order; neighbours that differ in ``before`` only are one pattern."""
    out: list[tuple[list[str], str, bool]] = []
    for rule in rules:
        if out and out[-1][1:] == (rule.after, rule.breaks):
            out[-1][0].append(rule.before)
        else:
            out.append(([rule.before], rule.after, rule.breaks))
    inline = lambda x: f"(?i:{x.replace('(?i)', '')})" if "(?i)" in x else f"(?:{x})"
    return [(regex.compile("(?r)(?:" + "|".join(map(inline, befores)) + ")"), regex.compile(after), breaks) for befores, after, breaks in out]


#: The table asked before all others: no break inside an address of the net. Its matches are found once a text.
WEB, _WEB_GOES_ON = regex.compile(r"(?i)(?:www|https?|@)\S*"), regex.compile(r"[\p{L}\p{N}]")


def _web(text: str) -> list[tuple[int, int]]:
    low = text.lower()
    return [m.span() for m in WEB.finditer(text)] if "@" in text or "www" in low or "http" in low else []


def tables(caseless: bool) -> list[Rule]:
    """The cascade for cased or caseless texts; ``before`` ends with the end marks (closing marks left out)."""
    out = [
        _rule("figures", False, r"\p{N}[.]", r"\p{N}"),
        *([_rule("caseless", True, r"\p{Ll}{3}[.]", r"\p{Ll}{2}")] if caseless else []),
        _rule("figures", False, r"[.]", r"[\p{Ll}\p{N}\p{Pd}_/@ºª,;:]"),
    ]
    for lang, words in NEVER.items():
        flag = "" if lang == "hi" else "(?i)"
        out.append(_rule(lang, False, rf"{flag}{_LETTER}(?:{_any(words)})\.", r"\s*\S"))
    for lang, words in NUMBER.items():
        out.append(_rule(lang, False, rf"(?i){_LETTER}(?:{_any(words)})\.", r"\s*\p{N}"))
    # Written with blanks inside: "z. B.", "p. ej.", "i. e."
    out.append(_rule("spaced", False, rf"(?i){_LETTER}(?:z\. ?b|d\. ?h|u\. ?a|p\. ?ex|p\. ?ej|i\. ?e|e\. ?g|s\. ?o)\.", r"\s*\S"))
    ordinal = rf"(?i){_LETTER}(?:{_any(DETERMINERS)})\s+\p{{N}}{{1,3}}\."
    out.append(_rule("de", False, ordinal, r"\s+\p{L}"))
    out.append(_rule("de", False, r"\p{N}{1,2}\.", rf"(?i)\s+(?:{_any(MONTHS)})\b"))
    maybe = " ".join(MAYBE.values())
    if caseless:
        out.append(_rule("caseless", False, rf"{_LETTER}(?:m\.d|ph\.d)\.", r"\s*\S"))
        out.append(_rule("caseless", False, rf"{_LETTER}(?:{_any(maybe)})\.", rf"\s+(?:{_any(GOING_ON)}|bitte)(?![\p{{L}}\p{{M}}])"))
    else:
        out.append(_rule("en", False, rf"(?i){_LETTER}(?:{_any(maybe)})\.", r"\s*[\p{P}]*\p{Ll}"))
    out.append(_rule("en", True, rf"(?i){_LETTER}(?:{_any(maybe)})\.", r"\s+\S"))
    out.append(_rule("en", True, rf"(?i){_LETTER}(?:{_any(maybe)})\.", r"\p{Lu}\p{Ll}"))
    # Initials; a letter after a figure is a unit.
    out.append(_rule("initials", False, r"(?<![\p{L}\p{M}\p{N}'’°/])(?<!\p{N}\s)\p{L}\.", r"\s*\p{L}"))
    # Short forms in scripts whose own full stop is another mark.
    out.append(_rule("hi", False, r"(?<![\p{L}\p{M}])(?:\p{Devanagari}){1,3}\.", r"\s*\S"))
    # End marks that never mean anything else.
    out.append(_rule("cjk", True, r"[。！？｡]", r"[\s\S]"))
    out.append(_rule("danda", True, r"[।॥۔؟]", r"(?!\p{N})[\s\S]"))
    out.append(_rule("cjk", True, r"[\p{Han}\p{Hiragana}\p{Katakana}]{4}[…]+", r"[^\p{P}]|[“「『]"))
    # No blank after the end mark: a new sentence only if a capital follows a word in small letters, a figure or a sign.
    out.append(_rule("joined", True, r"(?:\p{Ll}{2}|['’]\p{Ll}|\p{N}\p{Lu}?|°\p{Lu}|\p{So}|[\p{Lo}\p{M}])[.!?…]+", r"[\p{P}]*[\p{Lu}][\p{L}\p{M}\s.'’-]"))
    out.append(_rule("joined", True, r"[.!?…]+", r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Devanagari}\p{Arabic}]"))
    out.append(_rule("joined", True, r"[!?]", r"[¿¡“«„\p{Lu}]"))
    out.append(_rule("joined", False, r"[.!?…]+", r"\S"))
    if caseless:
        out.append(_rule("caseless", True, r"[.!?…]+", r"\s+\S"))
    else:
        out.append(_rule("general", True, r"[\p{Lo}\p{M}][!?.]+", r"\s+\S"))
        out.append(_rule("general", True, r"[.!?…]+", rf"\s+{_STARTS}"))
        out.append(_rule("general", True, r"\p{L}{2}\p{Ll}{2}[.]", r"\s+\p{Ll}"))
        out.append(_rule("general", False, r"[.!?…]+", r"\s+\S"))
    return out


def quotation_tables(caseless: bool) -> list[Rule]:
    """The cascade for an end mark that stands inside a closing quotation; ``after`` starts behind the quotation."""
    out = [
        _rule("quotation", False, r"[\s\S]", r"\s*[,;:،、，；：—–-]"),
        _rule("ja", False, r"[」』]", r"\s*[とっはがをにのもでやへ]"),
        _rule("zh", False, r"[”」』]", r"\s*(?:然后|接着|随后|并|便|就|于是|又|还)"),
        _rule("hi", False, r"[\s\S]", rf"\s*(?:{_any(GOING_ON_OTHER)})(?![\p{{L}}\p{{M}}])"),
        _rule("cjk", True, r"[\s\S]", r"\s*[\p{Han}\p{Hiragana}\p{Katakana}]"),
        _rule("cjk", True, r"[。！？…][”」』]", r"\s*[“「『《（\p{N}\p{L}]"),
    ]
    if caseless:
        out.append(_rule("caseless", False, r"[.…]\s*[\p{P}]", rf"\s*(?:{_any(AFTER_STOP + ' ' + SAYING)})(?![\p{{L}}\p{{M}}])"))
        out.append(_rule("caseless", True, r"[.…]\s*[\p{P}]", r"\s*\S"))
        out.append(_rule("caseless", False, r"[!?]\s*[\p{P}]", rf"\s*(?:{_any(GOING_ON + ' ' + SAYING)})(?![\p{{L}}\p{{M}}])"))
        out.append(_rule("caseless", True, r"[\s\S]", r"\s+\S"))
    else:
        out.append(_rule("quotation", False, r"[\s\S]", r"\s*\p{Ll}"))
        out.append(_rule("quotation", True, r"[\s\S]", rf"\s*{_STARTS}"))
    return out


@lru_cache(2)
def _tables(caseless: bool) -> tuple[Compiled, Compiled, Compiled]:
    """Compiled cascades behind full stops, behind other end marks, and behind quotations."""
    rules = tables(caseless)
    return _compiled(rules), _compiled([r for r in rules if not r.stop_only]), _compiled(quotation_tables(caseless))


_ATTRIBUTION = regex.compile(r"\s*[^。！？“”「」]+(?:说|道|问|答|喊|叫|写|说道|问道)[。！？]")
_BLANK = regex.compile(r"\n\s*\n")
_LIST = regex.compile(r"[ \t　]*(?P<mark>[-*•‣▪◦●○–—+·]|\p{N}{1,3}[.)]|[\p{N}]{1,3}[、．]|\(?[a-zA-Z]\))[ \t 　]+(?=\S)")
_SURE = "*•‣▪◦●○"
_CAND = regex.compile(rf"[{regex.escape(ENDS)}]+")
_THAI, _THAI_LETTER = regex.compile(r"\s+"), regex.compile(r"\p{Thai}")
_SEEN = regex.compile(r"\S")
#: Letters where a capital would tell a start: behind the start of a line or an end mark and a blank.
_START = re.compile(r"(?:\n|[.!?…]\s)[\W\d_]*([^\W\d_])")
#: One capital start in so many leaves a text caseless.
CAPITALS = 8
_PAIRED = regex.compile("[" + regex.escape("".join(PAIRS)) + "]")


# What is dropped (invisible characters but the joiner of emoji, and the carriage return of a pair), and what is unified.
_DROP = regex.compile(r"\r(?=\n)|(?![\n\t\r\x0b\x0c\x85\u200d])[\p{Cf}\p{Cc}\p{Cs}]")
_SPACES = {ord(c): " " for c in "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"} | {ord(c): "\n" for c in "\r\x0b\x0c\x85\u2028\u2029"}

_ODD_SPACE = regex.compile("[" + "".join(map(chr, _SPACES)) + "]")


def _visible(text: str) -> tuple[str, range | np.ndarray]:
    """The text without invisible characters, white space unified, and each kept character's place."""
    dropped = [m.start() for m in _DROP.finditer(text)]
    seen = _DROP.sub("", text) if dropped else text
    if _ODD_SPACE.search(seen):
        seen = seen.translate(_SPACES)
    return seen, np.delete(np.arange(len(text)), dropped) if dropped else range(len(text))


@lru_cache(32)
def _marks(opener: str) -> re.Pattern:
    return re.compile("[" + re.escape(opener + PAIRS[opener]) + "]")


def _partners(text: str, opener: str) -> dict[int, int]:
    """Where each ``opener`` is closed, nested ones counted; one pass over its marks."""
    out, open_, closers = {}, [], PAIRS[opener]
    for m in _marks(opener).finditer(text):
        i = m.start()
        if text[i] in closers:
            if open_:
                out[open_.pop()] = i
        else:
            open_.append(i)
    return out


def _spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is_bracket) of outermost quotations and brackets, end exclusive; marks without a partner are ignored."""
    out, known, i = [], {}, 0
    while m := _PAIRED.search(text, i):
        i, c = m.start(), m[0]
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if c in '"”»' and not ((not before or before.isspace() or before in "([（¿¡،,:：") and after and not after.isspace()):
            i += 1
            continue
        if c not in known:
            straight = lambda j: not (text[j + 1 : j + 2].isalnum() and text[j - 1 : j].isspace())
            known[c] = [x.start() for x in re.finditer('"', text) if straight(x.start())] if c == '"' else _partners(text, c)
        if c == '"':
            k = bisect_left(known[c], i + 1)
            end = known[c][k] if k < len(known[c]) else -1
        else:
            end = known[c].get(i, -1)
        if end < 0:
            i += 1
        else:
            out.append((i, end + 1, c in BRACKETS))
            i = end + 1
    return out


def _decide(rules: Compiled, text: str, start: int, stop: int, end: int) -> bool:
    """The verdict of the first rule that matches ``text`` backwards from ``stop`` (not beyond ``start``) and on from ``end``."""
    for left, right, breaks in rules:
        if right.match(text, end) and left.match(text, start, stop):
            return breaks
    return False


#: Words that some rule treats apart; all others that consist of letters only end a sentence before a blank and a start.
_SHORT = frozenset(w.lower() for words in (*NEVER.values(), *NUMBER.values(), *MAYBE.values()) for w in words.split())


def _plain_stop(text: str, a: int, b: int, start: int, caseless: bool) -> bool:
    """A shortcut for the commonest case of the cascade, with the same verdict: an ordinary word, one full stop, white
    space, a capital (or anything in caseless text)."""
    if b != a + 1 or text[a] != "." or b + 1 >= len(text) or text[b] not in " \n" or not (text[b + 1].isupper() or caseless and text[b + 1].islower()):
        return False
    word = text[max(text.rfind(" ", start, a), text.rfind("\n", start, a)) + 1 : a]
    return len(word) > 3 and word.isalpha() and word[1:].islower() and word.lower() not in _SHORT


def _caseless(text: str) -> bool:
    """Whether fewer than one in ``CAPITALS`` of the letters that start a line or follow an end mark and a blank are capitals.

    A share, so a text is read alike at every length; text without cased letters there is caseless too.
    """
    if text.islower():
        return True
    starts = _START.findall("\n" + text)
    capital = sum(map(str.isupper, starts))
    return not capital or capital * CAPITALS < capital + sum(map(str.islower, starts))


def _inside(spans: list[tuple[int, int, bool]], starts: list[int], at: int) -> bool:
    """Whether a position lies strictly inside one of the disjoint spans."""
    k = bisect_left(starts, at) - 1
    return k >= 0 and at < spans[k][1]


def _running(text: str, caseless: bool) -> list[int]:
    """Boundaries (ends of sentences) in running text."""
    stops, others, quoted = _tables(caseless)
    spans = _spans(text) if _PAIRED.search(text) else []
    web = _web(text)
    ends, start, seen = [], 0, len(text.rstrip())
    k, w, core = 0, 0, (-1, 0)
    for m in _CAND.finditer(text):
        a, b = m.span()
        if b <= start:
            continue
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k < len(spans) and spans[k][0] < a:
            s, e, bracket = spans[k]
            if core[0] != k:  # where the last character is that neither closes nor is white space
                last = e - 1
                while last > s and (text[last - 1] in CLOSERS or text[last - 1].isspace()):
                    last -= 1
                core = (k, last)
            if b < core[1]:
                continue
            end = e
            while end < len(text) and text[end] in CLOSERS and not any(x == end for x, _, _ in spans[k + 1 : k + 2]):
                end += 1
            if end < len(text) and text[end] in ENDS:
                continue  # the end mark behind the quotation decides
            opens = not _SEEN.search(text, start, s)
            if bracket and not opens:
                continue
            if opens and text[e - 1] in "”」』" and _ATTRIBUTION.match(text, end):
                continue
            if end < seen and _decide(quoted, text, start, e, end):
                ends.append(end)
                start = end
            continue
        end = b
        while end < len(text) and text[end] in CLOSERS and not (text[end] in '"”“' and any(s == end for s, _, _ in spans[k : k + 2])):
            end += 1
        if end >= seen:
            continue
        while w < len(web) and web[w][1] <= a:
            w += 1
        if w < len(web) and web[w][0] < a and text[b - 1] == "." and _WEB_GOES_ON.match(text, end):
            continue
        if _plain_stop(text, a, b, start, caseless) and end == b or _decide(stops if text[b - 1] == "." else others, text, start, b, end):
            ends.append(end)
            start = end
    if _THAI_LETTER.search(text):
        starts = [s for s, _, _ in spans]
        for m in _THAI.finditer(text):
            a, b = m.span()
            if not a or b == len(text) or _inside(spans, starts, a):
                continue
            left, right = text[a - 1], text[b]
            if left.isdigit() or right.isdigit():
                continue
            if "฀" <= left <= "๿" and (right not in CLOSERS + ENDS + ",;:" or (j := bisect_left(starts, b)) < len(starts) and starts[j] == b):
                ends.append(a)
    return sorted(set(ends))


def _units(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is_entry) of blocks of running text and of list entries, without their marks.

    A line without a mark goes on with the entry above it, unless that one is closed and the line starts anew.
    """
    out, at = [], 0
    for block in [*_BLANK.finditer(text), None]:
        stop = block.start() if block else len(text)
        open_, entry, last, line = -1, False, "", at
        while line < stop:
            end = text.find("\n", line, stop)
            end = stop if end < 0 else end
            body = text[line:end]
            if body.strip():
                m = _LIST.match(body)
                marked = m and (open_ < 0 or entry or m["mark"] in _SURE or last.endswith(":"))
                anew = entry and not marked and last[-1:] in ENDS and body.lstrip()[:1].isupper()
                if (marked or anew) and open_ >= 0:
                    out.append((open_, line, entry))
                if marked or anew or open_ < 0:
                    open_, entry = line + (m.end() if marked else 0), bool(marked)
                last = body.rstrip()
            line = end + 1
        if open_ >= 0:
            out.append((open_, stop, entry))
        at = block.end() if block else stop
    return out


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in order."""
    if not text:
        return []
    seen, at = _visible(text)
    caseless = _caseless(seen)
    out = []
    for a, b, entry in _units(seen):
        part = seen[a:b]
        last = 0
        for end in [*([] if entry else _running(part, caseless)), len(part)]:
            piece = part[last:end]
            head = len(piece) - len(piece.lstrip())
            size = len(piece.strip())
            if size and piece.strip() != "‍":
                first = a + last + head
                out.append((int(at[first]), int(at[first + size - 1]) + 1))
            last = end
    return out


@arrow("array<struct<char_start:int,char_end:int>>")
def _sentences(texts: list) -> list:
    return [[{"char_start": s, "char_end": e} for s, e in sentences(t)] for t in texts]


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_no, char_start, char_end): one pass, no shuffle."""
    rows = spread(documents.select("doc_id", "text").where("text is not null")).select("doc_id", F.posexplode(_sentences("text")).alias("no", "s"))
    return rows.select("doc_id", (F.col("no") + 1).cast("int").alias("sent_no"), "s.char_start", "s.char_end")
