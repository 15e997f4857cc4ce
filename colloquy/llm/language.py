"""Languages of texts and of their segments, by compression.

Each language has a zstandard compressor with a raw-content dictionary of its own text. A word costs, in a language, the
bytes that language's compressor needs for it and its neighbours. The cheapest assignment of languages to words, with a
price for each change, gives the segments; segments of fewer than ``LEAST_RUN`` words (names, medicines, borrowed terms)
join their neighbours. A word in Devanagari or Arabic script has one candidate, Hindi or Urdu; there the runner-up is the
same compressor without a dictionary, and the margin is what the dictionary saves.

A verdict whose margin is narrow is rejected: it can't overrule a label, and below ``REJECT`` (``REJECT_SCRIPT`` for Hindi
and Urdu) it is no verdict at all, the segment is ``und``: that is how texts in other languages, or in no language, come
out, and they are never reported. A close relative that shares most words with a known language (Marathi) passes.

The dictionaries start from seed texts and grow from a bounded sample of labelled rows (``PER_LABEL`` rows of each
label), of which only those are used whose label the seeds confirm.

Null, blank and wordless texts have no language; texts of fewer than six words are labelled but never reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pyspark.sql.functions as F
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window

from colloquy.functions.lazy import arrow
from colloquy.functions.words import words
from colloquy.llm.seeds import SEEDS
from colloquy.session import cut, spread

LANGS = ("en", "de", "fr", "es", "ur-latn", "hi", "ur")
LATIN = LANGS[:5]
#: Labelled rows taken of each label to grow the dictionaries, and the bytes a dictionary may have.
PER_LABEL, DICTIONARY_BYTES = 2_500, 64_000
#: Words a text needs to be reported, and words in a row that make a second language.
LEAST_WORDS, LEAST_RUN = 6, 4
#: Price of a change of language, in bytes; bytes a word of a foreign script costs; the same for a Latin word in a
#: language of another script, where names and medicines are common.
CHANGE, FOREIGN, BORROWED = 8.0, 12.0, 2.5
#: Bytes added for a word that a language's dictionary doesn't hold as a whole: matches inside words mislead.
MISSING = 1.5
#: Narrow margins: bytes a word by which the best language must beat the label's.
MARGIN = 0.35
#: Margins below which a segment has no language: in Latin script, and for Hindi and Urdu (of six words or more).
REJECT, REJECT_SCRIPT = 0.21, 0.3
#: A word whose rate in a second language is more than a SHARED-th of that in the first is a name; less than a STRAY-th, a stray.
SHARED, STRAY = 4, 10
#: Windows whose costs a worker keeps; bounds memory only.
KEPT = 400_000

_DEVANAGARI, _ARABIC, _LATIN_LETTER = regex.compile(r"\p{Devanagari}"), regex.compile(r"\p{Arabic}"), regex.compile(r"\p{Latin}")

_AT, _DOT = r"(?:@|\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+)", r"(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)"
_NET = regex.compile(rf"(?i)[\w+-]+(?:{_DOT}[\w+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)+|\bwww\.\S+")

_NET_HINT = regex.compile(r"(?i)@|\bdot\b|www|[\[(]\s*at\b")


class Languages:
    """The compressors of all languages. ``shared`` words (names, medicines) speak for no language."""

    def __init__(self, texts: dict[str, str], shared: frozenset[str] = frozenset()) -> None:
        self.texts, self.shared = texts, shared
        self._compress = []
        for lang in LATIN:
            table = zstandard.ZstdCompressionDict(texts[lang].encode()[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            table.precompute_compress(level=5)
            self._compress.append(zstandard.ZstdCompressor(level=5, dict_data=table, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        self._scripts = {}
        for lang in ("hi", "ur"):
            table = zstandard.ZstdCompressionDict(texts[lang].encode()[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            table.precompute_compress(level=5)
            self._scripts[lang] = zstandard.ZstdCompressor(level=5, dict_data=table, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        self._plain = zstandard.ZstdCompressor(level=5, write_content_size=False, write_checksum=False).compress
        # Words that no dictionary has are names, medicines or the like as well.
        self.known = frozenset(w for lang in LATIN for w in texts[lang].split()) - shared
        own = [frozenset(texts[lang].split()) for lang in LATIN]
        self._missing = {w: [0.0 if w in o else MISSING for o in own] for w in self.known}
        self._kept: dict[str, list[float]] = {}

    def sizes(self, text: str) -> list[int]:
        """Bytes that each Latin-script language needs for ``text``."""
        data = text.encode()
        return [len(compress(data)) for compress in self._compress]

    def window(self, ws: list[str]) -> list[float]:
        """Cost of one word in each Latin-script language, from a window of words around it; the cheapest is 0."""
        text = " " + " ".join(ws) + " "
        found = self._kept.get(text)
        if found is None:
            sizes = self.sizes(text)
            least, n = min(sizes), len(ws)
            found = [(s - least) / n * 2 for s in sizes]
            if len(self._kept) >= KEPT:
                self._kept.clear()
            self._kept[text] = found
        return found

    def costs(self, ws: list[str]) -> list[list[float]]:
        """For each word its cost in each language, the cheapest at 0."""
        out, latin = [], []
        for i, w in enumerate(ws):
            if w.isascii() or not (d := _DEVANAGARI.search(w)) and not _ARABIC.search(w):
                if w in self.known:
                    latin.append(i)
                out.append(_NEUTRAL)
            else:
                out.append(_HINDI if d else _URDU)
        for k, i in enumerate(latin):
            row = self.window([ws[j] for j in latin[max(0, k - 2) : k + 3]])
            row = [a + b for a, b in zip(row, self._missing[ws[i]])]
            least = min(row)
            out[i] = [x - least for x in row] + [BORROWED] * (len(LANGS) - len(LATIN))
        return out

    def segments(self, ws: list[str]) -> list[tuple[int, int, str, float]]:
        """(first word, end, language, margin in bytes a word); no segment for no word."""
        if not ws:
            return []
        costs = self.costs(ws)
        totals = [sum(column) for column in zip(*costs)]
        least = min(totals)
        if least <= CHANGE or len(ws) < 2 * LEAST_RUN:  # no change of language can pay
            lang = totals.index(least)
            return [(0, len(ws), LANGS[lang], (min(totals[:lang] + totals[lang + 1 :]) - least) / len(ws))]
        best, back, every = list(costs[0]), [], range(len(LANGS))
        for row in costs[1:]:
            low = min(best)
            jump, paid = best.index(low), low + CHANGE
            back.append([k if best[k] <= paid else jump for k in every])
            best = [min(best[k], paid) + row[k] for k in every]
        at = best.index(min(best))
        path = [at]
        for step in reversed(back):
            at = step[at]
            path.append(at)
        path.reverse()
        runs: list[list[int]] = []
        for i, lang in enumerate(path):
            if runs and runs[-1][2] == lang:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1, lang])
        while len(runs) > 1 and min(b - a for a, b, _ in runs) < LEAST_RUN:
            k = min(range(len(runs)), key=lambda j: runs[j][1] - runs[j][0])
            into = max((j for j in (k - 1, k + 1) if 0 <= j < len(runs)), key=lambda j: runs[j][1] - runs[j][0])
            runs[into] = [min(runs[into][0], runs[k][0]), max(runs[into][1], runs[k][1]), runs[into][2]]
            del runs[k]
            runs = [r for j, r in enumerate(runs) if not j or runs[j - 1][2] != r[2] or _grow(runs[j - 1], r)]
        out = []
        for a, b, lang in runs:
            total = [sum(row[k] for row in costs[a:b]) for k in every]
            out.append((a, b, LANGS[lang], (min(total[:lang] + total[lang + 1 :]) - total[lang]) / (b - a)))
        return _merged(out)

    def whole(self, ws: list[str]) -> tuple[str, float]:
        """(language, margin in bytes a word) of words taken as one piece: one compression a language."""
        if not ws:
            return "none", 0.0
        hindi = urdu = 0
        known = []
        for w in ws:
            if w in self.known:
                known.append(w)
            elif not w.isascii():
                hindi += bool(_DEVANAGARI.search(w))
                urdu += bool(_ARABIC.search(w))
        if max(hindi, urdu) > len(known):
            return ("hi", FOREIGN) if hindi > urdu else ("ur", FOREIGN)
        sizes = self.sizes(" ".join(known)) if known else [0] * len(LATIN)
        costs = [s + sum(self._missing[w][k] for w in known) for k, s in enumerate(sizes)]
        best = costs.index(min(costs))
        return LATIN[best], (min(costs[:best] + costs[best + 1 :]) - costs[best]) / len(ws)

    def saved(self, ws: list[str], lang: str) -> float:
        """Bytes a word that the dictionary of Hindi or Urdu saves on the words of its script."""
        own = [w for w in ws if (_DEVANAGARI if lang == "hi" else _ARABIC).search(w)]
        data = (" " + " ".join(own) + " ").encode()
        return (len(self._plain(data)) - len(self._scripts[lang](data))) / max(1, len(own))

    def told(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """Segments over all words of a text, rejected ones as ``und``; addresses of the net are blanked out word by word, they are no language."""
        if text and _NET_HINT.search(text):
            text = _NET.sub(lambda m: " ".join("0" for _ in words(m[0])), text)
        ws = words(text)
        out = []
        for a, b, lang, margin in self.segments(ws):
            if lang in self._scripts:
                margin = min(margin, max(0.0, self.saved(ws[a:b], lang)))
                out.append((a, b, lang if margin >= REJECT_SCRIPT or b - a < LEAST_WORDS else "und", margin))
            else:
                out.append((a, b, lang if margin >= REJECT else "und", margin))
        return _merged(out)


_NEUTRAL = [0.0] * len(LANGS)
_HINDI = [0.0 if lang == "hi" else FOREIGN for lang in LANGS]
_URDU = [0.0 if lang == "ur" else FOREIGN for lang in LANGS]


def _grow(left: list[int], right: list[int]) -> bool:
    left[1] = right[1]
    return False


def _merged(runs: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    out: list[tuple[int, int, str, float]] = []
    for a, b, lang, margin in runs:
        if out and out[-1][2] == lang:
            c, d, _, m = out[-1]
            out[-1] = (c, b, lang, (m * (d - c) + margin * (b - a)) / (b - c))
        else:
            out.append((a, b, lang, margin))
    return out


def confidence(margin: float) -> float:
    """Margin in bytes a word as a value from 0 to 1."""
    return max(0.0, margin) / (max(0.0, margin) + 1.0)


def label(text: str | None) -> str | None:
    """The language a label names, or None: case and region suffixes don't count, script suffixes do."""
    tag = (text or "").strip().lower().replace("_", "-")
    parts = tag.split("-")
    if parts[:2] == ["ur", "latn"]:
        return "ur-latn"
    return parts[0] if parts[0] in ("en", "de", "fr", "es", "hi", "ur") else (parts[0] if len(parts[0]) in (2, 3) and parts[0].isalpha() and parts[0] not in ("und", "xx", "zxx", "mis", "mul", "nan", "na") else None)


def grown(rows: Iterable[tuple[str, str]], rounds: int = 3) -> Languages:
    """Dictionaries from labelled (text, label) rows that the dictionaries so far confirm, starting from the seeds.

    What stays undecided is taken in the last round if its label is the usual one of at least three rows that say the
    same but for figures. A row is used only if most of its word triples are new to its dictionary, so repetitive corpora still yield
    varied dictionaries. Words met in two languages that no seed has are taken for names and dropped.
    """
    seeds = {lang: words(text) for lang, text in SEEDS.items()}
    seeded = {w for lang in LATIN for w in seeds[lang]}
    model = Languages({lang: " ".join(ws) for lang, ws in seeds.items()})
    votes: dict[str, Counter[str]] = {}
    for text, tag in rows:
        if (lang := label(tag)) in LANGS:
            votes.setdefault(" ".join(w for w in words(_NET.sub(" ", text)) if not w.isdigit()), Counter())[lang] += 1
    left = sorted((text, lang) for text, langs in votes.items() if " " in text for lang in langs)
    taken: dict[str, list[str]] = {lang: [] for lang in LANGS}
    met: dict[str, Counter[str]] = {lang: Counter() for lang in LANGS}
    for turn in range(rounds):
        rest = []
        for text, tag in left:
            ws = text.split(" ")
            found = model.segments(ws)
            usual = votes[text].most_common(1)[0]
            if turn == rounds - 1 and usual[0] == tag and usual[1] >= 3 and usual[1] > 0.6 * votes[text].total() and len(found) == 1 and found[0][3] < MARGIN:
                taken[tag].append(text)
            elif len(found) > 1 or found[0][2] != tag:
                rest.append((text, tag))
            elif found[0][3] >= (MARGIN if turn == 0 else MARGIN / 2):
                met[tag].update(ws)
                taken[tag].append(text)
            else:
                rest.append((text, tag))
        left = rest
        # How often a word is met in each language: about as often in two means a name, rarely beside often a stray.
        rates = {w: sorted(((met[lang][w] / max(1, met[lang].total()), lang) for lang in LATIN), reverse=True) for lang in LATIN for w in met[lang]}
        shared = {w for w, r in rates.items() if r[1][0] * SHARED > r[0][0]} - seeded
        stray = {(lang, w) for w, r in rates.items() for rate, lang in r if 0 < rate * STRAY < r[0][0] and w not in seeds[lang]}
        out = {}
        for lang in LANGS:
            body, triples, size = [], set(), 0
            for text in taken[lang]:
                ws = [w for w in text.split(" ") if w not in shared and (lang, w) not in stray]
                fresh = set(zip(ws, ws[1:], ws[2:])) - triples
                if len(fresh) * 2 > len(ws) - 2 and size < DICTIONARY_BYTES:
                    triples |= fresh
                    body.append(" ".join(ws))
                    size += len(body[-1].encode()) + 1
            out[lang] = " ".join([*body, *seeds[lang]])
        model = Languages(out, frozenset(shared))
    return model


def records(intents: DataFrame, chat_logs: DataFrame) -> DataFrame:
    """(rec_id, turn_pos, text, given): every text of both tables, each once."""
    own = intents.select(F.col("id").cast("string").alias("rec_id"), F.lit(-1).alias("turn_pos"), "text", F.col("lang").alias("given"))
    turns = chat_logs.select(F.col("session_id").cast("string").alias("rec_id"), F.posexplode("turns").alias("turn_pos", "t"))
    turns = turns.where("t is not null").select("rec_id", "turn_pos", F.col("t.text").alias("text"), F.col("t.lang").alias("given"))
    return own.unionByName(turns).where("text is not null")


def fit(rows: DataFrame, per_label: int = PER_LABEL) -> Languages:
    """Dictionaries from at most ``per_label`` rows of each label, those with the least hashes.

    Labels are counted first; a frequent label's rows are cut by a hash threshold that twice as many rows pass as are
    wanted, before anything is sorted, so no task gets all rows of a label.
    """
    tag = F.lower(F.trim("given"))
    pool = rows.where(tag.isin([*LANGS])).select("rec_id", "turn_pos", "text", tag.alias("tag"), F.xxhash64("rec_id", "turn_pos").alias("hash")).where(F.length("text") > 20)
    counts = {r["tag"]: r["count"] for r in pool.groupBy("tag").count().collect()}  # one row a language
    threshold = F.lit(None).cast("bigint")
    for lang, n in counts.items():
        least = (1 << 64) * min(1.0, (2 * per_label + 200) / n) - (1 << 63)
        threshold = F.when(F.col("tag") == lang, F.lit(min(int(least), (1 << 63) - 1))).otherwise(threshold)
    order = Window.partitionBy("tag").orderBy("hash", "rec_id", "turn_pos", "text")
    sample = pool.where(F.col("hash") <= threshold).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_label)
    return grown((r["text"], r["tag"]) for r in sample.select("text", "tag").orderBy("tag", "k").collect())


def segmented(rows: DataFrame, model: Languages, text: str = "text") -> Column:
    """array<struct<first,end,lang,margin>> of a text column."""
    shared = rows.sparkSession.sparkContext.broadcast((model.texts, model.shared))
    state: dict[str, Languages] = {}

    @arrow("array<struct<first:int,end:int,lang:string,margin:double>>")
    def each(texts: list) -> list:
        if "model" not in state:
            state["model"] = Languages(*shared.value)
        languages = state["model"]
        kept: dict[str, list] = {}
        out = []
        for t in texts:
            if t not in kept:
                kept[t] = [{"first": a, "end": b, "lang": lang, "margin": m} for a, b, lang, m in languages.told(t)]
            out.append(kept[t])
        return out

    return each(F.col(text))


@arrow("string")
def _labels(tags: list) -> list:
    return [label(t) for t in tags]


def labelled(intents: DataFrame, chat_logs: DataFrame) -> DataFrame:
    """(rec_id, turn_pos, seg_no, first_word, end_word, lang, confidence, given): each segment of each text."""
    rows = records(intents, chat_logs)
    model = fit(rows)
    told = spread(rows).withColumn("segments", segmented(rows, model))
    told = told.select("rec_id", "turn_pos", "given", F.posexplode("segments").alias("seg_no", "s"))
    margin = F.greatest(F.lit(0.0), F.col("s.margin"))
    return told.select("rec_id", "turn_pos", "seg_no", F.col("s.first").alias("first_word"), F.col("s.end").alias("end_word"), "s.lang", (margin / (margin + 1)).alias("confidence"), "given").distinct()


def found(intents: DataFrame, chat_logs: DataFrame) -> DataFrame:
    """(rec_id, turn_pos, lang): the languages of texts whose label is absent or wrong, or that mix languages."""
    rows = records(intents, chat_logs)
    model = fit(rows)
    told = spread(rows).select("rec_id", "turn_pos", _labels("given").alias("given"), segmented(rows, model).alias("s"))
    told = told.where(F.get("s", F.size("s") - 1)["end"] >= LEAST_WORDS).withColumn("s", F.filter("s", lambda x: x["lang"] != "und"))
    langs = F.array_distinct(F.transform("s", lambda x: x["lang"]))
    wrong = F.col("given").isNull() | ((F.col("given") != F.get("langs", F.lit(0))) & (F.get("s", F.lit(0))["margin"] >= MARGIN))
    told = told.withColumn("langs", langs).where((F.size("langs") > 1) | ((F.size("langs") == 1) & wrong))
    return told.select("rec_id", "turn_pos", F.explode("langs").alias("lang")).distinct()
