"""Personal information in free text: a semi-Markov conditional random field over whole spans.

Candidate spans of each kind are proposed from the shape of tokens (number groups, codes of letters and digits, mail
patterns, runs of words that are capitalised, unknown or follow words that introduce names, runs that hold a figure and
such a word); a linear model scores each span as a whole (its shape, its content, its neighbours) and each pair of kinds
that follow one another in a turn, everything outside spans scores zero, and dynamic programming over segments of bounded
length picks the best set of spans, boundaries and types together. The bounds are ``NAME_TOKENS``, ``ADDRESS_TOKENS`` and
``NUMBER_GROUPS``; a run of more number groups is still a candidate as a whole, and so is a single group of any length,
so no digits are left standing beside a placeholder for want of a candidate. The model is trained here, on synthetic
turns, by stochastic gradient ascent of the conditional likelihood with exact marginals over the lattice of candidates;
a process trains it once.

Null, empty and blank turns have no spans. Offsets count code points. Titles are no part of a name. Sessions delivered
twice count once.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame

from colloquy.functions.lazy import arrow
from colloquy.llm.personal_seeds import Maker, introductions, literal_words
from colloquy.llm.seeds import SEEDS
from colloquy.session import spread

KINDS = ("name", "email", "phone", "identity", "address")
#: Synthetic turns to train on, passes over them, regularisation, and the bounds of spans in tokens.
TURNS, PASSES, SHRINK, NAME_TOKENS, ADDRESS_TOKENS, NUMBER_GROUPS = 8_000, 3, 1e-5, 8, 16, 12
#: Turns whose spans a worker keeps; bounds memory only.
KEPT = 100_000

_TOKEN = regex.compile(r"(?V1)\p{Han}|[[\p{L}\p{M}]--\p{Han}]+(?:['’][\p{L}\p{M}]+)*|\p{N}+|[^\s]")
_PART, _HOST = r"[\p{L}\p{N}_+%-]+", r"[\p{L}\p{N}-]+"
#: Mail addresses by style: as they are, with the signs in brackets, with the signs in words.
_EMAILS = {
    style: (regex.compile(rf"(?i){_PART}(?:{dot}{_PART})*{at}{_HOST}(?:{dot}{_HOST})+"), regex.compile(f"(?i){at}"), regex.compile(f"(?i){dot}"))
    for style, at, dot in (("plain", "@", r"\."), ("bracket", r"\s?[\[({]\s?at\s?[\])}]\s?", r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"), ("words", r"\s+at\s+", r"(?:\s+dot\s+)"))
}
_HAN = regex.compile(r"\p{Han}")
_CODE = regex.compile(r"(?<![\p{L}\p{M}\p{N}])(?=\p{N}*[\p{L}])(?=\p{L}*\p{N})[\p{L}\p{N}]+(?![\p{L}\p{M}\p{N}])")
_GROUPS = regex.compile(r"[+(]{0,2}\p{N}(?:[\p{N}().+/\s-]{0,3}\p{N})*")
#: Digits spelled out, words of addresses, titles, by language.
SPELLED = "zero one two three four five six seven eight nine oh double triple null eins zwei drei vier fünf sechs sieben acht neun zéro un deux trois quatre cinq six sept huit neuf cero uno dos tres cuatro cinco seis siete ocho nueve sifar aik do teen chaar paanch chhe saat aath nau".split()
STREETS = "street st road rd lane ln ave avenue crescent drive close court way square place colony town block mohalla gali makan ghar house flat unit apt apartment rue boulevard calle avenida plaza paseo carrera weg straße strasse platz allee gasse tor ufer ring piso planta".split()
TITLES = "dr dr. doctor mr mrs ms miss prof nurse sister frau herr mme m señor señora doktor sir madam".split()
_STREET_END = regex.compile(r"(?i)\p{L}{3,}(?:weg|straße|strasse|platz|gasse|allee|ufer|ring|damm)$")
_SPELLED, _STREETS, _TITLES = frozenset(SPELLED), frozenset(STREETS), frozenset(TITLES)
_JOINING = frozenset({"de", "la", "del", "der", "dem", "den", "am", "an", "im", "du", "des", "bis", "ter", "number", "no", "nr"})


@lru_cache(1)
def common() -> frozenset[str]:
    """Everyday words of the seeds and templates; unknown words look more like names."""
    out = literal_words()
    for text in SEEDS.values():
        out.update(t.lower() for t in _TOKEN.findall(text))
    return frozenset(out)


def _shape(token: str) -> str:
    if token[0].isdigit() or token.isnumeric():
        return "9"
    if not token[0].isalpha():
        return token
    if _HAN.match(token):
        return "h"
    if len(token) == 1:
        return "I" if token.isupper() else "i"
    if token.isupper():
        return "XX"
    if token[0].isupper():
        return "Xx"
    return "x" if token[0].islower() else "o"


class Turn:
    """A text with its tokens and candidate spans: (first token, end token, kind, features)."""

    def __init__(self, text: str) -> None:
        self.text = text
        found = list(_TOKEN.finditer(text))
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        self.tokens = [m[0] for m in found]
        self.lower = [t.lower() for t in self.tokens]
        self.shapes = [_shape(t) for t in self.tokens]
        self.known = [w in common() for w in self.lower]
        self._first = {s: i for i, s in enumerate(self.starts)}
        self._last = {e: i + 1 for i, e in enumerate(self.ends)}
        self.spans: list[tuple[int, int, str, list[str]]] = []
        self._taken: set[tuple[int, int, str]] = set()
        self._lefts: dict[int, list[str]] = {}
        self._rights: dict[int, list[str]] = {}
        if "@" in text or "at" in text or "AT" in text or "At" in text:
            for style, (pattern, at, dot) in _EMAILS.items():
                for m in pattern.finditer(text, overlapped=True):
                    self._email(m, style, at, dot)
        self._numbers()
        self._names()
        self._addresses()

    def _before(self, i: int) -> list[str]:
        """What stands before token ``i``; worked out once."""
        got = self._lefts.get(i)
        if got is None:
            low = self.lower
            p1, p2 = low[i - 1] if i else "<s>", low[i - 2] if i > 1 else "<s>"
            if i and "\n" in self.text[self.ends[i - 1] : self.starts[i]]:
                p1, p2 = "<s>", "<s>"
            got = self._lefts[i] = [f"p1={p1}", f"p2={p2} {p1}"]
        return got

    def _after(self, j: int) -> list[str]:
        """What stands from token ``j`` on."""
        got = self._rights.get(j)
        if got is None:
            low = self.lower
            n1, n2 = low[j] if j < len(low) else "</s>", low[j + 1] if j + 1 < len(low) else "</s>"
            if j < len(low) and "\n" in self.text[self.ends[j - 1] : self.starts[j]]:
                n1, n2 = "</s>", "</s>"
            got = self._rights[j] = [f"n1={n1}", f"n2={n1} {n2}"]
        return got

    def _add(self, i: int, j: int, kind: str, features: list[str]) -> None:
        if (i, j, kind) not in self._taken:
            self._taken.add((i, j, kind))
            self.spans.append((i, j, kind, ["bias", *self._before(i), *self._after(j), *features]))

    def _email(self, m: regex.Match, style: str, at: regex.Pattern, dot: regex.Pattern) -> None:
        """Every start of a word before the sign is proposed, as words before a disguised address aren't part of it."""
        j = self._last.get(m.end())
        if j is None:
            return
        sign = at.search(m[0]).start() + m.start()
        for i in range(j):
            if m.start() <= self.starts[i] < sign:
                before = self.text[self.starts[i] - 1 : self.starts[i]]
                glued = bool(before) and not before.isspace()
                parts = len(dot.findall(self.text[self.starts[i] : sign]))
                self._add(i, j, "email", [style, f"{style},glued={glued}", f"parts={parts},{style}", f"whole={self.starts[i] == m.start()},{style}", f"first={self.lower[i]}" if self.known[i] else "first new"])

    def _numbers(self) -> None:
        for m in _GROUPS.finditer(self.text):
            groups = [(g.start() + m.start(), g.end() + m.start()) for g in regex.finditer(r"\p{N}+", m[0])]
            if sum(b - a for a, b in groups) < 6:
                continue
            for x in range(len(groups)):
                digits = 0
                for y in range(x, min(len(groups), x + NUMBER_GROUPS)):
                    digits += groups[y][1] - groups[y][0]
                    if digits >= 6:
                        self._number(m, groups, x, y, digits)
            if len(groups) > NUMBER_GROUPS:
                self._number(m, groups, 0, len(groups) - 1, sum(b - a for a, b in groups))
        for m in _CODE.finditer(self.text):
            digits = sum(c.isdigit() for c in m[0])
            i, j = self._first.get(m.start()), self._last.get(m.end())
            if digits >= 5 and i is not None and j is not None:
                self._add(i, j, "identity", [f"code={min(digits, 20)}", f"letters={min(len(m[0]) - digits, 4)},{m[0].isupper()}", f"code shape={self.shapes[i]} {min(j - i, 4)}"])
        # Letters before a number belong to identity numbers; spelled digits are telephone numbers.
        i, low = 0, self.lower
        while i < len(low):
            if low[i] in _SPELLED:
                j = i
                while j < len(low) and low[j] in _SPELLED:
                    j += 1
                if j - i >= 6:
                    self._add(i, j, "phone", ["spelled", f"spelled={min(j - i, 12)}"])
                i = j
            else:
                i += 1

    def _number(self, m: regex.Match, groups: list[tuple[int, int]], x: int, y: int, digits: int) -> None:
        text = self.text
        start, end = groups[x][0], groups[y][1]
        lead = ""
        if text[start - 1 : start] == "(" and ")" in text[start:end]:
            start, lead = start - 1, "("
        if text[start - 1 : start] == "+":
            start, lead = start - 1, "+" + lead
        i, j = self._first.get(start), self._last.get(end)
        if i is None or j is None:
            return
        digits = min(digits, 20)
        sizes = [min(b - a, 16) for a, b in groups[x : y + 1]]
        pattern = "-".join(map(str, sizes)) if len(sizes) <= 6 else f"{min(sizes)}..{max(sizes)}x{min(len(sizes), NUMBER_GROUPS)}"
        gaps = "".join(sorted({text[a:b] for (_, a), (b, _) in zip(groups[x:y], groups[x + 1 : y + 1])}))
        head = lead or ("00" if text[start:end].startswith("00") else "0" if text[start] in "0۰०" else "9")
        more = x > 0, y + 1 < len(groups)
        glued = (text[start - 1 : start].isalnum(), text[end : end + 1].isalnum())
        shape = [f"digits={digits}", f"groups={pattern}", f"gaps={gaps}", f"head={head}", f"head={head},digits={digits}", f"head={head},groups={pattern}", f"more={more}", f"glued={glued}", f"slash={'/' in gaps},{head}", f"wide={'  ' in gaps or ' / ' in gaps}"]
        self._add(i, j, "phone", shape)
        self._add(i, j, "identity", shape)
        if i and self.tokens[i - 1].isalpha() and len(self.tokens[i - 1]) <= 3 and self.starts[i] - self.ends[i - 1] <= 1:
            letters = self.tokens[i - 1]
            self._add(i - 1, j, "identity", [f"letters={len(letters)},{letters.isupper()}", f"letters={len(letters)},digits={digits}", f"letters known={self.known[i - 1]}", f"groups={pattern},letters"])

    def _names(self) -> None:
        n, tokens, shapes, known, low = len(self.tokens), self.tokens, self.shapes, self.known, self.lower
        words_ = [s in ("Xx", "XX", "x", "o", "I", "i") and w not in _TITLES for s, w in zip(shapes, low)]
        fit = [f and (not k or s == "Xx" or s == "I") for f, s, k in zip(words_, shapes, known)]
        fit = [f or s in ("I", "i") and j + 1 < n and tokens[j + 1] == "." for j, (f, s) in enumerate(zip(fit, shapes))]
        for i in range(n):
            if shapes[i] == "h":
                for j in range(i + 2, min(n, i + 4) + 1):
                    if shapes[j - 1] != "h" or self.ends[j - 2] != self.starts[j - 1]:
                        break
                    self._name(i, j, j - i)
                continue
            introduced = words_[i] and i > 0 and (low[i - 2] if i > 1 else "", low[i - 1]) in introductions()
            if not (fit[i] or introduced) or (i and tokens[i - 1] in ("@", "_", "+") and self.ends[i - 1] == self.starts[i]):
                continue
            words, j = 0, i
            while j < min(n, i + NAME_TOKENS) and words < 5:
                if fit[j] or introduced and words_[j]:
                    words += 1
                    j += 1
                    self._name(i, j, words)
                elif tokens[j] == "." and shapes[j - 1] in ("I", "i") or tokens[j] in (",", "-") and j + 1 < n and fit[j + 1] and shapes[j - 1] not in ("I", "i"):
                    j += 1
                else:
                    break

    def _name(self, i: int, j: int, words: int) -> None:
        shapes = self.shapes[i:j]
        if words == 1 and len(self.tokens[i]) < 2:
            return
        shape = " ".join(shapes)
        unknown = sum(not k for k, s in zip(self.known[i:j], shapes) if s[0].isalpha())
        first = not i or self.tokens[i - 1] in ".!?:\n"
        after = self.shapes[j] if j < len(self.tokens) else "</s>"
        before = self.shapes[i - 1] if i else "<s>"
        near = [*self._before(i), *self._after(j)]
        features = [f"shape={shape}", f"words={words}", f"known={words - unknown}", f"known={words - unknown},{shape}", f"first={first},{shape}", f"after={after}", f"before={before}", f"shape={shape},{near[0]}", f"words={words},{near[2]}", f"title={self.lower[i - 1] in _TITLES or self.lower[i - 2 : i] and self.lower[i - 2] in _TITLES and self.tokens[i - 1] == '.' if i else False}"]
        features += [f"end={self.lower[j - 1][-3:]}", f"end={self.lower[j - 1][-4:]}"]
        if j < len(self.tokens):
            more = self.shapes[j] in ("Xx", "XX", "x", "o") and not self.known[j]
            features.append(f"more={more},{after},{shape}")
        if i:
            more = self.shapes[i - 1] in ("Xx", "XX", "x", "o") and not self.known[i - 1]
            features.append(f"less={more},{before}")
        features.append(f"comma={',' in self.tokens[i:j]},{words}")
        self._add(i, j, "name", features)

    def _addresses(self) -> None:
        n, low, shapes = len(self.tokens), self.lower, self.shapes
        cue = [w in _STREETS or bool(_STREET_END.search(w)) for w in low]
        if "9" not in shapes:
            return
        fit = [c or s == "9" or s in (",", "-", "/", ".", "º", "ª") or w in _JOINING or (s in ("I", "i")) or (s in ("Xx", "XX", "x", "o") and (not k or s == "Xx")) for c, s, w, k in zip(cue, shapes, low, self.known)]
        # A full stop belongs to an address only inside it: before an ordinal sign, or after a short form.
        for k in range(n):
            if shapes[k] == "." and not (k + 1 < n and self.tokens[k + 1] in "ºª" or k and low[k - 1] in ("st", "rd", "ave", "apt", "no", "nr", "str")):
                fit[k] = False
        opens = [s == "9" or c or s == "Xx" for s, c in zip(shapes, cue)]
        for i in range(n):
            if not opens[i]:
                continue
            figures = cues = named = 0
            for j in range(i + 1, min(n, i + ADDRESS_TOKENS) + 1):
                if not fit[j - 1]:
                    break
                figures += shapes[j - 1] == "9"
                cues += cue[j - 1]
                named += shapes[j - 1] in ("Xx", "XX", "o")
                if not figures or shapes[j - 1] in (",", "-", "/", ".") or j - i < 2 or not (cues or named):
                    continue
                self._address(i, j, figures, cues, cue)

    def _address(self, i: int, j: int, figures: int, cues: int, cue: list[bool]) -> None:
        low, shapes = self.lower, self.shapes
        kind = lambda k: ("cue" if cue[k] else shapes[k] if not self.known[k] else "known") if 0 <= k < len(low) else "none"
        start, end, before, after = kind(i), kind(j - 1), kind(i - 1), kind(j)
        hint = lambda k: low[k] if cue[k] and not _STREET_END.search(low[k]) else kind(k)
        inner = [hint(k) for k in range(i, j)]
        plain = sum(self.known[k] and not cue[k] and low[k] not in _JOINING and shapes[k] not in (",", "-", "/", ".", "9") for k in range(i, j))
        stop = "".join(t for t in self.tokens[j : j + 1] if t in ",-/.")
        features = [f"start={start}", f"end={end}", f"start={hint(i)}", f"end={hint(j - 1)}", f"before={before}", f"after={after}", f"figures={min(figures, 4)}", f"cues={min(cues, 4)}", f"cues={cues},figures={figures}", f"plain={min(plain, 3)}", f"after={after},end={end}", f"before={before},start={start}", f"stop={stop},{kind(j + 1)}", f"stop={stop},{kind(j + 1)},{end}", f"skeleton={' '.join(inner)}", f"length={j - i}"]
        features += [f"has {w}" for w in set(inner)]
        self._add(i, j, "address", features)


#: Score of what can't be.
NEVER = -1e9
#: What came last in a turn: nothing yet, or a kind.
STATES = ("none", *KINDS)


class SpanModel:
    """Weights of span features by kind and of successions of kinds; exact inference over the lattice of candidates.

    A state is the kind of the last span so far, so a span is scored with the kind that came before it in the turn.
    """

    def __init__(self, weights: dict[str, dict[str, float]] | None = None) -> None:
        self.weights = weights if weights is not None else {kind: {} for kind in (*KINDS, "after")}

    def scores(self, turn: Turn) -> list[float]:
        """The score of each candidate without what came before it."""
        gets = {kind: self.weights[kind].get for kind in KINDS}
        return [sum([get(f, 0.0) for f in features]) for get, features in ((gets[kind], features) for _, _, kind, features in turn.spans)]

    def _after(self) -> list[list[float]]:
        get = self.weights["after"].get
        return [[get(f"{a}>{b}", 0.0) for b in KINDS] for a in STATES]

    def best(self, turn: Turn) -> list[tuple[int, int, str]]:
        """(first token, end token, kind) of the best segmentation."""
        if not turn.spans:
            return []
        after, scores = self._after(), self.scores(turn)
        order = sorted(range(len(turn.spans)), key=lambda k: turn.spans[k][1])
        # best[state] at the last position reached, as (score, chain of spans); kept for every position where a span ends.
        now: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        at, marks = [0], [dict(now)]
        for k in order:
            i, j, kind, _ = turn.spans[k]
            if at[-1] != j:
                at.append(j)
                marks.append(dict(marks[-1]))
            before, to = marks[bisect_right(at, i) - 1], KINDS.index(kind)
            score, came = max(((s + after[state][to], state) for state, (s, _) in before.items()), key=lambda x: x[0])
            score += scores[k]
            if to + 1 not in marks[-1] or score > marks[-1][to + 1][0]:
                marks[-1][to + 1] = (score, (k, before[came][1]))
        chain, out = max(marks[-1].values(), key=lambda x: x[0])[1], []
        while chain:
            i, j, kind, _ = turn.spans[chain[0]]
            out.append((i, j, kind))
            chain = chain[1]
        return out[::-1]

    def marginals(self, turn: Turn) -> tuple[list[float], dict[str, float]]:
        """(probability of each candidate, expected number of each succession of kinds), by forward and backward sums.

        Only kinds that the turn has candidates of can be states of it.
        """
        scores, spans = self.scores(turn), turn.spans
        here = sorted({s[2] for s in spans})
        states, to_ = ["none", *here], [here.index(s[2]) for s in spans]
        get = self.weights["after"].get
        after = [[get(f"{a}>{b}", 0.0) for b in here] for a in states]
        cuts = sorted({0} | {s[0] for s in spans} | {s[1] for s in spans})
        place = {c: k for k, c in enumerate(cuts)}
        first, last = [place[s[0]] for s in spans], [place[s[1]] for s in spans]
        n, every = len(cuts), range(len(states))
        starts: list[list[int]] = [[] for _ in range(n)]
        ends: list[list[int]] = [[] for _ in range(n)]
        for k in range(len(spans)):
            starts[first[k]].append(k)
            ends[last[k]].append(k)
        forward = [[0.0] + [NEVER] * len(here)]
        came = [0.0] * len(spans)
        for c in range(1, n):
            sums = [[v] for v in forward[c - 1]]
            for k in ends[c]:
                row, to = forward[first[k]], to_[k]
                came[k] = _logsum([row[a] + after[a][to] for a in every])
                sums[to + 1].append(came[k] + scores[k])
            forward.append([_logsum(x) for x in sums])
        backward = [[0.0] * len(states)] * n
        for c in range(n - 2, -1, -1):
            backward[c] = backward[c + 1]
            if starts[c]:
                on = [(to_[k], scores[k] + backward[last[k]][to_[k] + 1]) for k in starts[c]]
                backward[c] = [_logsum([backward[c + 1][a], *[v + after[a][to] for to, v in on]]) for a in every]
        total = _logsum(forward[-1])
        out, pairs = [], dict.fromkeys((f"{a}>{b}" for a in states for b in here), 0.0)
        for k in range(len(spans)):
            tail = scores[k] + backward[last[k]][to_[k] + 1] - total
            out.append(math.exp(came[k] + tail))
            if out[-1] > 1e-6:
                for a in every:
                    pairs[f"{states[a]}>{spans[k][2]}"] += math.exp(forward[first[k]][a] + after[a][to_[k]] + tail)
        return out, pairs

    def fit(self, examples: list[tuple[Turn, set[tuple[int, int, str]]]], passes: int, seed: int = 5) -> None:
        """Adaptive gradient ascent of the conditional log-likelihood."""
        seen: dict[str, dict[str, float]] = {kind: defaultdict(lambda: 1e-3) for kind in self.weights}
        rnd = random.Random(seed)

        def move(kind: str, feature: str, step: float) -> None:
            weights, squares = self.weights[kind], seen[kind]
            w = weights.get(feature, 0.0)
            g = step - SHRINK * w
            squares[feature] = sq = squares[feature] + g * g
            weights[feature] = w + 0.25 * g / sq**0.5

        for _ in range(passes):
            rnd.shuffle(examples)
            for turn, gold in examples:
                if not turn.spans:
                    continue
                chances, pairs = self.marginals(turn)
                last = "none"
                for _, _, kind in sorted(gold):
                    pairs[f"{last}>{kind}"] -= 1
                    last = kind
                for pair, p in pairs.items():
                    if abs(p) > 1e-3:
                        move("after", pair, -p)
                for p, (i, j, kind, features) in zip(chances, turn.spans):
                    step = ((i, j, kind) in gold) - p
                    if -1e-3 < step < 1e-3:
                        continue
                    for f in features:
                        move(kind, f, step)


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum([math.exp(v - top) for v in values])) if len(values) > 1 else top


def example(text: str, spans: list[tuple[str, int, int]]) -> tuple[Turn, set[tuple[int, int, str]]]:
    turn = Turn(text)
    gold = {(turn._first[s], turn._last[e], kind) for kind, s, e in spans if s in turn._first and e in turn._last}
    return turn, gold & turn._taken


@lru_cache(4)
def train(turns: int = TURNS, passes: int = PASSES, seed: int = 11) -> SpanModel:
    maker, model = Maker(seed), SpanModel()
    model.fit([example(*maker.turn()) for _ in range(turns)], passes)
    model.weights = {kind: {f: round(w, 4) for f, w in ws.items() if abs(w) > 1e-3} for kind, ws in model.weights.items()}
    return model


def spans(model: SpanModel, text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, in order."""
    if not text or not text.strip():
        return []
    turn = Turn(text)
    return [(kind, turn.starts[i], turn.ends[j - 1]) for i, j, kind in model.best(turn)]


def redacted(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with a placeholder of its type for each span."""
    if text is None:
        return None
    out, last = [], 0
    for kind, s, e in found:
        out += [text[last:s], f"[{kind.upper()}]"]
        last = e
    return "".join([*out, text[last:]])


def _turns(chat_logs: DataFrame) -> DataFrame:
    rows = chat_logs.select(F.col("session_id").cast("string").alias("session_id"), F.posexplode("turns").alias("turn_pos", "t"))
    return rows.where("t.text is not null").select("session_id", "turn_pos", F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def _applied(chat_logs: DataFrame) -> DataFrame:
    """(session_id, turn_pos, role, text, x): each turn with its spans and its redacted text."""
    shared = chat_logs.sparkSession.sparkContext.broadcast(train().weights)
    state: dict = {}

    @arrow("struct<spans:array<struct<kind:string,char_start:int,char_end:int>>,clean:string>")
    def each(texts: list) -> list:
        if "model" not in state:
            state["model"], state["kept"] = SpanModel(shared.value), {}
        kept, out = state["kept"], []
        for text in texts:
            if text not in kept:
                if len(kept) >= KEPT:
                    kept.clear()
                got = spans(state["model"], text)
                kept[text] = {"spans": [{"kind": k, "char_start": s, "char_end": e} for k, s, e in got], "clean": redacted(text, got)}
            out.append(kept[text])
        return out

    return spread(_turns(chat_logs)).withColumn("x", each(F.col("text")))


def found(chat_logs: DataFrame) -> DataFrame:
    """(session_id, turn_pos, kind, char_start, char_end): each piece of personal information, once."""
    rows = _applied(chat_logs).select("session_id", "turn_pos", F.explode("x.spans").alias("s"))
    return rows.select("session_id", "turn_pos", "s.kind", "s.char_start", "s.char_end").distinct()


def cleaned(chat_logs: DataFrame) -> DataFrame:
    """(session_id, turn_pos, role, text): every turn with placeholders instead of personal information, once."""
    return _applied(chat_logs).select("session_id", "turn_pos", "role", F.col("x.clean").alias("text")).distinct()
