"""Toxicity by a weighted finite-state pattern grammar.

A clause's words become symbols: lexicon entries by level, verbs of harm, words
of intent, targets, negations, verbs of reported speech, other. Six
transducers, each mapping a symbol to a symbol, are composed once into one
machine:

* insult turns an entry into an insult of its level, or of the next one where
  another entry came up to INSULT_REACH words before,
* threat turns a verb of harm into a threat, an intended one where a word of
  intent came up to INTENT_REACH words before,
* negation marks an insult or threat up to NEGATION_REACH words after a negation,
* reported speech marks one that follows a verb of saying in the clause,
* target marks one that a target precedes closely, and turns a threat with a
  target after it into an event of its own,
* score gives each marked symbol its weight.

A clause's score is the sum along the machine's path; a document's is a
logistic function of its clauses' sum. So a word counts for what its clause
does with it. Insult entries (words, and stems that take many endings), the
weights of the three marks and those of both threats are learned from a
bounded sample of labelled texts, on the driver: TOXIC_SAMPLE toxic and
CLEAN_SAMPLE other ones. The lexicon that is broadcast has no entry that is not
in that sample.

Documents are searched for lexicon entries with one Aho-Corasick automaton;
only clauses with an entry run through the machine.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOXIC_SAMPLE = 1500
CLEAN_SAMPLE = 3000
LEVELS = 6
#: Least log odds ratio and log likelihood ratio of a lexicon entry.
LEAST_ODDS, LEAST_RATIO = 1.8, 14.0
INSULT_REACH = 3
INTENT_REACH = 4
NEGATION_REACH = 3
TARGET_REACH = 4

# Function words of the grammar in English, German, French and Spanish.
TARGETS = frozenset("you your yours yourself u he she they him her them du dich dir ihr euch dein sie er tu toi te vous votre il elle ils elles tú ti usted ustedes vosotros él ella ellos ellas".split())
NEGATIONS = frozenset("not no never nobody none cannot isn aren wasn weren don doesn didn nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ni tampoco".split())
REPORTS = frozenset("said says say saying told tells wrote writes called calls claimed claims reported reports quoted quotes according allegedly sagte sagt sagten schrieb schreibt nannte nennt behauptete laut dit disait écrit écrivait appelé selon prétend dijo dice escribió escribe llamó llama según afirmó".split())
INTENTS = frozenset("will ll gonna going shall must should want werde werden wird wollen will müssen vais va allons voy vamos quiero".split())
HARMS = "kill hurt destroy murder strangl stab shoot töt umbring erschlag verprügel étrangl massacr golpe destru".split()
HARM_WORDS = "tuer tue matar mato frapper frappe destruir strangle shot".split()
ENDINGS = "s es ed ing er e en t st te ar o a bed bing".split()
# end of fixed values

THREATS = frozenset([*HARM_WORDS, *HARMS, *(stem + end for stem in HARMS for end in ENDINGS)])

_WORD = regex.compile(r"\p{L}+")
_CLAUSE = regex.compile(r"[^.!?;:\n]+")


# --- transducers ------------------------------------------------------------


@dataclass
class Transducer:
    """Maps each symbol to one symbol with a weight: step(state, symbol) -> (state, symbol, weight).

    States are numbers from 0, the start. arcs has every state and symbol.
    """

    symbols: tuple[str, ...]
    arcs: dict[tuple[int, str], tuple[int, str, float]]

    def outputs(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(out for _, out, _ in self.arcs.values()))

    def run(self, symbols: Iterable[str]) -> Iterator[tuple[str, float]]:
        state = 0
        for s in symbols:
            state, out, weight = self.arcs[state, s]
            yield out, weight


def build(symbols: Iterable[str], step) -> Transducer:
    """The transducer of a step function over states of any kind, 0 the start, as far as they are reached."""
    symbols = tuple(symbols)
    place, todo, arcs = {0: 0}, [0], {}
    while todo:
        state = todo.pop()
        for s in symbols:
            after, out, weight = step(state, s)
            if after not in place:
                place[after] = len(place)
                todo.append(after)
            arcs[place[state], s] = (place[after], out, weight)
    return Transducer(symbols, arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that gives second the output of first; weights add up."""

    def step(state, symbol):
        a, b = (0, 0) if state == 0 else state
        a, middle, w = first.arcs[a, symbol]
        b, out, v = second.arcs[b, middle]
        return ((a, b) if (a, b) != (0, 0) else 0), out, w + v

    return build(first.symbols, step)


#: Lexicon entries (E) and insults (I) by level.
ENTRIES = tuple(f"E{k}" for k in range(1, LEVELS + 1))
#: Other words, targets, negations, reports, words of intent (W), verbs of harm (V), entries.
SYMBOLS = ("o", "T", "N", "R", "W", "V", *ENTRIES)


def _harm(symbol: str) -> bool:
    return symbol[-2:-1] == "I" or symbol[-1] in "XY"


def insult() -> Transducer:
    """E to I, one level higher in the reach of an entry before."""

    def step(left, s):
        if s in ENTRIES:
            return INSULT_REACH, f"I{min(LEVELS, int(s[1:]) + (left > 0))}", 0.0
        return max(0, left - 1), s, 0.0

    return build(SYMBOLS, step)


def threat(symbols: Iterable[str]) -> Transducer:
    """V to X, or to Y in the reach of a word of intent before; words of intent become other words."""

    def step(left, s):
        if s == "W":
            return INTENT_REACH, "o", 0.0
        return max(0, left - 1), ("Y" if left else "X") if s == "V" else s, 0.0

    return build(symbols, step)


def negation(symbols: Iterable[str]) -> Transducer:
    def step(left, s):
        if s == "N":
            return NEGATION_REACH, s, 0.0
        return max(0, left - 1), f"n:{s}" if left and _harm(s) else s, 0.0

    return build(symbols, step)


def reported(symbols: Iterable[str]) -> Transducer:
    def step(said, s):
        if s == "R":
            return 1, s, 0.0
        return said, f"r:{s}" if said and _harm(s) else s, 0.0

    return build(symbols, step)


def target(symbols: Iterable[str]) -> Transducer:
    """Marks t: what a target precedes; a threat waits TARGET_REACH words for its target and then gives it the threat's symbol with t:."""

    def step(state, s):
        left, waiting, which = (0, 0, "") if state == 0 else state
        out = s
        if s == "T":
            if waiting:
                out, waiting, which = f"t:{which}", 0, ""
            left = TARGET_REACH
        else:
            if s[-1] in "XY":
                out, waiting, which = "o", TARGET_REACH, s
            elif _harm(s):
                out = f"t:{s}" if left else s
                waiting = max(0, waiting - 1)
            else:
                waiting = max(0, waiting - 1)
            left = max(0, left - 1)
        if not waiting:
            which = ""
        after = (left, waiting, which)
        return (0 if after == (0, 0, "") else after), out, 0.0

    return build(symbols, step)


def score(symbols: Iterable[str], marks: dict[str, float], threats: dict[str, float]) -> Transducer:
    def step(state, s):
        if not _harm(s):
            return 0, s, 0.0
        *on, base = s.split(":")
        weight = threats[base] if base in threats else float(base[1:])
        for m in on:
            weight *= marks[m]
        return 0, s, weight

    return build(symbols, step)


def grammar(marks: dict[str, float], threats: dict[str, float]) -> Transducer:
    machine = insult()
    for part in (threat, negation, reported, target):
        machine = compose(machine, part(machine.outputs()))
    return compose(machine, score(machine.outputs(), marks, threats))


# --- lexicon ----------------------------------------------------------------


@dataclass
class Model:
    words: dict[str, int]  # whole words -> level
    stems: dict[str, int]  # beginnings of words -> level
    repeated: dict[str, int]  # beginnings that count where a text has them twice or more -> level
    marks: dict[str, float] = field(default_factory=lambda: {"n": 0.25, "r": 0.4, "t": 1.25})
    threats: dict[str, float] = field(default_factory=lambda: {"X": 2.0, "Y": 3.0})
    slopes: tuple[float, float] = (1.0, 0.5)
    bias: float = -3.0


class Matcher:
    """A model made ready to score texts."""

    def __init__(self, model: Model):
        self.model, self.machine = model, grammar(model.marks, model.threats)
        self.longest = max((len(w) for kind in (model.stems, model.repeated) for w in kind), default=0)
        self.find = ahocorasick.Automaton()
        for w in (*model.words, *model.stems, *model.repeated, *THREATS):
            self.find.add_word(w, len(w))
        self.find.make_automaton()

    def symbol(self, word: str, twice: dict[str, int]) -> str:
        """The symbol of a word; twice: the repeated stems that the text has twice."""
        level = self.model.words.get(word)
        if level is None:
            level = max((k for n in range(3, min(len(word), self.longest) + 1) for kind in (self.model.stems, twice) if (k := kind.get(word[:n]))), default=None)
        if level is not None:
            return f"E{level}"
        return "V" if word in THREATS else "N" if word in NEGATIONS else "R" if word in REPORTS else "T" if word in TARGETS else "W" if word in INTENTS else "o"

    def clauses(self, text: str) -> list[tuple[int, int, float, list[str]]]:
        """(start, end, weight, marked symbols) of each clause with an insult or threat, in characters of the lower-cased text."""
        low = text.lower()
        hits = [(end - n + 1, n) for end, n in self.find.iter(low) if end - n < 0 or not low[end - n].isalpha()]
        if not hits:
            return []
        out = []
        often = Counter(e for at, n in hits if (e := low[at : at + n]) in self.model.repeated)
        twice = {e: self.model.repeated[e] for e, c in often.items() if c > 1}
        hits = [at for at, _ in hits]
        hits.sort()
        at = end = 0
        while at < len(hits):
            start, end = _CLAUSE.match(low, _clause_start(low, end, hits[at])).span()
            symbols = [self.symbol(w, twice) for w in _WORD.findall(low, start, end)]
            path = list(self.machine.run(symbols))
            events = [s for s, w in path if w > 0]
            if events:
                out.append((start, end, sum(w for _, w in path), events))
            at = bisect_right(hits, end - 1, at)
        return out

    @staticmethod
    def features(clauses: list[tuple], length: int) -> tuple[float, float]:
        """Logarithms of the clauses' sum, and of that for each 1000 characters."""
        total = sum(c[2] for c in clauses)
        return math.log1p(total), math.log1p(1000.0 * total / max(length, 200))

    def probability(self, clauses: list[tuple], length: int) -> float:
        x, y = self.features(clauses, length)
        return 1.0 / (1.0 + math.exp(-(self.model.bias + self.model.slopes[0] * x + self.model.slopes[1] * y)))


def _clause_start(text: str, after: int, at: int) -> int:
    """Where the clause of a place begins, not before the end of the last one."""
    return max(after - 1, *(text.rfind(c, after, at) for c in ".!?;:\n")) + 1


def _distinct(texts: list[str]) -> list[Counter]:
    """Word counts of texts, without those that share half of an eight-hash sketch with an earlier one: copies would make any rare word look telling."""
    seen: dict[int, Counter] = defaultdict(Counter)
    out, n = [], 0
    for t in texts:
        words = Counter(_WORD.findall(t.lower()))
        sketch = sorted(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest()) for w in words)[:8]
        shared = Counter()
        for h in sketch:
            shared.update(seen[h].keys())
        if not shared or max(shared.values()) * 2 < len(sketch):
            out.append(words)
            for h in sketch:
                seen[h][n] = 1
            n += 1
    return out


def _evidence(t: int, bad: int, c: int, good: int) -> tuple[float, float]:
    """(log odds ratio, log likelihood ratio) of an entry in t of bad toxic texts and c of good other ones."""
    odds = math.log((t + 0.5) / (bad - t + 0.5)) - math.log((c + 0.5) / (good - c + 0.5))
    both, n = t + c, bad + good
    ratio = 0.0
    for seen, all_ in ((t, bad), (c, good)):
        for k, share in ((seen, both / n), (all_ - seen, 1 - both / n)):
            if k:
                ratio += k * math.log(k / (all_ * share))
    return odds, ratio


def _beginnings(words: Counter) -> Counter:
    out: Counter = Counter()
    for w, c in words.items():
        for n in range(4, min(11, len(w) + 1)):
            out[w[:n]] += c
    return out


def learn_lexicon(toxic: list[str], clean: list[str]) -> tuple[dict[str, int], dict[str, int], dict[str, int]]:
    """Words and stems that toxic texts have far more often than others: (words, stems, repeated stems) with levels 1 to LEVELS.

    A repeated stem counts only in a text that has it twice or more: one that
    clean words may begin with by chance. Entries are taken by falling
    likelihood ratio, a stem only where three or more words begin with it, and
    none that begins, or is begun by, one taken before.
    """
    bad, good = _distinct(toxic), _distinct(clean)
    forms: dict[str, set[str]] = defaultdict(set)
    counts = [Counter(), Counter(), Counter()]  # words, beginnings, beginnings found twice
    for d in bad:
        for w in d:
            for n in range(4, min(11, len(w) + 1)):
                if len(forms[w[:n]]) < 3:
                    forms[w[:n]].add(w)
        begun = _beginnings(d)
        counts[0].update({w for w in d if len(w) >= 3})
        counts[1].update(begun.keys())
        counts[2].update({p for p, c in begun.items() if c > 1})
    counts = [Counter({e: c for e, c in some.items() if c >= 4 and (k == 0 or len(forms[e]) >= 3)}) for k, some in enumerate(counts)]
    other = [Counter(), Counter(), Counter()]
    for d in good:
        other[0].update({w for w in d if w in counts[0]})
        begun = {p: c for p, c in _beginnings(d).items() if p in counts[1] or p in counts[2]}
        other[1].update(begun.keys())
        other[2].update({p for p, c in begun.items() if c > 1})
    found = []
    for k in range(3):
        for e, t in counts[k].items():
            odds, ratio = _evidence(t, len(bad), other[k][e], len(good))
            if odds >= LEAST_ODDS and ratio >= LEAST_RATIO:
                found.append((-ratio, k, e, max(1, min(LEVELS, round(odds)))))
    found.sort()
    kept: list[dict[str, int]] = [{}, {}, {}]
    taken, inside = set(), set()
    for _, k, e, level in found:
        if e in inside or any(e[:n] in taken for n in range(3, len(e) + 1)):
            continue
        kept[k][e] = level
        taken.add(e)
        inside.update(e[:n] for n in range(3, len(e)))
    return kept[0], kept[1], kept[2]


def learn(toxic: list[str], clean: list[str]) -> Model:
    """A model of labelled texts; without toxic texts, one that finds threats only."""
    model = Model(*learn_lexicon(toxic, clean))
    matcher = Matcher(model)
    found = [(matcher.clauses(t), y) for y, texts in ((1, toxic), (0, clean)) for t in texts]
    # a weight keeps its first value as ten documents' worth; a mark moves to how much likelier (or less likely) than plain
    # events the marked ones are to stand in toxic texts, a threat to the level that its evidence gives
    symbols = [({s for c in cs for s in c[3]}, y) for cs, y in found]
    plain = [y for some, y in symbols if any(":" not in s for s in some)]
    base = (1 + sum(plain)) / (2 + len(plain))
    for m, first in list(model.marks.items()):
        seen = [y for some, y in symbols if any(m in s.split(":")[:-1] for s in some)]
        model.marks[m] = (10 * first + min(1.5, (sum(seen) / len(seen)) / base) * len(seen)) / (10 + len(seen)) if seen else first
    for kind, first in list(model.threats.items()):
        t, c = (sum(1 for some, y in symbols if y == label and any(s[-1] == kind and "n" not in s.split(":")[:-1] for s in some)) for label in (1, 0))
        level = min(float(LEVELS), max(0.0, _evidence(t, len(toxic), c, len(clean))[0])) if t + c else first
        model.threats[kind] = (10 * first + (t + c) * level) / (10 + t + c)
    matcher = Matcher(model)
    x = np.array([matcher.features(matcher.clauses(t), len(t)) for texts in (toxic, clean) for t in texts]).reshape(-1, 2)
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    if len(toxic) and len(clean):
        *slopes, model.bias = _logistic(x, y)
        model.slopes = (slopes[0], slopes[1])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> list[float]:
    """Slopes and bias by Newton steps with a small ridge penalty."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty * np.eye(len(w)), a.T @ (p - y) + penalty * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> Model:
    """A model of labelled rows, whose texts come to the driver: give a bounded sample (see common.labelled_sample)."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t"), F.col(label_col).cast("int").alias("y")).collect()
    rows.sort(key=lambda r: (r["i"], r["t"]))
    return learn([r["t"] for r in rows if r["y"] == 1], [r["t"] for r in rows if r["y"] == 0])


def assess(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, clauses) for each row of df.

    score: probability of the label, the same low one for every text without a
    matched clause, null and empty texts too. clauses: array of (start, end,
    weight) in characters of the lower-cased text. Only id and text are read;
    ids may be null or repeat.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                scores, spans = [], []
                for t in batch.column(1):
                    text = t.as_py() or ""
                    clauses = matcher.clauses(text)
                    scores.append(matcher.probability(clauses, len(text)))
                    spans.append([{"start": s, "end": e, "weight": w} for s, e, w, _ in clauses])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "clauses"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, clauses array<struct<start:long,end:long,weight:double>>")
