"""Toxicity by a weighted finite-state grammar over clauses.

Words are first mapped to symbols: insult, threat, target, negation, report, other.  Four small weighted transducers rewrite the
symbols of a clause: negation takes weight from what it denies, report from what is only quoted, a target adds weight to the
insult that follows or precedes it, a threat counts where it meets a target.  They are composed into one machine that reads
each clause once.  A document's evidence is the sum over its matched clauses, put on a scale from 0 to 1 by labelled rows.

Insult words and stems are learned from a bounded labelled sample with a weight each, their log-odds of toxic against clean
over the usual one.  So is what a composed pattern (an insult alone, denied, quoted, with a target, a threat that met one)
makes of a weight; a pattern that the sample hardly has keeps the factor of the machine.  The other classes are closed lists.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from os.path import commonprefix

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.common import bounded_sample, fold, with_scores

SAMPLE_ROWS, SAMPLE_CHARS = 4000, 16_000_000

#: Closed word classes of the grammar, in the languages of the documents.
CLASSES = {
    "threat": "kill hurt destroy smash burn beat stab shoot töten verletzen schlagen tuer frapper brûler matar golpear quemar",
    "target": "you your yours u he she they him them his her their du dich dir euch ihr tu te toi vous usted ustedes él ella",
    "negation": "not no never isn aren wasn don doesn nobody nicht kein keine nie jamais aucun nunca ningún",
    "report": "said says say told quoted wrote claimed reported called sagte sagt schrieb dit disait écrit dijo dice escribió",
}
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")

Arc = tuple[int, str, float]
#: What was read, an insult or the target that a threat met, and the factor of the machine for what stands about it.
Pattern = tuple[str, float]
ALONE: Pattern = ("insult", 1.0)


@dataclass
class Transducer:
    """States are whole numbers from 0; an arc gives the next state, the output symbol and a factor.

    A symbol without an arc keeps itself at factor 1 and leads to ``rest[state]`` (by default the same state).
    """

    states: int
    arcs: dict[tuple[int, str], Arc]
    rest: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> Arc:
        return self.arcs.get((state, symbol), (self.rest.get(state, state), symbol, 1.0))

    def compose(self, other: Transducer, symbols: tuple[str, ...]) -> Transducer:
        """The machine that feeds this one's output to the other and multiplies the factors."""
        arcs: dict[tuple[int, str], Arc] = {}
        for a in range(self.states):
            for b in range(other.states):
                for symbol in symbols:
                    next_a, middle, first = self.step(a, symbol)
                    next_b, out, second = other.step(b, middle)
                    arcs[a * other.states + b, symbol] = (next_a * other.states + next_b, out, first * second)
        return Transducer(self.states * other.states, arcs)


SYMBOLS = ("other", "insult", "threat", "target", "negation", "report")


def within(words: int, opener: str, rewrites: dict[str, tuple[str, float]]) -> Transducer:
    """For ``words`` words after the opener the given symbols are rewritten."""
    arcs: dict[tuple[int, str], Arc] = {}
    for state in range(words + 1):
        arcs[state, opener] = (words, opener, 1.0)
        if state:
            arcs |= {(state, symbol): (state - 1, out, factor) for symbol, (out, factor) in rewrites.items()}
    return Transducer(words + 1, arcs, {state: state - 1 for state in range(1, words + 1)})


def grammar() -> Transducer:
    """Negation, report, target and threat, composed in this order."""
    negation = within(2, "negation", {"insult": ("insult", 0.3), "threat": ("other", 1.0)})
    report = Transducer(2, {(0, "report"): (1, "report", 1.0), (1, "insult"): (1, "insult", 0.5), (1, "threat"): (1, "other", 1.0)})
    targeted = within(4, "target", {"insult": ("insult", 1.5)})
    threat = Transducer(4, {
        **{(state, "threat"): (3, "other", 1.0) for state in range(4)},
        **{(state, "target"): (0, "insult", 2.0) for state in (1, 2, 3)},
    }, {3: 2, 2: 1, 1: 0})
    machine = negation
    for later in (report, targeted, threat):
        machine = machine.compose(later, SYMBOLS)
    return machine


@dataclass
class Grammar:
    """Learned insult words and stems with weights, learned factors of patterns, and the scale of the evidence."""

    words: dict[str, float]
    stems: dict[str, float]
    slope: float = 3.0
    offset: float = -3.0
    patterns: dict[Pattern, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.machine = grammar()
        self.closed = {word: name for name, words in CLASSES.items() for word in words.split()}
        self.sizes = sorted({len(stem) for stem in self.stems}, reverse=True)
        self.known: dict[str, tuple[str, float]] = {}

    def __reduce__(self):
        return Grammar, (self.words, self.stems, self.slope, self.offset, self.patterns)

    def symbol(self, word: str) -> tuple[str, float]:
        if word in self.words:
            return "insult", self.words[word]
        if word in self.closed:
            return self.closed[word], 1.0
        for size in self.sizes:
            if word[:size] in self.stems:
                return "insult", self.stems[word[:size]]
        return "other", 0.0

    def symbols(self, words: list[str]) -> list[tuple[str, float]]:
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known.update((w, self.symbol(w)) for w in set(words) if w not in self.known)
            found = [self.known[w] for w in words]
        return found

    def matches(self, words: list[str]) -> list[tuple[Pattern, float]]:
        """Pattern and weight of each insult or threat of one clause."""
        state, found = 0, []
        for symbol, weight in self.symbols(words):
            state, out, factor = self.machine.step(state, symbol)
            if out == "insult":
                found.append(((symbol, round(factor, 6)), weight if symbol == "insult" else 1.0))
        return found

    def clause(self, words: list[str]) -> float:
        """Weight of one clause: each insult or threat with the factors of what stands about it."""
        return sum(weight * self.patterns.get(pattern, pattern[1]) for pattern, weight in self.matches(words))

    def evidence(self, text: str | None) -> float:
        """Sum over the clauses that hold an insult or a threat; nothing for a null or empty text."""
        lower = (text or "").lower()
        if not any(s in ("insult", "threat") for s, _ in self.symbols(WORD.findall(lower))):
            return 0.0
        return sum(map(self.clause, map(WORD.findall, CLAUSE.split(lower))))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log1p(self.evidence(text)) + self.offset, -30, 30))))


def surprise(toxic: int, clean: int, share: float) -> float:
    """Log-likelihood ratio of the counts against the share of toxic documents."""
    total = toxic + clean
    part = lambda n, expected: n * np.log(n / (total * expected)) if n else 0.0
    return 2 * (part(toxic, share) + part(clean, 1 - share))


def log_odds(toxic: int, clean: int, share: float) -> float:
    """How much more often than by the share of toxic documents; half a count is added to either side."""
    return float(np.log((toxic + 0.5) / (clean + 0.5)) - np.log(share / (1 - share)))


def learn_patterns(found: Grammar, texts: list[str | None], labels: np.ndarray, share: float, doubt: float = 20.0) -> dict[Pattern, float]:
    """Factor of each pattern: its log-odds over those of an insult alone, drawn to the machine's factor where documents are few.

    Only documents that hold no other pattern are witnesses, so that none inherits what another says.
    """
    seen: dict[Pattern, Counter] = defaultdict(Counter)
    for text, label in zip(texts, labels):
        held = {pattern for part in CLAUSE.split((text or "").lower()) for pattern, _ in found.matches(WORD.findall(part))}
        if len(held) == 1:
            seen[held.pop()][bool(label)] += 1
    usual = log_odds(seen[ALONE][True], seen[ALONE][False], share)
    if usual <= 0:
        return {}
    learned = {}
    for pattern, n in seen.items():
        trust = n.total() / (n.total() + doubt)
        learned[pattern] = (1 - trust) * pattern[1] + trust * max(log_odds(n[True], n[False], share), 0.0) / usual
    return learned


def learn(texts: list[str | None], labels: np.ndarray, needed: float = 25.0, contexts: int = 4) -> Grammar:
    """Words and stems that mark toxic documents and their weights, patterns, then the scale by logistic regression.

    A word counts once for each pair of neighbours, so that copies of one document are one witness.  Stems of four to six
    letters stand for the forms of a word that the sample lacks; they need three forms and no clean word.
    """
    share = min(max(float(labels.mean()) if len(labels) else 0.1, 0.01), 0.99)
    toxic_at: dict[str, set] = defaultdict(set)
    for text, label in zip(texts, labels):
        if label:
            words = WORD.findall((text or "").lower())
            for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                toxic_at[word].add((before, after))
    clean_in: Counter = Counter()
    clean_words: set[str] = set()
    for text, label in zip(texts, labels):
        if not label:
            distinct = set(WORD.findall((text or "").lower()))
            clean_in.update(distinct.intersection(toxic_at))
            clean_words |= distinct
    clean_stems = {w[:k] for w in clean_words for k in (4, 5, 6)}
    words: dict[str, float] = {}
    forms: dict[str, set] = defaultdict(set)
    for word, seen in toxic_at.items():
        clean = clean_in[word]
        for k in (4, 5, 6):
            if len(word) > k and word[:k] not in clean_stems:
                forms[word[:k]].add(word)
        if len(seen) >= contexts and len(seen) > 4 * clean and surprise(len(seen), clean, share) >= needed:
            words[word] = log_odds(len(seen), clean, share)
    stems: dict[str, float] = {}
    for stem, members in sorted(forms.items(), key=lambda item: (len(item[0]), item[0])):
        seen = set().union(*(toxic_at[w] for w in members))
        if len(members) >= 3 and surprise(len(seen), 0, share) >= needed and not any(stem[:k] in stems for k in (4, 5)):
            stems[commonprefix(sorted(members))] = log_odds(len(seen), 0, share)
    if words or stems:
        usual = float(np.median([*words.values(), *stems.values()]))
        words, stems = ({w: v / usual for w, v in part.items()} for part in (words, stems))
    found = Grammar(words, stems)
    found.patterns = learn_patterns(found, texts, labels, share)
    evidence = np.log1p([found.evidence(t) for t in texts])
    if 0 < labels.sum() < len(labels):
        found.slope, found.offset = logistic(evidence, labels)
    return found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope (at least 0) and offset of a one-feature logistic regression, by Newton steps with a ridge on the slope."""
    weight = np.zeros(2)
    rows = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ weight, -30, 30)))
        gradient = rows.T @ (p - y) + np.array([ridge * weight[0], 1e-3 * weight[1]])
        hessian = rows.T @ (rows * (p * (1 - p))[:, None]) + np.diag([ridge, 1e-3])
        step = np.linalg.solve(hessian, gradient)
        weight -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(weight[0]), 0.0), float(weight[1])


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 0) -> Grammar:
    """Learn on a bounded sample of labelled rows outside the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("_label"))
    sample = bounded_sample(docs, known.where(fold() != held_out), SAMPLE_ROWS, SAMPLE_CHARS)
    return learn([text for text, _ in sample], np.array([label for _, label in sample], np.float64))


def judged(docs: DataFrame, found: Grammar, threshold: float = 0.5) -> DataFrame:
    """Every row with all its columns, ``_score`` and ``_predicted``, by the whole text alone.

    Null and empty texts have no evidence; repeated rows repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(found)
    return with_scores(docs, lambda texts: [shared.value.score(t) for t in texts.to_pylist()], threshold)


def score(docs: DataFrame, found: Grammar, threshold: float = 0.5, held_out: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a null id is not held out.  Other columns are not read."""
    return judged(docs.select("doc_id", "text"), found, threshold).select(
        "doc_id", F.coalesce(fold() == held_out, F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
        F.col("_predicted").alias("predicted"))
