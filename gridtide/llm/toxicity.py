"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target (who is spoken to), negation, report (words that report
speech) or other. Five transducers read the symbols of a clause side by side; each gives every symbol
a factor that depends on its state, and their composition is one machine whose states are tuples and
whose factors are products:

- insult: passes an insult's weight, everything else weighs nothing;
- threat: a threat weighs only near a target, before or after it;
- target: an insult near a target weighs more;
- negation: for a few words after a negation insults and threats weigh less;
- reported speech: after a report word the rest of the clause weighs less.

A clause's score is the sum of weight times factor over its symbols. A document is described by its
matched clauses (strongest clause, total, weight per word, kinds of insults, share of clauses, threats) and its length, and
logistic regression turns that into a score.

Insults and their weights are learned: a word, or a stem (first letters), is an insult if the labels
show it in toxic documents far more often than in others, beyond what chance allows for that many
words. Lexicon and regression are fitted on a bounded sample (labelled.SAMPLE_ROWS); the words'
counts are combined by Spark. Texts are whole; null and empty texts have no clause.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field as attribute

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gridtide.llm.batches import map_texts, pick, rewrite_texts
from gridtide.llm.labelled import SAMPLE_ROWS, held_out, sample

MODULUS, REST, CUT = 4, 2, 0.3
UNLEARNED = 0.01
STEMS = (4, 5, 6)
LEAST_ODDS, LEAST_EVIDENCE, LEAST_TEXTS = 3.0, 20.0, 4
KNOWN_WORDS = 50_000
SCOPE = 4

# Function words of the four languages, in natural order.
TARGETS = "you your yours yourself u ya du dich dir dein deine ihr euch sie tu toi te ton ta vous votre tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never nobody none isn aren wasn don doesn didn won nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún ninguna".split()
REPORTS = "said says say claimed claims wrote writes quoted quote called reported sagte sagt schrieb behauptet zitat dit disait écrit affirme dijo dice escribió afirma".split()
THREATS = "kill hurt destroy shoot stab beat burn hang punish töten schlagen verletzen umbringen zerstören tuer frapper détruire brûler matar golpear destruir quemar".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = {
    **dict.fromkeys(REPORTS, REPORT),
    **dict.fromkeys(NEGATIONS, NEGATION),
    **dict.fromkeys(TARGETS, TARGET),
    **dict.fromkeys(THREATS, THREAT),
}
THREAT_WEIGHT = 3.0
FEATURES = 7
# One to one over bytes: A-Z to a-z, ends of clauses to a line end, other ASCII signs to a space.
_CLAUSES = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 10 if b in b".!?;\n" else 32
    for b in range(256)
)


@dataclass
class Transducer:
    """``step[state][symbol]`` is the next state, ``factor[state][symbol]`` the symbol's factor."""

    step: np.ndarray
    factor: np.ndarray

    def compose(self, other: Transducer) -> Transducer:
        """Both machines on the same input; a state of the result is a pair of states."""
        rows, columns = len(self.step), len(other.step)
        step = (self.step[:, None, :] * columns + other.step[None, :, :]).reshape(rows * columns, -1)
        factor = (self.factor[:, None, :] * other.factor[None, :, :]).reshape(rows * columns, -1)
        return Transducer(step, factor)


def countdown(trigger: int, scope: int, inside: dict[int, float], outside: dict[int, float]) -> Transducer:
    """After ``trigger`` the factors ``inside`` hold for ``scope`` symbols (-1: to the end)."""
    states = 2 if scope < 0 else scope + 1
    step = np.zeros((states, 6), dtype=np.int64)
    factor = np.ones((states, 6))
    for state in range(states):
        step[state] = state if scope < 0 else max(0, state - 1)
        step[state, trigger] = states - 1
        for symbol, value in (inside if state else outside).items():
            factor[state, symbol] = value
    return Transducer(step, factor)


def grammar(negated: float = 0.3, reported: float = 0.6, targeted: float = 1.5) -> Transducer:
    weighs = np.zeros((1, 6))
    weighs[0, [INSULT, THREAT]] = 1.0
    insult = Transducer(np.zeros((1, 6), dtype=np.int64), weighs)
    threat = countdown(TARGET, SCOPE, {}, {THREAT: 0.25})
    target = countdown(TARGET, SCOPE, {INSULT: targeted}, {})
    negation = countdown(NEGATION, SCOPE, {INSULT: negated, THREAT: negated}, {})
    report = countdown(REPORT, -1, {INSULT: reported, THREAT: reported}, {})
    return insult.compose(threat).compose(target).compose(negation).compose(report)


@dataclass
class Scorer:
    """The grammar with a learned lexicon: word or stem (``stem*``) to weight."""

    lexicon: dict[str, float]
    weights: np.ndarray = attribute(default_factory=lambda: np.zeros(FEATURES + 1))

    def __post_init__(self) -> None:
        machine = grammar()
        self.step, self.factor = machine.step.tolist(), machine.factor.tolist()
        self.known: dict[bytes, tuple[int, float] | None] = {}

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def symbol(self, word: bytes) -> tuple[int, float] | None:
        """Symbol and weight of a word; None for an ordinary one."""
        text = word.decode(errors="replace").lower()
        weight = max((self.lexicon.get(term, 0.0) for term in terms(text)), default=0.0)
        if weight:
            return INSULT, weight
        kind = SYMBOLS.get(text)
        return None if kind is None else (kind, THREAT_WEIGHT if kind == THREAT else 0.0)

    def describe(self, text: bytes | None) -> list[float]:
        """Strongest clause, sum, weight per word, kinds of insults, share of matched clauses, threat, length."""
        if not text:
            return [0.0] * FEATURES
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        flat = text.translate(_CLAUSES)
        every = flat.split()
        words = set(every)
        length = np.log1p(len(every))
        for word in words.difference(known):
            known[word] = self.symbol(word)
        if not any(hit and hit[0] in (INSULT, THREAT) for hit in map(known.get, words)):
            return [0.0] * (FEATURES - 1) + [length]
        top = total = threat = 0.0
        matched = clauses = 0
        for clause in flat.split(b"\n"):
            symbols = list(map(known.get, clause.split()))
            clauses += bool(symbols)
            score, strongest = self._clause(symbols) if any(symbols) else (0.0, 0.0)
            matched += score > 0
            total += score
            top, threat = max(top, score), max(threat, strongest)
        share, density = matched / max(1, clauses), 100 * total / max(1, len(every))
        kinds = sum(hit is not None and hit[0] == INSULT for hit in map(known.get, words))
        return [np.log1p(top), np.log1p(total), np.log1p(density), np.log1p(kinds), share, np.log1p(threat), length]

    def _clause(self, symbols: list) -> tuple[float, float]:
        """Weight of the clause. A target may also follow what is aimed at it, so a clause with a target,
        but no negation or report, is read backwards too and the heavier path counts."""
        kinds = {hit[0] for hit in symbols if hit}
        ahead = self._path(symbols)
        if TARGET not in kinds or NEGATION in kinds or REPORT in kinds:
            return ahead
        return max(ahead, self._path(symbols[::-1]))

    def _path(self, symbols: list) -> tuple[float, float]:
        state, score, threat = 0, 0.0, 0.0
        step, factor = self.step, self.factor
        for hit in symbols:
            kind, weight = hit or (OTHER, 0.0)
            if weight:
                gain = weight * factor[state][kind]
                score += gain
                if kind == THREAT:
                    threat = max(threat, gain)
            state = step[state][kind]
        return score, threat

    def scores(self, texts: list) -> np.ndarray:
        rows = np.array([self.describe(text) for text in texts], dtype=np.float64).reshape(-1, FEATURES)
        return _sigmoid(rows @ self.weights[:-1] + self.weights[-1])


def terms(word: str) -> list[str]:
    """The word itself and its stems."""
    return [word, *(word[:size] + "*" for size in STEMS if len(word) > size)]


def _sigmoid(value: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(value, -40, 40)))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and stems that mark toxic texts, from rows (label, text); counts are per text."""

    def start():
        def work(keys, texts):
            toxic, clean = Counter(), Counter()
            sizes = [0, 0]
            for label, text in zip(keys[0].to_pylist(), texts):
                found: set[str] = set()
                for word in set((text or b"").translate(_CLAUSES).split()):
                    found.update(terms(word.decode(errors="replace").lower()))
                (toxic if label else clean).update(found)
                sizes[bool(label)] += 1
            both = list(toxic.keys() | clean.keys())
            yield [*both, None], [*map(toxic.__getitem__, both), sizes[1]], [*map(clean.__getitem__, both), sizes[0]]

        return work

    counted = map_texts(rows, start, "term string, toxic bigint, clean bigint")
    counted = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = counted.filter(f"term IS NULL OR toxic >= {LEAST_TEXTS} AND toxic > clean").toPandas()
    every = kept[kept["term"].isna()]
    if every.empty or not every["toxic"].iloc[0]:
        return {}
    n1, n0 = float(every["toxic"].iloc[0]), float(every["clean"].iloc[0])
    kept = kept[kept["term"].notna()].sort_values("term")
    a, b = kept["toxic"].to_numpy(float), kept["clean"].to_numpy(float)
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    share = (a + b) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda seen, size: np.where(seen > 0, seen * np.log(seen / (size * share)), 0.0)
        evidence = 2 * (part(a, n1) + part(b, n0) + part(n1 - a, n1 * (1 - share) / share) + part(n0 - b, n0 * (1 - share) / share))
    good = (odds >= LEAST_ODDS) & (evidence >= LEAST_EVIDENCE)
    return dict(zip(kept["term"][good], odds[good].tolist()))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Lexicon and regression for the ``toxic`` label, from a bounded sample outside the held-out part."""
    rows = sample(docs, labels, "toxic", MODULUS, REST, sample_rows).dropDuplicates(["text", "label"])
    scorer = Scorer(learn_lexicon(rows))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def start():
        def work(keys, texts):
            yield keys[0], [shared.value.describe(text) for text in texts]

        return work

    found = map_texts(rows, start, "label bigint, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(-1, FEATURES)
    return Scorer(scorer.lexicon, _regression(x, found["label"].to_numpy(dtype=np.float64)))


def _regression(rows: np.ndarray, labels: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Logistic weights with the intercept last, by damped Newton steps; only the length may count against.

    Without any row nothing has been learned, and every text scores UNLEARNED: a filter keeps it.
    """
    x = np.hstack([rows, np.ones((len(rows), 1))])
    weights = np.zeros(x.shape[1])
    if not len(rows):
        weights[-1] = np.log(UNLEARNED / (1 - UNLEARNED))
        return weights
    chance = (labels.sum() + 0.5) / (len(labels) + 1.0)
    weights[-1] = np.log(chance / (1 - chance))
    ridge = np.eye(x.shape[1]) * penalty
    ridge[-1, -1] = 1e-6
    # All but the length and the intercept stay at zero or above.
    low = np.arange(len(weights)) < len(weights) - 2
    loss = _loss(x, labels, weights, ridge)
    for _ in range(200):
        p = _sigmoid(x @ weights)
        slope = ridge @ weights - x.T @ (labels - p)
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge
        free = np.flatnonzero(~(low & (weights <= 0) & (slope > 0)))
        move = np.zeros(len(weights))
        move[free] = -np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        # Half steps until the loss falls: a whole Newton step may leap far beyond the optimum.
        size = 1.0
        while size > 1e-12:
            new = weights + size * move
            new[low] = np.maximum(new[low], 0.0)
            after = _loss(x, labels, new, ridge)
            if after <= loss + 1e-4 * slope @ (new - weights):
                break
            size /= 2
        else:
            break
        done = np.abs(new - weights).max() < 1e-9
        weights, loss = new, after
        if done:
            break
    return weights


def _loss(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: np.ndarray) -> float:
    margin = x @ weights
    return float(np.logaddexp(0.0, margin).sum() - labels @ margin + 0.5 * weights @ ridge @ weights)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row: near 1 where the text is likely toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def start():
        def work(keys, texts):
            yield keys[0], shared.value.scores(texts)

        return work

    return map_texts(pick(docs, doc_id=id_col, text=text_col), start, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Fit, then doc_id, held_out, score and predicted for every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id"), MODULUS, REST).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the cut, with all their columns; fitted on these documents."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def start():
        def work(texts):
            return texts, shared.value.scores(texts) < cut

        return work

    return rewrite_texts(docs, start, text_col)
