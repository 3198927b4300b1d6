"""Toxicity: a weighted finite-state grammar scores clauses, not words by themselves.

Small transducers over token classes (insult, threat, target, negation, reported speech, clause end) are composed into
one machine.  A clause's tokens run through it; each insult or threat comes out as plain, targeted, negated or reported,
with the weight its word or stem has.  The lexicon's weights (log-odds of whole words and stems) and the weight of each
output class (logistic regression on clause sums) are learnt from a bounded sample of labelled rows.  The sample's texts are
counted and matched where they are; the driver gets word counts and one row of clause sums a text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, only, sample_by_class, written
from .words import text_slices

# fixed values: closed-class words of the four languages
TARGETS = set("you your yours u ya du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes tu vos".split())
NEGATIONS = set("not no never without nor nicht kein keine nie ohne ne pas jamais sans nunca sin ni jamás".split())
REPORTS = set("said says say wrote writes claimed claims called quoted quote according sagte sagt schrieb meinte laut dit disait selon écrit dijo dice escribió según".split())
THREATS = set("kill hurt murder destroy stab shoot töten umbringen verletzen tuer frapper détruire matar herir destruir".split())

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_WORD = re.compile(r"[^\W\d_]+")
_ENDS = frozenset(".!?;:\n")
STEMS = range(5, 9)

Transducer = dict[tuple[int, str], tuple[int, str]]


def negation_machine(scope: int = 3) -> Transducer:
    """An insult or threat within ``scope`` tokens after a negation leaves as ``in`` or ``hn``."""
    out: Transducer = {}
    for state in range(scope + 1):
        left = max(0, state - 1)
        for s in "oitrh":
            out[state, s] = (left, {"i": "in", "h": "hn"}.get(s, s) if state else s)
        out[state, "n"] = (scope, "o")
        out[state, "."] = (0, ".")
    return out


def report_machine() -> Transducer:
    """From a verb of saying to the clause's end, insults and threats leave as ``iq`` and ``hq``."""
    out: Transducer = {}
    for state in (0, 1):
        for s in ("o", "i", "in", "t", "h", "hn"):
            out[state, s] = (state, {"i": "iq", "h": "hq"}.get(s, s) if state else s)
        out[state, "r"] = (1, "o")
        out[state, "."] = (0, ".")
    return out


def target_machine() -> Transducer:
    """With a target in the clause an insult leaves as ``it``, a threat as ``ht``; without one a threat is nothing.

    States: 0 nothing yet, 1 target seen, 2 insult seen, 3 threat seen.  A target that follows leaves as ``itl`` or
    ``htl``, which raises what came before it.
    """
    out: Transducer = {}
    for state in range(4):
        seen = state == 1
        for s in ("o", "in", "iq", "hn", "hq"):
            out[state, s] = (state, s if s in ("in", "iq") else "o")
        out[state, "i"] = (1, "it") if seen else (2, "i")
        out[state, "h"] = (1, "ht") if seen else (3, "o")
        out[state, "t"] = (1, {2: "itl", 3: "htl"}.get(state, "o"))
        out[state, "."] = (0, ".")
    return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what ``first`` reads and writes what ``second`` makes of it; states are numbered pairs."""
    numbers: dict[tuple[int, int], int] = {(0, 0): 0}
    todo, out = [(0, 0)], {}
    while todo:
        a, b = pair = todo.pop()
        for (state, symbol), (a2, middle) in first.items():
            if state != a or (b, middle) not in second:
                continue
            b2, written = second[b, middle]
            if (a2, b2) not in numbers:
                numbers[a2, b2] = len(numbers)
                todo.append((a2, b2))
            out[numbers[pair], symbol] = (numbers[a2, b2], written)
    return out


GRAMMAR = compose(compose(negation_machine(), report_machine()), target_machine())
OUTPUTS = ("i", "it", "itl", "in", "iq", "ht", "htl")


@dataclass
class Lexicon:
    """Weights of insult words and stems; ``known`` words have support of their own, so no stem speaks for them."""

    weights: dict[str, float] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict)

    def weight(self, token: str) -> float:
        if token in self.known:
            return self.known[token]
        for n in reversed(STEMS):
            if len(token) > n and (w := self.weights.get(token[:n])) is not None:
                return w
        return 0.0


def present(text: str) -> set[str]:
    """The words of a text, marked as whole, and their stems."""
    found = set()
    for w in set(_WORD.findall(text.lower())):
        found.add(w + "$")
        found.update(w[:n] for n in STEMS if len(w) > n)
    return found


def choose_lexicon(seen: Iterable[tuple[str, int, int]], totals: tuple[int, int], support: int = 6, least_z: float = 5.0) -> Lexicon:
    """Words and stems that toxic texts favour beyond chance, from (feature, texts with it that are not toxic, that are)."""
    lexicon = Lexicon()
    if not totals[0] or not totals[1]:
        return lexicon
    rate = totals[1] / sum(totals)
    for feature, c0, c in seen:
        n = c + c0
        if n < support:
            continue
        odds = math.log((c + 0.5) / (totals[1] + 1)) - math.log((c0 + 0.5) / (totals[0] + 1))
        z = (c - n * rate) / math.sqrt(n * rate * (1 - rate))
        strong = odds > 1.5 and z > least_z and c > 0.5 * n
        if feature.endswith("$"):
            if strong or n >= 4 * support:
                lexicon.known[feature[:-1]] = odds if strong else 0.0
        elif strong:
            lexicon.weights[feature] = odds
    lexicon.known = {w: v for w, v in lexicon.known.items() if v or any(w[:n] in lexicon.weights for n in STEMS)}
    return lexicon


def learn_lexicon(texts: Iterable[str], toxic: Iterable[int], support: int = 6, least_z: float = 5.0) -> Lexicon:
    """Log-odds by document presence of words and stems that toxic texts favour beyond chance."""
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    totals = [0, 0]
    for text, y in zip(texts, toxic, strict=True):
        totals[y] += 1
        for f in present(text):
            seen[f][y] += 1
    return choose_lexicon(((f, *c) for f, c in seen.items()), (totals[0], totals[1]), support, least_z)


class Scorer:
    """Runs texts through the grammar; token weights are cached, up to a bound."""

    def __init__(self, lexicon: Lexicon, bound: int = 50_000):
        self.lexicon, self.bound, self.cache = lexicon, bound, {}

    def weight(self, token: str) -> float:
        w = self.cache.get(token)
        if w is None:
            if len(self.cache) >= self.bound:
                self.cache.clear()
            w = self.cache[token] = 1.5 if token in THREATS else self.lexicon.weight(token)
        return w

    def features(self, text: str | None) -> np.ndarray:
        """Sums of matched weight by output class, the best clause, and the number of matched clauses."""
        out = np.zeros(len(OUTPUTS) + 2)
        lowered = (text or "").lower()
        tokens = _WORD.findall(lowered)
        weight = self.weight
        if not any(map(weight, set(tokens))):
            return out
        sums: dict[str, float] = defaultdict(float)
        state, clause, best, matched, last = 0, 0.0, 0.0, 0, 0.0
        for token in [*_TOKEN.findall(lowered), "."]:
            w = 0.0
            if token in _ENDS:
                symbol = "."
            elif token in THREATS:
                symbol, w = "h", weight(token)
            elif w := weight(token):
                symbol = "i"
            else:
                symbol = "t" if token in TARGETS else "n" if token in NEGATIONS else "r" if token in REPORTS else "o"
            state, written = GRAMMAR[state, symbol]
            if symbol in "ih":
                last = w
            if written in OUTPUTS:
                gain = last if written in ("itl", "htl") else w
                sums[written] += gain
                clause += gain
            if symbol == ".":
                matched += clause > 0
                best, clause = max(best, clause), 0.0
        out[: len(OUTPUTS)] = [math.log1p(sums[k]) for k in OUTPUTS]
        out[-2:] = math.log1p(best), math.log1p(matched)
        return out


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def fit_toxicity(texts: list[str], toxic: list[int], totals: dict[int, int] | None = None, ridge: float = 1.0) -> ToxicityModel:
    """Lexicon and output weights from texts at hand."""
    lexicon = learn_lexicon(texts, toxic)
    scorer = Scorer(lexicon)
    return fit_outputs(lexicon, np.array([scorer.features(t) for t in texts]).reshape(len(texts), len(OUTPUTS) + 2), np.array(toxic, dtype=float), totals, ridge)


def fit_outputs(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, totals: dict[int, int] | None = None, ridge: float = 1.0) -> ToxicityModel:
    """Weights of the output classes; ``totals`` are the classes' sizes in all labelled rows, which set the prior."""
    have = {c: int((y == c).sum()) for c in (0, 1)}
    if not len(y) or not have[0] or not have[1]:
        rate = y.mean() if len(y) else 0.0
        return ToxicityModel(lexicon, np.zeros(len(OUTPUTS) + 2), 30.0 if rate == 1 else -30.0)
    weight = np.array([(totals or have)[int(c)] / have[int(c)] for c in y])
    weight *= len(y) / weight.sum()
    design, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(len(OUTPUTS) + 3)
    penalty = ridge * np.diag([1.0] * (len(w) - 1) + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, design.T @ (weight * (p - y)) + penalty @ w)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-7:
            break
    return ToxicityModel(lexicon, w[:-1], float(w[-1]))


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and stems of labelled texts with the number of texts of each class that have them, added up by slices."""
    for batch in batches:
        for part in text_slices(batch):
            seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, y in zip(column(part, "text").to_pylist(), column(part, "toxic").to_pylist(), strict=True):
                for f in present(text):
                    seen[f][y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([c[y] for c in seen.values()], pa.int64()) for y in (0, 1))], names=["feature", "zeros", "ones"])


def _featured(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon.value)
        for batch in batches:
            for part in text_slices(batch):
                x = [scorer.features(t).tolist() for t in column(part, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, "toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicityModel = model.value
        scorer = Scorer(m.lexicon)
        for batch in batches:
            for part in text_slices(batch):
                x = np.array([scorer.features(t) for t in column(part, "text").to_pylist()])
                s = m.score(x)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 3000) -> DataFrame:
    """Score every whole text: doc_id, score (0 to 1), predicted (1 from 0.5 on).

    ``labels`` has doc_id and toxic (0/1); only rows that ``learn`` marks are learnt from, at most ``per_class`` of each
    class.  Null and empty texts score as texts in which nothing matches; labels that are null or name no document teach
    nothing; where no label of one class is left every score is that of the other.  Rows that repeat a doc_id are scored
    each, and rows with a null doc_id too (no label names them).  Extra columns are ignored; an empty table gives an empty result.
    """
    marked = only(labels.where(learn), "doc_id", "toxic").where("toxic in (0, 1)").withColumn("toxic", F.col("toxic").cast("int"))
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    some = sample_by_class(marked, "toxic", per_class)  # 2 * per_class ids at most, so small enough to send to every task
    rows = written(only(docs, "doc_id", "text").join(F.broadcast(some), "doc_id").where("text is not null").select("text", "toxic"), "labelled")
    seen = rows.mapInArrow(_present, "feature string, zeros long, ones long").groupBy("feature").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    # what the lexicon may hold: words of the sample that are not rare, and stems that toxic texts favour
    seen = seen.where("zeros + ones >= 6 and (ones > zeros or feature like '%$')").orderBy("feature").collect()
    sampled = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    lexicon = choose_lexicon(seen, (sampled.get(0, 0), sampled.get(1, 0)))
    known = docs.sparkSession.sparkContext.broadcast(lexicon)
    # nine numbers a labelled text; the texts themselves stay where they are
    taught = sorted((r["toxic"], *r["x"]) for r in rows.mapInArrow(_featured(known), "toxic int, x array<double>").collect())
    table = np.array(taught, dtype=float).reshape(len(taught), len(OUTPUTS) + 3)
    model = fit_outputs(lexicon, table[:, 1:], table[:, 0], {0: totals.get(0, 1), 1: totals.get(1, 1)})
    known.destroy()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of the sample
    return only(docs, "doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double, predicted int")
