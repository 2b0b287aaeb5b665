"""A toxicity classifier that is regularised by counterfactual identity swaps."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeline.llm.common import small_batches, spill

#: Labelled rows that a model is fitted on, at most (the first in the order of a hash of the id).
SAMPLE_ROWS = 8000
#: Weight of the squared change of score under a swap, against the mean log loss.
SWAP_PENALTY = 1.0

#: Weight of the squared weights.
RIDGE = 1e-5

#: Names of groups in neutral use, in English, German, French and Spanish, each line one set to swap within.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "woman", "man", "girl", "boy", "female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "arab", "chinese", "indian"),
    ("old", "young", "deaf", "blind", "disabled", "elderly"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer", "frau", "mann", "mädchen", "junge"),
    ("christen", "muslime", "juden", "katholiken", "protestanten", "atheisten"),
    ("femmes", "hommes", "femme", "homme", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "catholiques", "athées"),
    ("mujeres", "hombres", "mujer", "hombre", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "católicos", "ateos"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def _terms_of(word: str) -> tuple[str, ...]:
    """A word's features: its beginnings of 4 to 6 letters, and itself."""
    return (*("^" + word[:n] for n in (4, 5, 6) if len(word) > n), "=" + word)


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def text_terms(text: str | None) -> set[str]:
    return {t for w in text_words(text) for t in _terms_of(w)}


@dataclass
class ToxicityModel:
    """weights by feature, and the bias: the score is the logistic function of their sum over a text's features."""

    weights: dict[str, float]
    bias: float
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False, compare=False)

    def score(self, text: str | None) -> float:
        memo, found = self.memo, set()
        if len(memo) > 1 << 16:
            memo.clear()
        for w in text_words(text):
            own = memo.get(w)
            if own is None:
                own = memo[w] = tuple(t for t in _terms_of(w) if t in self.weights)
            if own:
                found.update(own)
        z = self.bias + sum(self.weights[t] for t in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def swapped_sentences(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Iterator[tuple[str, str]]:
    """Each sentence that names a group, with each version that names another group of the same set."""
    groups = {t: group for group in terms for t in group}
    for sentence in _SENTENCE.split(text.lower()):
        for named in sorted(text_words(sentence) & groups.keys()):
            for other in groups[named]:
                if other != named:
                    yield sentence, re.sub(rf"\b{re.escape(named)}\b", other, sentence)


#: (candidate features that a swap takes, those that it gives).
Change = tuple[tuple[str, ...], tuple[str, ...]]


@dataclass
class _Example:
    """What fitting needs of a labelled text: its candidate features."""

    label: int
    terms: set[str]


def _identity(terms: tuple[tuple[str, ...], ...]) -> set[str]:
    return {"=" + t for group in terms for t in group}


def _changes(text: str, kept: set[str], terms: tuple[tuple[str, ...], ...]) -> Counter:
    """How often the swaps of a text's sentences change its candidate features in each way."""
    out: Counter = Counter()
    for before, after in swapped_sentences(text, terms):
        a, b = text_terms(before) & kept, text_terms(after) & kept
        if a != b:
            out[(tuple(sorted(a - b)), tuple(sorted(b - a)))] += 1
    return out


def _least(n_toxic: int, n_all: int, frequent: int) -> float:
    """Toxic texts (net of clean ones) that a feature needs, so that of `frequent` candidates none has them by chance."""
    rate = max(n_toxic, 1) / max(n_all, 1)
    return max(3.0, np.log(max(frequent, 1)) / -np.log(min(rate, 0.9)))


def _select(examples: list[_Example], clean: dict[str, int], least: float) -> list[str]:
    """Features that tell the labels apart, one after the other.

    Each next one has the greatest weight of toxic texts, net of clean texts;
    a toxic text's weight halves with each feature taken that it has, so a word
    that only keeps company with toxic words isn't taken, however often.  What
    begins like a feature taken, or is its beginning, is passed over.  Ties go
    to the longer beginning.
    """
    where: dict[str, list[int]] = {}
    for i, e in enumerate(examples):
        if e.label:
            for t in e.terms & clean.keys():
                where.setdefault(t, []).append(i)
    weight = dict.fromkeys((i for i, e in enumerate(examples) if e.label), 1.0)
    gain = {t: float(len(at)) for t, at in where.items()}
    out: list[str] = []
    while gain:
        best = max(gain, key=lambda t: (gain[t] - 2 * clean[t], len(t) if t[0] == "^" else 0, t))
        if gain.pop(best) - 2 * clean[best] < least / 2:
            break
        out.append(best)
        for t in [t for t in gain if t[1:].startswith(best[1:]) or best[1:].startswith(t[1:])]:
            del gain[t]
        for i in where[best]:
            weight[i] /= 2
            for t in examples[i].terms & gain.keys():
                gain[t] -= weight[i]
    return out


def _fit(examples: list[_Example], changes: dict[Change, int], clean: dict[str, int], least: float, identity: set[str], penalty: float, steps: int = 100) -> ToxicityModel:
    y = np.array([e.label for e in examples], float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    names = _select(examples, clean, least)
    names += sorted({t for e in examples for t in e.terms & identity} - set(names))
    at = {t: i for i, t in enumerate(names)}
    x = np.zeros((len(examples), len(names) + 1))
    x[:, -1] = 1
    for i, e in enumerate(examples):
        x[i, [at[t] for t in e.terms & at.keys()]] = 1
    change: Counter = Counter()
    for sides, n in changes.items():
        change[tuple(tuple(sorted(at[t] for t in side if t in at)) for side in sides)] += n
    d = np.zeros((len(change), len(names) + 1))
    for i, (gone, new) in enumerate(change):
        d[i, list(gone)] = -1
        d[i, list(new)] = 1
    weight = np.array([*change.values()], float) / max(sum(change.values()), 1)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    ridge = np.append(np.full(len(names), RIDGE), 1500 * RIDGE)  # a bias nearer 0: one clear feature tells
    swaps = 2 * penalty * (d.T * weight) @ d
    w = np.zeros(len(names) + 1)
    for _ in range(steps):  # Newton's method; the loss is convex
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ ((p - y) * balance) + ridge * w + swaps @ w
        curve = (x.T * (p * (1 - p) * balance)) @ x + np.diag(ridge) + swaps
        move = np.linalg.solve(curve, grad)
        w -= move * min(1.0, 4 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return ToxicityModel({t: float(w[i]) for t, i in at.items()}, float(w[-1]))


def fit(texts: list[str], labels: list[int], terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = SWAP_PENALTY) -> ToxicityModel:
    """Logistic regression on selected features and on the identity terms that occur.

    The loss is the mean log loss (both labels weighing the same), a small
    ridge, and `penalty` times the mean squared change of the score's logit
    when a sentence's identity term is swapped for another one: a term that
    only co-occurs with toxic texts keeps no weight of its own.  Without
    labelled texts, or with one label only, every text scores the share of
    toxic ones.
    """
    counts = [Counter(), Counter()]
    for text, label in zip(texts, labels, strict=True):
        counts[label].update(text_terms(text))
    least = _least(sum(labels), len(labels), sum(n >= 3 for n in counts[1].values()))
    clean = {t: counts[0][t] for t, n in counts[1].items() if n - 2 * counts[0][t] >= least}
    kept = clean.keys() | _identity(terms)
    changes = sum((_changes(x, kept, terms) for x in texts), Counter())
    return _fit([_Example(y, text_terms(x) & kept) for x, y in zip(texts, labels, strict=True)], dict(sorted(changes.items())), clean, least, _identity(terms), penalty)


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts: Counter = Counter()
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            counts.update((t, label) for t in text_terms(text))
        yield pd.DataFrame([(t, n if label else 0, 0 if label else n) for (t, label), n in counts.items()], columns=["term", "toxic", "clean"])


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_rows: int = SAMPLE_ROWS, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    penalty: float = SWAP_PENALTY, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> ToxicityModel:
    """`fit` on labelled documents, `sample_rows` of them at most (the first by a hash of the id).

    `usable` is a condition on labels' rows.  The ids are chosen from the
    labels alone, so only the chosen texts are moved; their terms are counted
    by the executors, and only those that may become features reach the driver,
    with the different changes that swaps make to them and how often; all of it
    is bounded by the sample.  Rows with a null id, label or text are passed
    over; of several labels of one id the largest counts; equal texts count
    once, as the label most of them have.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows if usable is None else rows.where(usable)
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # at most sample_rows ids and labels: a proven bound
    sample = texts.join(F.broadcast(chosen), "id").groupBy("text").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    sample = spill(sample, "toxicity-sample").repartition(16)
    n_all, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = spill(sample.mapInPandas(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-terms")
    least = _least(n_toxic, n_all, counts.where("toxic >= 3").count())
    worth = counts.where(F.col("toxic") - 2 * F.col("clean") >= least).orderBy("term")
    clean = {r.term: r.clean for r in worth.collect()}
    kept = set(clean) | _identity(terms)
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"].to_numpy(), "terms": [sorted(text_terms(t) & shared.value) for t in pdf["text"]]})

    def swaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: Counter = Counter()
            for t in pdf["text"]:
                found.update(_changes(t, shared.value, terms))
            yield pd.DataFrame([(list(gone), list(new), n) for (gone, new), n in found.items()], columns=["gone", "new", "n"])

    found = sample.mapInPandas(examples, "label int, terms array<string>").collect()
    changed = sample.mapInPandas(swaps, "gone array<string>, new array<string>, n long").groupBy("gone", "new").agg(F.sum("n").alias("n")).collect()
    ordered = sorted(found, key=lambda r: (r.label, r.terms))
    changes = dict(sorted(((tuple(r.gone), tuple(r.new)), r.n) for r in changed))
    return _fit([_Example(r.label, set(r.terms)) for r in ordered], changes, clean, least, _identity(terms), penalty)


def _scorer(shared) -> Callable:
    def score_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:  # one text at a time becomes a Python string
            yield pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return score_batches


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the score of every whole text, from 0 to 1; a null text scores as an empty one.

    The model (the selected features, which the sample bounds, and the identity
    terms) is broadcast.  A column of docs with the new one's name is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(score_col, F.arrow_udf(_scorer(shared), "double")(F.col(text_col)))
