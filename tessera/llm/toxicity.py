"""A toxicity classifier whose training penalises score changes under swaps of identity terms.

Features are the words of a text, as a set, and which beginnings one, two, or three and more of its words have. From the labelled rows (a bounded sample of
them, ``max_rows``, by digest of the id; documents without a label aren't read into it) the features that set the
classes apart by a two-proportion test are kept, and all features of identity terms. A logistic model is fitted to
balanced classes by Newton steps, with two quadratic penalties: the size of the weights, and the squared change of the
logit between each text and its counterfactuals. A counterfactual swaps the identity terms of a labelled text's
sentences for other terms of the same kind; as neutral mentions are rare, each term is also swapped for each other
term of its kind in a bare sentence, and for no term at all. Scoring is a map over whole texts.

Defined results: a null text counts as empty and gets the score of a text without features; a null id is not held out;
labels that repeat an id count once, as toxic if any is; null labels are ignored; without labels of both classes every
score is the share of toxic labels (0 without labels); an empty table gives an empty result; repeated rows get equal
scores; further columns, and lang, source and id, are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import tidy

#: Identity terms by kind, in the languages of the corpus; terms of a line can stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "arab", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "ateos"),
)
_KIND = {term: kind for kind in IDENTITY_TERMS for term in kind}

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of beginnings, and up to how many words that have one are told apart.
_PREFIXES, _LEVELS = (4, 5), 3
_CACHED = 1 << 16


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def prefixes(word: str) -> list[str]:
    return [word[:k] for k in _PREFIXES if len(word) >= k]


def features(found: set[str]) -> set[str]:
    """The words, and which beginnings one, two, or three and more of them have."""
    shared = Counter(p for w in found for p in prefixes(w))
    return {w + "$" for w in found} | {f"{p}{n}" for p, c in shared.items() for n in range(1, min(c, _LEVELS) + 1)}


def counterfactuals(found: set[str]) -> list[set[str]]:
    """The words of a text with each of its identity terms swapped for the next, and the one before, of its kind."""
    if not (named := found & _KIND.keys()):
        return []
    return [(found - named) | {_KIND[t][(_KIND[t].index(t) + step) % len(_KIND[t])] for t in named} for step in (1, -1)]


@dataclass(frozen=True)
class Settings:
    """max_rows: labelled rows fitted to, at most. max_features: features kept, at most. z: what a feature must reach
    in the two-proportion test. ridge, fairness: the strength of the penalties."""

    max_rows: int = 6000
    max_features: int = 600
    z: float = 3.5
    ridge: float = 0.0003
    fairness: float = 1.0


@dataclass(frozen=True)
class Model:
    bias: float
    weights: tuple[tuple[str, float], ...]

    def score(self, text: str) -> float:
        return _scorer(self).score(text)


class _Scorer(dict):
    """By word: its weight, and those of its beginnings that have any; None where there is nothing."""

    def __init__(self, model: Model):
        super().__init__()
        self.bias, self.weights = model.bias, dict(model.weights)
        self.starts = {f[:-1] for f in self.weights if f[-1] != "$"}

    def score(self, text: str) -> float:
        parts, shared = [self.bias], {}
        for w in words(text):
            if found := self[w]:
                parts.append(found[0])
                for p in found[1]:
                    shared[p] = shared.get(p, 0) + 1
        for p, c in shared.items():
            parts += [self.weights.get(f"{p}{n}", 0.0) for n in range(1, min(c, _LEVELS) + 1)]
        logit = math.fsum(parts)  # exact, so in any order the same
        return float(1 / (1 + math.exp(-max(-500.0, min(500.0, logit)))))

    def __missing__(self, word: str) -> tuple[float, list[str]] | None:
        own, starts = self.weights.get(word + "$", 0.0), [p for p in prefixes(word) if p in self.starts]
        found = (own, starts) if own or starts else None
        if len(self) >= _CACHED:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


@lru_cache(maxsize=4)
def _scorer(model: Model) -> _Scorer:
    return _Scorer(model)


def fit(texts: list[list[str]], toxic: np.ndarray, settings: Settings = Settings()) -> Model:  # noqa: B008
    """``texts``: the distinct words of each; ``toxic``: 0 or 1 for each."""
    n, n1 = len(toxic), int(toxic.sum())
    n0 = n - n1
    if not n0 or not n1:
        return Model(500.0 if n1 else -500.0, ())

    index_of: dict[str, int] = {}
    coded = [np.fromiter((index_of.setdefault(w, len(index_of)) for w in t), np.int32, len(t)) for t in texts]
    names = list(index_of)
    starts: dict[str, int] = {}
    by_word = np.full((len(names), len(_PREFIXES)), -1, np.int32)
    for k, w in enumerate(names):
        found = [starts.setdefault(p, len(starts)) for p in prefixes(w)]
        by_word[k, : len(found)] = found
    size = len(names) + _LEVELS * len(starts)
    start_names = list(starts)

    def numbers(words_: np.ndarray) -> np.ndarray:
        """The features of a text: its words, then the beginnings by how many words have them."""
        some, times = np.unique(by_word[words_], return_counts=True)
        some, times = some[some >= 0], times[some >= 0]
        return np.concatenate([words_, *(len(names) + _LEVELS * some[times > n] + n for n in range(_LEVELS))])

    def name(k: int) -> str:
        return names[k] + "$" if k < len(names) else f"{start_names[(k - len(names)) // _LEVELS]}{(k - len(names)) % _LEVELS + 1}"

    sets = [numbers(c) for c in coded]
    seen = np.zeros((2, size), np.int64)
    for s, y in zip(sets, toxic, strict=True):
        seen[int(y), s] += 1
    p1, p0, p = (seen[1] + 0.5) / (n1 + 1), (seen[0] + 0.5) / (n0 + 1), (seen[0] + seen[1] + 1) / (n + 2)
    strength = np.where(seen[0] + seen[1] >= 2, abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)), 0)
    ranked = sorted(np.argsort(-strength, kind="stable")[: 4 * settings.max_features].tolist(), key=lambda k: (-strength[k], name(k)))[: settings.max_features]
    kept = [name(k) for k in ranked if strength[k] >= settings.z] or [name(k) for k in ranked[:20]]
    index = {f: k for k, f in enumerate(kept + sorted(features(set(_KIND)) - set(kept)))}

    def rows(many: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(many), len(index) + 1))
        out[:, -1] = 1
        for k, s in enumerate(many):
            out[k, [index[f] for f in s if f in index]] = 1
        return out

    places = np.full(size, -1)
    for f, k in index.items():
        if f[-1] == "$":
            number = index_of.get(f[:-1])
        else:
            number = starts.get(f[:-1])
            number = None if number is None else len(names) + _LEVELS * number + int(f[-1]) - 1
        if number is not None:
            places[number] = k
    x = np.zeros((n, len(index) + 1))
    x[:, -1] = 1
    for k, s in enumerate(sets):
        x[k, places[s][places[s] >= 0]] = 1

    pairs = [(t, c) for t in texts if not _KIND.keys().isdisjoint(t) for c in counterfactuals(set(t))]
    pairs += [({a}, {b}) for kind in IDENTITY_TERMS for a in kind for b in kind if a < b] + [({a}, set()) for a in _KIND]
    penalty = np.diag([settings.ridge * n] * len(index) + [1e-9])
    for at in range(0, len(pairs), 1000):
        change = rows([features(set(a)) for a, _ in pairs[at : at + 1000]]) - rows([features(b) for _, b in pairs[at : at + 1000]])
        penalty += settings.fairness * change.T @ change

    share = np.where(toxic == 1, n / (2 * n1), n / (2 * n0))
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - toxic)) + penalty @ w
        step = np.linalg.solve(x.T @ (x * (share * p * (1 - p))[:, None]) + penalty + 1e-8 * np.eye(len(w)), gradient)
        w -= step * min(1, 5 / max(1e-12, abs(step).max()))
        if abs(step).max() < 1e-4:
            break
    return Model(float(w[-1]), tuple((f, float(w[k])) for f, k in index.items() if abs(w[k]) > 1e-9))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Fit to labelled rows that aren't held out, of at most ``settings.max_rows`` labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.md5(F.col("labelled").cast("string"))).limit(settings.max_rows)
    found = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))  # max_rows rows

    @tidy
    def to_words(batches):
        for batch in batches:
            sets = [sorted(words(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.string())), batch.column(2)], ["doc_id", "words", "toxic"])

    rows = found.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(to_words, "doc_id long, words array<string>, toxic int").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return Model(-500.0, ())
    pool: dict[str, str] = {}
    texts = [[pool.setdefault(w, w) for w in row.as_py()] for row in rows.column("words")]
    return fit(texts, (rows.column("toxic").to_numpy() != 0).astype(float), settings)


def score(text: Column, model: Model) -> Column:
    @tidy
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(model)
        for texts in batches:
            yield pd.Series([scorer.score(t or "") for t in texts], dtype=float)

    return F.pandas_udf(scores, "double")(text)


def judge(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    scored = docs.select(docs["doc_id"].alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), score(docs["text"], model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model doesn't find toxic."""
    return docs.where(score(docs["text"], model) < threshold)
