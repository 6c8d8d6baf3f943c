"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicon words and word-start patterns that labelled texts suggest. A generative model (two
classes, each voter fires with a rate of its own in each) is fitted by expectation maximisation to
the votes; voters that fire together more than the classes explain share their evidence. The posteriors, not the labels, train a logistic classifier over all voters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import fold, with_computed
from snapforge.session import keep

SAMPLE = 20_000  # labelled rows that the model is fitted to
CANDIDATES = 4_000  # lexicon words and patterns that are looked at
VOTERS = 256
LEAST_TEXTS = 4  # toxic texts that a voter needs
PURITY = 0.6  # share of toxic texts among a voter's, as seen
STARTS = (3, 4, 5, 6)  # lengths of word starts
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def signs(word: str) -> list[str]:
    """Lexicon entries and patterns that a lower-case word shows."""
    return [word] + [word[:n] + "*" for n in STARTS if len(word) > n]


def text_signs(text: str | None) -> set[str]:
    return {s for w in set(_WORD.findall((text or "").lower())) for s in signs(w)}


@dataclass
class Model:
    """Classifier weights by sign, bias, and the voters' firing rates (toxic, clean) and parts of evidence."""

    weights: dict[str, float]
    bias: float
    rates: dict[str, tuple[float, float]]
    shares: dict[str, float]

    def score(self, present: set[str]) -> float:
        z = self.bias + sum(self.weights[s] for s in present)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of at most ``sample`` labelled rows, drawn by a hash of the id; of an id the highest label counts."""
    ids = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = ids.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    # Bounded by ``sample`` rows of an id and a label.
    return docs.select("doc_id", "text").join(F.broadcast(keep(drawn, "drawn")), "doc_id").select("text", "toxic")


def _count_signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, clean = Counter(), Counter()

    def rows():
        keys = list(toxic.keys() | clean.keys())
        return pd.DataFrame({"sign": keys, "t": [toxic[k] for k in keys], "c": [clean[k] for k in keys]})

    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"]):
            (toxic if label else clean).update(text_signs(text))
        if len(toxic) + len(clean) > 500_000:
            yield rows()
            toxic, clean = Counter(), Counter()
    if toxic or clean:
        yield rows()


def _candidates(sample: DataFrame, limit: int, least: int, purity: float) -> list[str]:
    counted = sample.mapInPandas(_count_signs, "sign string, t long, c long").groupBy("sign").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    good = counted.filter((F.col("t") >= least) & (F.col("t") >= purity * (F.col("t") + F.col("c"))))
    best = good.orderBy(F.desc(F.col("t") - 2 * F.col("c")), "sign").limit(limit)
    return [r.sign for r in best.select("sign").collect()]


def _votes(sample: DataFrame, candidates: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Dense votes (texts x candidates) and labels; at most SAMPLE x CANDIDATES bits come to the driver."""
    place = {s: i for i, s in enumerate(candidates)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits = [sorted(place[s] for s in text_signs(t) if s in place) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"], "hits": hits})

    rows = sample.mapInPandas(run, "toxic int, hits array<int>").toArrow()
    votes = np.zeros((rows.num_rows, len(candidates)), bool)
    hits = rows["hits"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    if rows.num_rows:
        lengths = np.diff(hits.offsets.to_numpy())
        votes[np.repeat(np.arange(rows.num_rows), lengths), hits.flatten().to_numpy()] = True
    return votes, rows["toxic"].to_numpy()


def _cover(votes: np.ndarray, labels: np.ndarray, most: int) -> list[int]:
    """Candidates in the order in which they explain toxic texts that fewer than two before explain."""
    toxic, clean = votes[labels > 0], votes[labels == 0].sum(axis=0)
    explained, chosen = np.zeros(len(toxic), int), []
    while len(chosen) < most:
        gain = toxic[explained < 2].sum(axis=0) - 3.0 * clean
        gain[chosen] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            break
        chosen.append(best)
        explained += toxic[:, best]
    return chosen


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each text, firing rates (2 x voters: clean, toxic), and the part of its evidence each voter keeps.

    Voters whose votes correlate by 0.3 or more beyond what the classes explain say partly the same;
    a voter's evidence is divided by the sum of those correlations, its own included.
    """
    n, m = votes.shape
    v = votes.astype(np.float64)
    post = start.astype(np.float64)
    share, rates = np.ones(m), np.zeros((2, m))
    # The given label is one more voter, right in 19 of 20 cases; it keeps the classes where they belong.
    told = math.log(prior / (1 - prior)) + np.where(start > 0.5, 1, -1) * math.log(19)
    for step in range(rounds):
        for k, p in enumerate((1 - post, post)):
            rates[k] = (p @ v + 0.05) / (p.sum() + 5)
        if step == 1:
            left = v - np.outer(post, rates[1]) - np.outer(1 - post, rates[0])
            cov = left.T @ left / n
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            alike = np.abs(cov / np.outer(sd, sd))
            share = 1 / np.where(alike >= 0.3, alike, 0).sum(axis=1).clip(1)
        on = np.log(rates[1] / rates[0]) * share
        off = np.log((1 - rates[1]) / (1 - rates[0])) * share
        z = told + v @ on + (1 - v) @ off
        post = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    return post, rates, share


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 15) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(hess, grad)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled texts. Without toxic labels it calls nothing toxic."""
    texts = keep(labelled_sample(docs, labels, sample), "labelled")
    names = _candidates(texts, CANDIDATES, LEAST_TEXTS, PURITY)
    if not names:
        return Model({}, -5.0, {}, {})
    votes, toxic = _votes(texts, names)
    chosen = _cover(votes, toxic, VOTERS)
    votes, names = votes[:, chosen], [names[i] for i in chosen]
    prior = float(np.clip(toxic.mean(), 0.01, 0.5))
    post, rates, share = label_model(votes, prior, np.clip(toxic.astype(float), 0.05, 0.95))
    w = _logistic(votes.astype(np.float64), post)
    return Model(
        dict(zip(names, w[:-1].tolist())), float(w[-1]),
        {s: (float(a), float(b)) for s, a, b in zip(names, rates[1], rates[0])}, dict(zip(names, share.tolist())),
    )


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` and ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) of each whole text; null and empty texts get the score of no sign."""
    known = model.weights  # at most VOTERS entries

    def factory():
        seen: dict[str, tuple[str, ...]] = {}

        def found(word: str) -> tuple[str, ...]:
            if len(seen) > 300_000:
                seen.clear()
            out = seen[word] = tuple(s for s in signs(word.lower()) if s in known)
            return out

        def compute(column: pa.Array):
            values = []
            for text in column.to_pylist():
                present: set[str] = set()
                for word in set(_WORD.findall(text or "")):
                    hit = seen.get(word)
                    hit = found(word) if hit is None else hit
                    if hit:
                        present.update(hit)
                values.append(model.score(present))
            return [values, [int(s >= threshold) for s in values]]

        return compute

    return with_computed(docs, factory, "score double, predicted int")


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``held_out``, ``score``, ``predicted``; labels of held-out rows are never read."""
    learn = labels.filter(~fold(F.col("doc_id"), 4, 2))
    return score(docs.select("doc_id", "text", fold(F.col("doc_id"), 4, 2).alias("held_out")), fit(docs, learn))
