"""Toxicity: classifiers learned from confirmed toxic texts and unlabelled ones (nnPU)."""

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

from fairshare.llm.samples import draw_keys, known_labels, one_text_each
from fairshare.sources.tables import settle

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
#: A word or beginning that stands so often in a text is a feature, for each of these numbers.
TIMES = (1, 2, 3)
#: Features take part whose shares differ by as many standard errors,
CLEAR = 3.0
#: and whose share among the toxic is this part of the most that the class prior allows.
LEAST_LIFT = 0.4


def features(text: str | None) -> set[tuple[str, int]]:
    """(word or beginning of a longer word, times it stands in the whole text at least)."""
    words = Counter(WORDS.findall((text or "").lower()))
    units = Counter(words)
    for n in PREFIXES:
        for word, times in words.items():
            if len(word) > n:
                units[word[:n] + "*"] += times
    return {(unit, n) for unit, times in units.items() for n in TIMES if times >= n}


@dataclass(frozen=True)
class Classifier:
    """Logistic scores over named features: an ensemble's mean weights and bias."""

    weights: dict[str, tuple[float, ...]]
    bias: float
    prior: float


def text_score(weights: dict[str, tuple[float, ...]], bias: float, text: str | None) -> float:
    """From 0 to 1; null and empty texts get the score of the bias alone.

    ``weights`` holds, for a word or beginning, the sums of the weights of its first features.
    """
    found: dict[str, int] = {}
    for word, times in Counter(WORDS.findall((text or "").lower())).items():
        if word in weights:
            found[word] = found.get(word, 0) + times
        for n in PREFIXES:
            if len(word) <= n:
                break
            if (unit := word[:n] + "*") in weights:
                found[unit] = found.get(unit, 0) + times
    total = bias + sum(weights[unit][min(times, len(TIMES)) - 1] for unit, times in sorted(found.items()))
    return 1 / (1 + math.exp(-min(max(total, -30.0), 30.0)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Rows:
    """Sparse 0/1 rows: feature numbers, one row after another."""

    def __init__(self, rows: list[np.ndarray]):
        self.index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, g[self.row], minlength=size)


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float,
    steps: int = 500, rate: float = 0.1, decay: float = 1e-5,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative positive-unlabelled risk with logistic loss.

    The risk of the negatives is that of the unlabelled less ``prior`` times that of the positives
    taken as negatives. Where it falls below zero the model has begun to fit single unlabelled
    rows, and the step goes the other way on that part.
    """
    p, u = _Rows(positive), _Rows(unlabelled)
    w, b = np.zeros(size), 0.0
    first, second, moved = np.zeros(size + 1), np.zeros(size + 1), 0
    for step in range(1, steps + 1):
        zp, zu = p.dot(w) + b, u.dot(w) + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_as_negative = _sigmoid(zp) / p.n
        gu_as_negative = _sigmoid(zu) / u.n
        if negative >= 0:
            gp, gu = -prior * _sigmoid(-zp) / p.n - prior * gp_as_negative, gu_as_negative
        else:
            gp, gu = prior * gp_as_negative, -gu_as_negative
        grad = np.append(p.back(gp, size) + u.back(gu, size) + decay * w, gp.sum() + gu.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        moved = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= rate * moved[:-1]
        b -= rate * moved[-1]
    return w, float(b)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_rows: int = 6_000,
    vocabulary: int = 20_000,
    members: int = 3,
    seed: int = 7,
) -> Classifier:
    """Fit on at most ``most_rows`` confirmed toxic rows and as many unlabelled ones.

    ``docs`` holds the documents that may be learned from; unlabelled rows are drawn from all of
    them. ``labels`` holds (key, label) of the rows that may be learned from; positives are drawn
    from those with label 1, and the class prior is the share of label 1 among all of them. Both
    draws take distinct keys by a seeded hash and one row for each (``samples.one_text_each``).
    Executors turn the whole texts into features and count them by class; features take part if
    their shares in the two samples differ clearly (``CLEAR``, ``LEAST_LIFT``), at most
    ``vocabulary`` of them, the clearest first. Only those names and their numbers in the sampled
    rows reach the driver. Null keys and null labels are not learned from. With no positives, no
    unlabelled rows or no such feature the classifier gives every text score 0. Several members are
    trained on halves of the rows, and their mean is taken.
    """
    known = settle(known_labels(labels, key, label), "known")
    counted = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("p")).first()
    if not counted["p"]:
        return Classifier({}, -30.0, 0.0)
    prior = counted["p"] / counted["n"]
    some = draw_keys(known.where("y"), most_rows, seed).withColumn("toxic", F.lit(True))
    rest = draw_keys(docs.select(F.col(f"`{key}`").alias("key")), most_rows, seed).withColumn("toxic", F.lit(False))
    drawn = settle(some.unionByName(rest), "drawn")
    sample = one_text_each(docs, drawn, key, text).select("key", "toxic", F.col("doc.text").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(f"{n}{u}" for u, n in features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("toxic"), pa.array(found, pa.list_(pa.string()))],
                names=["key", "toxic", "found"],
            )

    key_type = sample.schema["key"].dataType.simpleString()
    sample = settle(sample.mapInArrow(featured, f"key {key_type}, toxic boolean, found array<string>"), "features")
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return Classifier({}, -30.0, prior)
    names = _clear_features(sample, total, prior, vocabulary)
    if not names:
        return Classifier({}, -30.0, prior)
    listed = sample.sparkSession.createDataFrame(list(enumerate(names)), "number int, name string")
    named = sample.select("key", "toxic", F.explode_outer("found").alias("name"))
    kept = named.join(F.broadcast(listed), "name", "left").groupBy("key", "toxic")
    kept = kept.agg(F.sort_array(F.collect_list("number")).alias("numbers")).orderBy("key")
    rows: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for batch in kept.toArrow().to_batches():
        numbers = batch.column("numbers")
        offsets, flat = numbers.offsets.to_numpy(), numbers.values.to_numpy()
        for k, toxic in enumerate(batch.column("toxic").to_pylist()):
            rows[toxic].append(flat[offsets[k] : offsets[k + 1]])
    return _fit(rows, names, prior, members, seed)


def _clear_features(sample: DataFrame, total: dict[bool, int], prior: float, most: int) -> list[str]:
    """Names of the features that stand clearly more often in toxic rows, sorted; counted on the executors."""
    times = sample.select("toxic", F.explode("found").alias("name")).groupBy("name")
    times = times.agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("u"))
    rate = {True: F.col("p") / total[True], False: F.col("u") / total[False]}
    spread = F.sqrt(sum(((rate[c] + 0.5 / n) / n for c, n in total.items()), F.lit(0.0)))
    clear = times.withColumn("clear", (rate[True] - rate[False]) / spread)
    # a feature of toxic texts alone is 1 / prior times as frequent in them as in all texts
    own = clear.where((F.col("clear") >= CLEAR) & (rate[True] * prior >= rate[False] * LEAST_LIFT))
    return sorted(r["name"] for r in own.orderBy(F.desc("clear"), "name").limit(most).select("name").collect())


def _fit(rows: dict[bool, list[np.ndarray]], names: list[str], prior: float, members: int, seed: int) -> Classifier:
    """The mean of ``members`` classifiers; rows are feature numbers by class, in order of their keys."""
    fits = []
    for m in range(members):
        rng = np.random.default_rng(seed + m)
        part = {c: [x[i] for i in np.sort(rng.permutation(len(x))[: max(1, (len(x) + 1) // 2)])] for c, x in rows.items()}
        fits.append(fit_nnpu(part[True], part[False], len(names), prior))
    mean = np.mean([w for w, _ in fits], axis=0)
    weights: dict[str, np.ndarray] = {}
    for name, x in zip(names, mean):
        at, unit = TIMES.index(int(name[0])), name[1:]
        weights.setdefault(unit, np.zeros(len(TIMES)))[at:] += x
    tuples = {unit: tuple(map(float, x)) for unit, x in weights.items()}
    return Classifier(tuples, float(np.mean([b for _, b in fits])), prior)


def score(docs: DataFrame, model: Classifier, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``: the score of the whole text, from 0 to 1. A column of that name goes."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        weights, bias = shared.value
        return pd.Series([text_score(weights, bias, t) for t in texts], dtype="float64")

    return docs.withColumn(into, scored(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
