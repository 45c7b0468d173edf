"""Toxicity by a classifier chain over binary term features.

Categories are predicted in order. The model of a category sees the terms and the
probabilities of the categories before it. While training, those are out-of-fold
predictions, so later models do not trust earlier ones more than they deserve.

Terms of a text are its lower-cased words (runs of letters) and their first 4 and 5
letters, so that unseen inflections of a word still count. Features are the terms that
separate the labelled rows best; they are counted by Spark over the training sample.
"""

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.linear import fit_logistic, sigmoid
from ticklane.llm.tables import share, ship, sized, stored, texts, tidied

#: Bounds of the training sample and of the feature set.
TRAIN_ROWS, FEATURES = 8_000, 600
#: A term needs so many documents of the sample.
LEAST_DOCS = 4
FOLDS = 3
#: Distinct marker words from which a toxic text counts as repeatedly or severely so.
REPEATED, SEVERE = 3, 6
_WORD = re.compile(r"[^\W\d_]+")
_WORDS_KEPT = 100_000


def terms(word: str) -> tuple[str, ...]:
    """A word and its prefixes as features; a prefix ends in *."""
    return (word, *(word[:n] + "*" for n in (4, 5) if len(word) >= n))


def _terms_of(frames, labels: list[str]):
    for frame in frames:
        found = [sorted({t for w in set(_WORD.findall(x.lower())) for t in terms(w)}) for x in frame.text]
        yield pd.DataFrame({"terms": found, "fold": frame.fold, **{c: frame[c] for c in labels}})


@dataclass
class Chain:
    """features: term to column. models: per category (weights, weights of earlier ones, intercept)."""

    categories: list[str]
    features: dict[str, int]
    models: list[tuple[np.ndarray, np.ndarray, float]]

    def probabilities(self, columns: list[int]) -> list[float]:
        """Per category, of a text that has the features in these columns."""
        found: list[float] = []
        for w, before, b in self.models:
            found.append(float(sigmoid(w[columns].sum() + before @ np.array(found) + b)))
        return found


def fit_chain(x: np.ndarray, y: dict[str, np.ndarray], fold: np.ndarray, features: dict[str, int]) -> Chain:
    """The chain for categories in the order of y. x: rows by features, 0 or 1."""
    before = np.zeros((len(x), 0))
    models = []
    for target in y.values():
        inputs = np.hstack([x, before.astype(np.float32)])
        out = np.zeros(len(x))
        for k in range(FOLDS):
            w, b = fit_logistic(inputs[fold != k], target[fold != k], l2=1e-4)
            out[fold == k] = sigmoid(inputs[fold == k] @ w + b)
        w, b = fit_logistic(inputs, target, l2=1e-4)
        models.append((w[: x.shape[1]], w[x.shape[1] :], b))
        before = np.hstack([before, out[:, None]])
    return Chain(list(y), features, models)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", rows: int = TRAIN_ROWS) -> Chain:
    """A chain (severe, repeated, toxic) from labels (doc_id, column 0 or 1).

    The earlier two categories are made from the label: a toxic text with at least SEVERE,
    or REPEATED, distinct marker words, which are features found ten times likelier in
    toxic rows. About `rows` labelled rows are used, chosen by a hash of doc_id. Null
    labels and documents without a label are left out. Without any label nothing is toxic.
    """
    labels = labels.select("doc_id", F.col(column).cast("double").alias("y")).dropna().dropDuplicates(["doc_id"])
    sample = stored(labels.filter(share("doc_id", rows, labels.count())), "toxic-labels")
    rows_of = texts(docs).join(sized(sample), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    sample = stored(rows_of.mapInPandas(lambda f: tidied(_terms_of(f, ["y"])), "terms array<string>, fold int, y double"), "toxic-terms")
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    a, c = F.sum("y"), F.count("*")
    rate, base = (a + 0.1) / (positive + 1), (c - a + 0.1) / (n - positive + 1)
    counts = sample.select(F.explode("terms").alias("term"), "y").groupBy("term").agg(
        c.alias("docs"), F.log(rate / base).alias("odds"), (F.abs(rate - base) / F.sqrt((c + 1.0) / (n + 1) / F.lit(n + 1))).alias("z")
    )
    if not n:
        return Chain(["severe", "repeated", "toxic"], {}, [(np.zeros(0), np.zeros(i), -10.0) for i in range(3)])
    chosen = counts.filter(F.col("docs") >= LEAST_DOCS).orderBy(F.desc("z"), "term").limit(FEATURES).collect()
    features = {r.term: i for i, r in enumerate(chosen)}
    markers = [r.term for r in chosen if r.odds >= np.log(10.0) and not r.term.endswith("*")]
    picked = sample.select("fold", "y", F.array_intersect("terms", F.array(*map(F.lit, features)) if features else F.array().cast("array<string>")).alias("terms")).toPandas()
    x = np.zeros((len(picked), len(features)), np.float32)
    for i, found in enumerate(picked.terms):
        x[i, [features[t] for t in found]] = 1.0
    seen = x[:, [features[t] for t in markers]].sum(axis=1)
    y = picked.y.to_numpy(float)
    targets = {"severe": y * (seen >= SEVERE), "repeated": y * (seen >= REPEATED), "toxic": y}
    return fit_chain(x, targets, picked.fold.to_numpy(), features)


class _Columns(dict):
    def __init__(self, features: dict[str, int]):
        self.features = features

    def __missing__(self, word: str):
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = found = tuple(self.features[t] for t in terms(word) if t in self.features)
        return found


def _likely(chain: Chain, columns: _Columns, text: str) -> list[float]:
    return chain.probabilities(sorted({c for w in set(_WORD.findall(text.lower())) for c in columns[w]}))


def _scored(frames, chain: Chain):
    columns = _Columns(chain.features)
    for frame in frames:
        found = [_likely(chain, columns, x) for x in frame.text]
        out = frame.drop(columns="text")
        for i, name in enumerate(chain.categories):
            out[f"p_{name}"] = [p[i] for p in found]
        yield out


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_<category> ..., toxic) for each row; whole texts.

    A null text is empty; it and a text without known terms get the base rate. Rows are
    kept as they are, also repeated ones and those with a null doc_id. Other columns go.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories)
    scored = texts(docs).mapInPandas(lambda f: tidied(_scored(f, model.value)), schema)
    return scored.withColumn("toxic", (F.col(f"p_{chain.categories[-1]}") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that the chain does not call toxic."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def clean(batches):
        columns = _Columns(model.value.features)
        for batch in batches:
            found = batch.column("text").to_pylist()
            yield batch.filter(pa.array([_likely(model.value, columns, x or "")[-1] < threshold for x in found], pa.bool_()))

    return docs.mapInArrow(lambda b: tidied(clean(b)), docs.schema)
