"""Quality by a sparse rule ensemble.

Shallow trees of a random forest are grown on statistics of labelled texts. Every path from
a root is a rule, a conjunction of conditions on statistics. A logistic model with an l1
penalty weighs the rules and drops most. What is left is compiled into one column
expression over the columns of statistics.
"""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.llm.linear import fit_logistic
from ticklane.llm.tables import share, sized, stored, texts
from ticklane.llm.trees import nested, paths

#: Bounds of the training sample and of the forest.
TRAIN_ROWS, TREES, DEPTH = 10_000, 24, 3
STATISTICS = (
    "words", "chars_per_word", "distinct", "top_word", "symbols", "upper", "digits", "exclaims", "pipes", "stops", "newlines",
    "dup_lines", "words_per_line", "long_words", "non_ascii", "same_as_next",
)
_SPACES = b" \t\n\x0b\x0c\r"


def statistics(text: str) -> list[float]:
    """The statistics of a text, in the order of STATISTICS; all 0 without words."""
    raw = text.encode("utf-8")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(raw) - (len(raw) - len(raw.translate(None, _SPACES)))
    of = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line]
    return [
        float(n), size / n, len(counts) / n, max(counts.values()) / n, of(b"#*$%&|<>"), of(bytes(range(65, 91))), of(b"0123456789"),
        raw.count(b"!") / n, raw.count(b"|") / n, raw.count(b".") / n, len(lines) / n, 1 - len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1), sum(len(w) > 14 for w in counts) / len(counts), (len(raw) - len(text)) / size,
        sum(map(bytes.__eq__, words, words[1:])) / n,
    ]


def _measured(frames):
    for frame in frames:
        out = pd.DataFrame([statistics(t) for t in frame.text], columns=STATISTICS, dtype=float)
        for name in reversed([c for c in frame.columns if c != "text"]):
            out.insert(0, name, frame[name].array)
        yield out


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in keep and the statistics of each row's whole text."""
    rows = texts(docs, "text", *keep)
    kept = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes if name != "text")
    return rows.mapInPandas(_measured, f"{kept}, " + ", ".join(f"{s} double" for s in STATISTICS))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict[tuple, float]:
    """Weights of the kept rules, and the intercept under (). labels: doc_id, quality 0 or 1.

    About `rows` labelled documents are used, chosen by a hash of doc_id.
    """
    labels = labels.select("doc_id", F.col("quality").cast("double").alias("label")).dropna().dropDuplicates(["doc_id"])
    sample = stored(labels.filter(share("doc_id", rows, labels.count())), "quality-labels")
    found = measured(docs.select("doc_id", "text").join(sized(sample), "doc_id"), "label")
    found = stored(found.select("label", F.array(*STATISTICS).alias("x")), "quality-sample")
    local = found.toPandas()
    if local.empty or local.label.nunique() < 2:
        mean = 0.5 if local.empty else float(np.clip(local.label.mean(), 0.01, 0.99))
        return {(): float(np.log(mean / (1 - mean)))}
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=5)
    model = forest.fit(found.select("label", array_to_vector("x").alias("features")))
    rules = sorted({p for tree in model.trees for p in paths(nested(tree.toDebugString))})
    x = np.array(local.x.tolist())
    holds = np.column_stack([np.all([x[:, f] <= t if op == "<=" else x[:, f] > t for f, op, t in rule], axis=0) for rule in rules])
    w, b = fit_logistic(holds, local.label.to_numpy(), l1=2e-4, l2=1e-6, steps=600)
    return {(): b} | {rule: float(v) for rule, v in zip(rules, w) if v}


def compiled(model: dict[tuple, float]) -> Column:
    """The score of a row of statistics, between 0 and 1, as a column expression."""
    z = F.lit(float(model[()]))
    for rule, w in model.items():
        if rule:
            condition = F.lit(True)
            for feature, op, threshold in rule:
                column = F.col(STATISTICS[feature])
                condition = condition & (column <= threshold if op == "<=" else column > threshold)
            z = z + F.when(condition, F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score(docs: DataFrame, model: dict[tuple, float]) -> DataFrame:
    """(doc_id, score) for each row.

    A null or empty text has zero statistics and is scored by them. Rows stay as they are,
    also repeated ones and those with a null doc_id; other columns go.
    """
    return measured(docs).select("doc_id", compiled(model).alias("score"))
