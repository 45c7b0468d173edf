"""Lexical search against a score of every pair."""

import math
import random
import re
from collections import Counter

import pytest

from made import make_docs  # noqa: F401
from ticklane.llm import lexical_search
from ticklane.llm.lexical_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string, score double, doc_id string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, top=50):
    docs = [(d, Counter(terms(x))) for d, x in docs if d is not None]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df, least, out = Counter(t for _, c in docs for t in c), {}, []
    for i, x in items:
        if i is not None:
            least[i] = min(least.get(i, x or ""), x or "")
    for item, text in least.items():
        scored = []
        for d, c in docs:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.fixture
def found(spark, make_docs):
    def run(docs, items, **options):
        frame = spark.createDataFrame([(i, x, 0.5, "x") for i, x in items], ITEMS)
        return sorted(map(tuple, search(make_docs(*docs).repartition(3), frame, **options).collect()))

    return run


def made(seed, docs=400, items=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Äpfel", "naïve", "x2"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: ", ".join(rng.choices(words, weights, k=n)).title()
    rows = [(i, text(rng.choice([1, 5, 30, 200]))) for i in range(docs)]
    rows += [(docs + i, rows[7][1]) for i in range(80)]  # ties beyond the last place
    return rows, [(i, text(12)) for i in range(items)]


@pytest.mark.parametrize("options", [{}, {"part_terms": 60}, {"top": 3}])
def test_equals_scores_of_all_pairs(found, monkeypatch, options):
    monkeypatch.setattr(lexical_search, "LEAF", 16)
    monkeypatch.setattr(lexical_search, "BRANCH", 64)
    docs, items = made(1)
    assert found(docs, items, **options) == plain(docs, items, options.get("top", 50))


def test_odd_rows(found):
    docs = [(1, "alpha beta"), (1, "alpha"), (None, "alpha"), (2, None), (3, ""), (4, "?!"), (5, "ALPHA Älpha älpha"), (6, "x " * 20_000 + "beta"), (-7, "beta")]
    items = [(1, "alpha ALPHA älpha"), (1, "Beta"), (None, "alpha"), (2, None), (3, "..."), (4, "nowhere"), (5, "beta beta x")]
    assert found(docs, items) == plain(docs, items)


def test_empty_tables(found):
    assert found([], [(1, "alpha")]) == [] == found([(1, "alpha")], [])


def test_bounds_hold_and_prune():
    """No item is left out of a node where it could place; most pairs of nodes are never scored."""
    import numpy as np
    import pyarrow as pa

    tree = lexical_search.ItemTree.of([(i, [f"t{i}", f"t{i + 1}", "the"]) for i in range(40)])
    rng, width = np.random.default_rng(0), len(tree.vocabulary)
    ids = [np.sort(rng.choice(width, 6, replace=False)).astype(np.int32) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(600), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([[int(x) * 7 + 1 for x in row] for row in ids], pa.list_(pa.int64()))],
        ["doc_id", "ids", "summands"],
    )
    run, every = lexical_search._Search(tree), []
    run.search([batch])
    for item in range(40):
        own = set(tree.terms(item))
        scores = sorted(((-sum(int(t) * 7 + 1 for t in row if t in own), d) for d, row in enumerate(ids)))
        every.append([(-s, d) for s, d in scores if s < 0][:50])
        assert list(zip(*run.best[item])) == every[item]
    again = lexical_search._Search(tree)
    again.floors = run.floors.copy()
    calls = []
    again.score = lambda node, k, item: calls.append((k, item))
    again.search([batch])
    assert len(calls) <= 40 * 5
