"""The byte network against finite differences, a byte-by-byte reading, and held-out languages."""

import math

import numpy as np
import pytest

from conftest import SMALL
from made import make_docs  # noqa: F401
from ticklane.llm import byte_gru, queries


def network(seed, hidden=3, languages=("a", "b", "c"), kind=np.float64):
    rng = np.random.default_rng(seed)
    net = byte_gru.Network(
        list(languages), byte_gru.new_unit(rng, hidden), byte_gru.new_unit(rng, hidden),
        {"w": rng.normal(0, 0.5, (2 * hidden, len(languages))), "b": rng.normal(0, 0.5, len(languages))},
    )
    for part in (net.forward, net.backward, net.out):
        part.update({k: v.astype(kind) for k, v in part.items()})
    return net


def test_gradients_are_those_of_finite_differences():
    net, rng = network(1), np.random.default_rng(2)
    windows, sizes, y = rng.integers(1, 5, (4, 7)).astype(np.uint8), np.array([7, 5, 2, 1]), np.array([0, 2, 1, 1])
    _, found = net.gradient(windows, sizes, y)
    for name in ("forward", "backward", "out"):
        for key, weights in getattr(net, name).items():
            for _ in range(6):
                at = tuple(rng.integers(0, n) for n in weights.shape) if key != "x" else (windows[rng.integers(4), 0], rng.integers(9))
                was, ends = weights[at], []
                for move in (1e-4, -1e-4):
                    weights[at] = was + move
                    ends.append(net.gradient(windows, sizes, y)[0])
                weights[at] = was
                assert math.isclose((ends[0] - ends[1]) / 2e-4, found[name][key][at], rel_tol=0.02, abs_tol=2e-5)


def by_byte(net, raw):
    """Mean probabilities of a text, one byte after the other, in plain loops."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    total = np.zeros(len(net.languages))
    for start in range(0, len(raw), byte_gru.WINDOW):
        window = raw[start : start + byte_gru.WINDOW]
        states = []
        for unit, order in ((net.forward, range(len(window))), (net.backward, range(len(window) - 1, -1, -1))):
            k, seen = unit["h"].shape[0], {}
            h = [0.0] * k
            for t in order:
                x, u = unit["x"][window[t]] + unit["b"], [sum(h[i] * unit["h"][i, j] for i in range(k)) for j in range(3 * k)]
                z, r = [sig(x[j] + u[j]) for j in range(k)], [sig(x[k + j] + u[k + j]) for j in range(k)]
                new = [math.tanh(x[2 * k + j] + r[j] * u[2 * k + j]) for j in range(k)]
                h = [(1 - z[j]) * new[j] + z[j] * h[j] for j in range(k)]
                seen[t] = h
            states.append(seen)
        for t in range(len(window)):
            e = np.exp(np.array(states[0][t] + states[1][t]) @ net.out["w"] + net.out["b"])
            total += e / e.sum()
    return total / max(len(raw), 1)


def test_document_probabilities_are_means_over_every_byte(spark, make_docs, monkeypatch):
    monkeypatch.setattr(byte_gru, "WINDOW", 16)
    monkeypatch.setattr(byte_gru, "AT_ONCE", 4)
    net = network(3, kind=np.float32)
    texts = ["a", "Zażółć gęślą jaźń", "many words " * 40, "x" * 16, "y" * 17, "ends with ü"]
    sums = byte_gru._sums(net, [t.encode() for t in texts])
    for text, row in zip(texts, sums):
        raw = text.encode()
        assert np.allclose(row / len(raw), by_byte(net, raw), atol=1e-4)


def test_odd_rows(spark, make_docs):
    net = network(4, kind=np.float32)
    big = 2**60 + 1
    docs = make_docs((1, None), (2, ""), (3, "12 + 3_4 = ?"), (None, "word"), (5, "word"), (5, "word"), (big, "é"), (7, "long " * 50_000))
    rows = byte_gru.predict(docs, net).collect()
    found = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == 8 and found[1] == found[2] == found[3] == ("und", 0.0)
    assert found[None] == found[5] and found[5][0] in net.languages and 0 < found[big][1] <= 1 and 0 < found[7][1] <= 1
    assert byte_gru.predict(make_docs(), net).count() == 0


def test_training_without_or_with_one_language(spark, make_docs):
    docs = make_docs("one text", "another")
    assert {r.lang_pred for r in byte_gru.predict(docs, byte_gru.train(docs)).collect()} == {"und"}
    only = docs.drop("lang").withColumn("lang", docs["source"])
    assert {r.lang_pred for r in byte_gru.predict(docs, byte_gru.train(only)).collect()} == {"s"}


@pytest.mark.parametrize("folder", [SMALL.replace("0.001", "0.01")])
def test_held_out_languages(spark, folder):
    docs = queries.table(spark, folder, "documents").select("doc_id", "lang")
    rows = queries.QUERIES["op13_byte_gru"](spark, folder).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 0.2 < len(held) / len(rows) < 0.3
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
