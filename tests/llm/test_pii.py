"""Personal data: base spans against plain patterns, and what the method adds."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from made import make_docs  # noqa: F401
from ticklane.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, span):
    digits = [int(c) for c in span if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    order = list(PATTERNS)
    return sorted((m.start(), order.index(k), m.end()) for k in order for m in re.finditer(PATTERNS[k], text or "") if passes(k, m[0]))


def odd_texts():
    rng = random.Random(2)
    parts = [*"0123456789.@+- ()aZ_%é中😀\n", "4111111111111111", "5500 0000 0000 0004", "a.b@c.de", "a@b.c@d.ef%g@h.ij", "127.0.0.1", "1.2.3.4.5.6.7.8",
             "256.1.1.1", "0001.2.3.004", "+49 (30) 1234-567", "+1+2+3", "192.168.1.77", "x@y", "@@", "..", "--"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(500)]
    return [*made, None, "", "9" * 30_000, "a." * 20_000 + "@b" + ".c" * 20_000, "1.2.3.4 " * 500, "- " * 5_000, "+1 " * 5_000, "1 " * 9_000]


def test_base_spans_equal_plain_patterns(make_docs):
    texts = odd_texts()
    found = {r.doc_id: r.spans for r in pii.find_pii(make_docs(*texts)).collect()}
    for i, text in enumerate(texts):
        assert [(s.start, s["rank"], s.end) for s in found[i] if s.base] == base_spans(text), text and text[:80]


def test_no_candidate_is_lost_to_the_first_filter(make_docs):
    sparse = ["pay 4" + " 1" * 15 + " now", "card 4" + "-1" * 15 + ".", "0" + " 0" * 11, "1" + "-1" * 18, "+1 2 3 4 5 6 7 8 9", "a@b.c", "1.2.3.4"]
    found = {r.doc_id: r.spans for r in pii.find_pii(make_docs(*sparse)).collect()}
    for i, text in enumerate(sparse):
        assert [(s.start, s["rank"], s.end) for s in found[i] if s.base] == base_spans(text), text
    assert [s.kind for s in found[0]] == [s.kind for s in found[1]] == ["card"]
    clean = {r.doc_id: r.text for r in pii.redacted(make_docs(*sparse)).collect()}
    assert (clean[0], clean[1]) == ("pay [CARD] now", "card [CARD].")
    loose = ["token a1b2c3d4e5f6a7b8 end", "ABCDEFGHIJKLMNOPQRST", "ABCD1E2F3G4H5I6J7K8L", "a-b-c-d-e-f-g-h-1-j-k-l-m-n-o-p-q", "1a2b3c4d5e6f7a8b"]
    kinds = make_docs(*loose).select("doc_id", pii.candidates(F.col("text"))["kind"].alias("kinds")).collect()
    assert [r.kinds for r in sorted(kinds)] == [["secret"], ["key"], ["key"], ["secret"], ["secret"]]


def test_method_adds_spans_and_keeps_the_base(make_docs):
    rng = random.Random(3)
    texts = []
    for i in range(120):
        key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        texts.append(f"some words here with key {key} and then token = \"{token}\" and mail me.{i}@mail.example.com or +1 (415) 555-{1000 + i} end")
        texts.append("nothing to see here, only plain words and the number 12345678")
    docs = make_docs(*texts)
    for r in pii.find_pii(docs).collect():
        kinds = [s.kind for s in r.spans]
        assert kinds == (["key", "secret", "email", "phone"] if r.doc_id % 2 == 0 else []), texts[r.doc_id]
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns and clean.schema == docs.schema
    for r in clean.collect():
        if r.doc_id % 2 == 0:
            assert r.text == 'some words here with key [KEY] and then token = "[SECRET]" and mail [EMAIL] or [PHONE] end'
        else:
            assert r.text == texts[r.doc_id]
        assert r.n_chars == len(r.text)


def test_odd_rows(make_docs):
    docs = make_docs((None, "a@b.cd"), (1, None), (1, "x"), (2, ""), (2, "é😀 a@b.cd"))
    found = sorted((str(r.doc_id), [(s.start, s.end) for s in r.spans]) for r in pii.find_pii(docs).collect())
    assert found == [("1", []), ("1", []), ("2", []), ("2", [(3, 9)]), ("None", [(0, 6)])]
    assert sorted(str(r.text) for r in pii.redacted(docs).collect()) == ["", "None", "[EMAIL]", "x", "é😀 [EMAIL]"]
    assert pii.find_pii(make_docs()).collect() == [] and pii.redacted(make_docs()).collect() == []


def test_no_python_on_the_main_path(make_docs):
    docs = make_docs("a@b.cd", "call +49 30 1234567")
    for frame in (pii.redacted(docs), docs.select(pii.candidates(F.col("text")))):
        assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.3
    right, silent = [0.95, 0.9, 0.75, 0.8], [0.0, 0.2, 0.6, 0.4]
    votes = []
    for p, q in zip(right, silent):
        v = np.where((rng.random(20_000) < p) == truth, 2, 0)
        votes.append(np.where(rng.random(20_000) < q, 1, v))
    patterns, counts = np.unique(np.array(votes).T, axis=0, return_counts=True)
    prior, table = pii.reliabilities([(tuple(p), c) for p, c in zip(patterns, counts)])
    assert prior == pytest.approx(0.3, abs=0.04)
    for j, (p, q) in enumerate(zip(right, silent)):
        assert table[j, 1, 2] == pytest.approx(p * (1 - q), abs=0.06)


@pytest.mark.parametrize("text", ["12, " * 100_000, "a1@b.de 10.0.0.1 555-123-4567 " * 5_000, ("4111 1111 1111 1111, " + "0123456789abcdef, ") * 4_000])
def test_many_matches_in_one_text_take_seconds(make_docs, text):
    began = time.perf_counter()
    (row,) = pii.find_pii(make_docs(text)).collect()
    (clean,) = pii.redacted(make_docs(text)).collect()
    assert time.perf_counter() - began < 60
    assert [(s.start, s["rank"], s.end) for s in row.spans if s.base] == base_spans(text)
    assert "a1@b" not in clean.text and "10.0.0.1" not in clean.text
