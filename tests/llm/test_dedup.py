"""Near joins, suffix de-duplication and decontamination against brute force."""

import hashlib
import random
import time

import numpy as np
import pandas as pd
import pytest

from made import make_docs  # noqa: F401
from ticklane.llm import contamination, near_join, suffix_dedup, tables
from ticklane.llm.components import components
from ticklane.llm.shingles import WordHashes, shingle_sets


def words(n, seed, vocabulary=5000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def classes(rows):
    """(set size, smallest linked id) by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def changed(w, places):
    return [f"new{p}-{i}" if i in places else x for i, (x, p) in enumerate(zip(w, [len(w)] * len(w)))]


def near_rows(seed):
    rng = random.Random(seed)
    rows = []
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 60, 200):
        for group in range(3):
            base = words(size, seed * 1000 + size * 10 + group, 40 if size < 10 else 5000)
            for _ in range(4):
                w = changed(base, {rng.randrange(size) for _ in range(rng.randrange(1 + size // 25 + 1))})
                w = w[: len(w) - rng.randrange(1 + size // 6)] + words(rng.randrange(1 + size // 6), rng.random())
                rows.append(" ".join(w).upper() if rng.random() < 0.2 else " \n".join(w))
    passage = " ".join(words(40, 1))
    rows += [passage + " " + " ".join(words(rng.randrange(3, 60), 50 + i)) for i in range(40)]
    rows += rows[:6]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("seed,common", [(1, (10_000, 8)), (2, (10, 2)), (3, (10_000, 10**6))])
def test_near_join_equals_all_pairs(make_docs, monkeypatch, seed, common):
    monkeypatch.setattr(near_join, "COMMON_SHARE", common[0])
    monkeypatch.setattr(near_join, "COMMON_LEAST", common[1])
    rows = near_rows(seed)
    found = near_join.near_join(make_docs(*rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == classes(rows)


@pytest.mark.parametrize("limit", [2, 8, 64])
def test_light_and_heavy_sets_give_the_same(make_docs, monkeypatch, limit):
    monkeypatch.setattr(near_join, "boundary", lambda sizes, percent: limit)
    rows = near_rows(7)
    found = near_join.near_join(make_docs(*rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == {d: c for d, (_, c) in classes(rows).items()}


def test_boundary_follows_the_cost():
    assert near_join.boundary([(6, 1000, 500.0)], 75) >= 6
    assert near_join.boundary([(60, 1000, 1.0)], 75) < 60


def test_near_join_of_odd_rows(make_docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (None, "one"), (None, None), (7, "a b"), (7, "c d"), (8, "c d"), (9, "b a")]
    found = sorted(near_join.near_join(make_docs(*rows)).collect(), key=str)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in found}
    assert len(found) == len(rows)
    assert got >= {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, None), (None, 0, None), (9, 1, 9)}
    assert near_join.near_join(make_docs()).collect() == []


def test_without_copies(make_docs):
    text = " ".join(words(50, 4))
    docs = make_docs((5, text), (3, text + " more"), (4, "other"), (None, text), (6, None))
    kept = near_join.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, text), (3, text + " more"), (4, "other"), (6, "")])


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(1, i) for i in range(2, 30)] + [(2, 3), (7, 7)]
    edges = spark.createDataFrame(chain + star, "a bigint, b bigint")
    roots = {r.node: r.root for r in components(edges).collect() if r.node != r.root}
    assert roots == {i: 100 for i in range(101, 141)} | {i: 1 for i in range(2, 30)}
    assert components(edges.limit(0)).collect() == []


# --- suffix de-duplication ---------------------------------------------------


def removed(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (40, 99, 100, 101, 120, 171, 172, 173, 300, 900)]
    rows = [text(rng.randrange(60)) + rng.choice(passages)[rng.randrange(30) :] + text(rng.randrange(200)) for _ in range(150)]
    rows += ["a" * 350, "ab" * 200, "x" * 99, "x" * 100, "x" * 100, "", None, text(2000)]
    rows += [rows[3], rows[3], rows[-1], passages[8] * 3, "y" + passages[8][7:290] + "z"]
    rng.shuffle(rows)
    return list(enumerate(rows, -5))


@pytest.mark.parametrize("block,samples,pairs", [(3_000_000, 2_000_000, 12), (2_000, 700, 12), (2_000, 700, 2)])
def test_repeats_equal_brute_force(make_docs, monkeypatch, block, samples, pairs):
    monkeypatch.setattr(suffix_dedup, "BUCKET_SAMPLES", samples)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "PAIRS", pairs)
    rows = repeat_rows()
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(make_docs(*rows)).collect()}
    assert found == removed(rows)


def ruled_rows():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    near = [text(50) for _ in range(6)]
    rows = [text(rng.randrange(90)) + rng.choice(near)[rng.randrange(20) :] + "-" * 60 + rng.choice(near)[: rng.randrange(51)] + text(80) for _ in range(120)]
    return list(enumerate(rows + ["=" * 400, rows[0], rows[1]], 3))


@pytest.mark.parametrize("samples", [100, 10**6])
def test_heads_of_rule_lines_are_dealt_out(make_docs, monkeypatch, samples):
    monkeypatch.setattr(suffix_dedup, "BUCKET_SAMPLES", samples)
    monkeypatch.setattr(suffix_dedup, "WIDE_LEAST", 20)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    kept = {}
    monkeypatch.setattr(suffix_dedup, "stored", lambda frame, name, *a, f=suffix_dedup.stored: kept.setdefault(name, f(frame, name, *a)))
    rows = ruled_rows()
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(make_docs(*rows)).collect()}
    assert found == removed(rows) and sum(n for _, n, _, _ in found.values()) > 500
    heads = kept["repeat-samples"].filter("head <> 0").groupBy("head").count().collect()
    assert {r.head for r in heads if r["count"] > 20} == {r.head for r in kept["repeat-wide-heads"].collect()} != set()
    assert (min(r.head for r in heads) < 0) == (samples == 100)
    assert kept["repeat-wide-edges"].count() > 0


def test_samples_of_one_head_go_to_many_buckets():
    frame = pd.DataFrame(ruled_rows(), columns=["doc_id", "text"])
    dashes = suffix_dedup._Hashes(np.frombuffer(b"-" * 28, np.uint8)).of(np.array([0]), np.array([28]))
    samples = lambda wide: {r.bucket: len(r.heads) // 4 for f in suffix_dedup._ranked([frame], 8, wide) for r in f.itertuples()}
    together, dealt = samples(np.zeros(0, np.uint64)), samples(dashes)
    assert max(together.values()) > 250 and len([b for b in dealt if b >= 8]) == 8
    assert max(n for b, n in dealt.items() if b >= 8) < 120 and sum(dealt.values()) == sum(together.values())


def test_cover_meets_every_difference():
    cover = suffix_dedup.COVER
    differences = {(a - b) % suffix_dedup.PERIOD for a in cover for b in cover}
    assert differences == set(range(suffix_dedup.PERIOD))


def test_repeats_of_odd_rows(make_docs):
    long = "q" * 99 + "r" * 99
    found = suffix_dedup.remove_repeats(make_docs((None, long), (2, long), (None, long), (3, None))).collect()
    assert sorted((r.doc_id or 0, r.n_removed, bytes(r.kept)) for r in found) == [(0, 0, long.encode())] * 2 + [(2, 0, long.encode()), (3, 0, b"")]
    assert suffix_dedup.digests(make_docs()).collect() == []


# --- decontamination -----------------------------------------------------------


def test_items_in_documents_equal_brute_force(spark, make_docs):
    rng = random.Random(8)
    items = [(i, " ".join(words(n, 90 + i, 300))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 12, 13, 30, 40, 80, 200])]
    docs = []
    for i in range(80):
        w = words(rng.randrange(300), i, 300)
        if i % 3:
            part = rng.choice(items)[1].split()
            cut = changed(part, {rng.randrange(len(part))}) if rng.random() < 0.4 else part[rng.randrange(1 + len(part) // 3) :]
            at = rng.randrange(len(w) + 1)
            w[at:at] = cut
        docs.append((i, " ".join(w).title()))
    table = spark.createDataFrame(items + [(99, ""), (98, None), (None, "a b c d e f")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in contamination.find_items(make_docs(*docs), table).collect()}
    expected = {}
    for d, t in docs:
        w = t.lower().split()
        for i, text in items:
            own = text.lower().split()
            k = min(5, len(own))
            wanted = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)}
            have = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if 100 * len(wanted & have) >= 75 * len(wanted):
                expected[d, i] = (len(wanted), len(wanted & have))
    assert found == expected and len(expected) > 50


def test_decontamination_of_odd_rows(spark, make_docs):
    items = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "Zz")], "item_id bigint, text string")
    docs = make_docs((1, None), (2, ""), (None, "a b c d e f g"), (4, "x A b\nc d e f g y"), (5, "zz zz"), (5, "zz"), (6, "zzz"))
    found = sorted((r.doc_id, r.item_id, r.n_shared) for r in contamination.find_items(docs, items).collect())
    assert found == [(4, 1, 3), (5, 2, 1)]
    kept = contamination.without_items(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "6", "None"]
    assert contamination.find_items(docs, items.limit(0)).collect() == []
    assert contamination.find_items(make_docs(), items).collect() == []
    assert contamination.without_items(docs, items.limit(0)).count() == 7


def test_tasks_give_memory_back():
    """A worker that a task has filled is small again once the task has ended."""
    import psutil

    def task():
        held = [bytes(20_000) for _ in range(10_000)]  # below the size that goes back by itself
        kept = [held[-1], bytes(20_000)]  # the end of the heap stays in use
        del held
        yield kept

    at = psutil.Process()
    before = at.memory_info().rss
    (kept,) = tables.tidied(task())
    assert kept and at.memory_info().rss < before + 60e6


def test_shingles_of_many_texts_equal_those_of_each():
    """Words are hashed over texts together; sets equal those of plain words, wherever a text lies."""
    rng = random.Random(5)
    parts = ["a", "A", "b", "abcdefgh", "abcdefghi", "abcdefgh" * 3, "é", "\x00", "\x00\x00", "\x85", "\x1c", "x" * 128, "x" * 129, "x" * 130]
    spaces = [" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r\n"]
    odd = ["".join(rng.choice(parts) + rng.choice(spaces) for _ in range(rng.randrange(40))) for _ in range(300)]
    odd += ["", None, " \n ", "one two three four five", "ONE two\tthree four five", "onet wo three four five"]
    found = [tuple(s.tolist()) for s in shingle_sets(odd)]
    assert found == [tuple(next(shingle_sets([t])).tolist()) for t in odd]
    assert [len(s) for s in found] == [len(shingles(t or "")) for t in odd] and all(list(s) == sorted(set(s)) for s in found)
    by_hash = {}
    for text, own in zip(odd, found):
        assert by_hash.setdefault(own, shingles(text or "")) == shingles(text or "")
    assert len({frozenset(shingles(t or "")) for t in odd}) == len(by_hash)


def test_shingles_come_without_a_step_a_word():
    """A word costs no call of its own: hashing takes a small part of the time of plain words."""
    texts = [" ".join(f"w{(i * 7919 + j) % 400_000}" for j in range(500)) for i in range(400)]
    hashes, began = WordHashes(), time.perf_counter()
    for t in texts:
        np.fromiter(map(hashes.__getitem__, t.encode().lower().split()), np.uint64)
    plain, began = time.perf_counter() - began, time.perf_counter()
    assert sum(map(len, shingle_sets(texts))) > 0 and time.perf_counter() - began < plain
