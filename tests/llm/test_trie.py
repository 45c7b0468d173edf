"""The prefix trie against plain dictionaries."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from ticklane.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
ROW = "conv_id bigint, turn bigint, role string, text string, depth string, parent int, key string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    members, children, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == p)))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], ROW)
    return sorted(map(tuple, prefix_trie.trie(frame, **options).select(COLUMNS).collect()), key=repr)


def made(seed, convs, turns=6, long=None):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(long if long and c % 40 == 20 else rng.randrange(1, turns)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"t{rng.randrange(2)} and {t}" if t < 3 else f"more {rng.randrange(3)}"))
    return rows


def test_random_conversations_equal_plain(spark, monkeypatch):
    """A list longer than what is walked, and slices that part paths, children and positions."""
    monkeypatch.setattr(prefix_trie, "SLICE", 8)
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    rows = made(5, 120, long=30)
    assert found(spark, rows, walked=10) == plain(rows)


def test_odd_rows(spark):
    """Null ids, turns, roles and texts; ties; repeated rows; negative ids; absent bases; turnless results."""
    rows = [
        (None, 0, "user", "lost"), (0, None, None, "first of all"), (0, 1, "user", None), (0, 1, "user", None), (0, 1, "a", "tie"),
        (1, 5, "user", "b"), (1, 5, "user", "a"), (-3, 0, "user", "x y"), (-23, 0, "user", "x y"), (-20, 2, None, "  z\x0b\n"),
        *[(c, 0, "user", "alone") for c in range(40, 60)], *[(c, 0, "user", "base is absent") for c in range(101, 120)],
    ]
    assert found(spark, rows) == plain(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in plain(rows))


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(7, 1, "user", "x")]])
def test_no_or_one_conversation(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_many_equal_conversations_and_a_wide_root(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = [(20 * c, t, "user", f"same {t}") for c in range(60) for t in range(2)] + [(20 * c, 0, "user", f"own {c}") for c in range(60, 100)]
    assert found(spark, rows, walked=20) == plain(rows)
