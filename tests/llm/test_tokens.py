"""Token codecs and counts against the tokenizers library."""

import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from made import make_docs  # noqa: F401
from ticklane.llm import bpe, token_counts

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PARTS = [
    *"abcdeéÉßİΣΑΩς中文字!?'\"<|>_  \n\t\x1c\x85\xa0０１２½²😀👍🏽", "́", "̸", "<|endoftext|>", "<|startoftext|>",
    "don't", "\r\n", "   ", "The Cat's ", "naïve ", "12345", "--==##",
]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(80))) for _ in range(400)]
    return [*made, "", "a" * 4000, "the" * 2000, "!" * 900, " " * 3000, "x " * 3000]


def test_codec_equals_library(odd_texts):
    library, own = Tokenizer.from_file(WORDS), bpe.Codec(WORDS)
    for text, (ids, decoded) in zip(odd_texts, own.encode(odd_texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == b"".join(i.to_bytes(4, "little") for i in expected), text
        assert decoded == library.decode(expected, skip_special_tokens=False)


def test_cuts_are_forced():
    """No token of the vocabulary holds both sides of a cut, and pieces make up the word."""
    own = bpe.Codec(WORDS)
    word = "qzxjé中kvqx"
    inner = word.encode().decode("latin-1")
    parts = own.boundaries(inner)
    assert "".join(parts) == inner and len(parts) > 1
    for a, b in zip(parts, parts[1:]):
        assert a[-1] + b[0] not in own.joined


@pytest.mark.parametrize("chunk,overlap", [(65_536, 256), (37, 4), (200, 1)])
def test_counts_equal_library(odd_texts, chunk, overlap):
    library, own = Tokenizer.from_file(BYTES), token_counts.Counter(BYTES, chunk, overlap)
    for text in odd_texts:
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "_KEPT", 3)
    monkeypatch.setattr(token_counts, "_KEPT", 3)
    own, counter = bpe.Codec(WORDS), token_counts.Counter(BYTES)
    texts = ["one two three four", "five six seven eight nine", "one two"]
    assert [own.encode([t])[0] for t in texts] == bpe.Codec(WORDS).encode(texts)
    assert [counter.count(t) for t in texts] == [4, 5, 2] and len(own.ids) < 12


def test_kept_words_are_small():
    """A word that is kept costs its text and its ids, no more."""
    own = bpe.Codec(WORDS)
    words = [f"{a}{b}{c}" for a in "bcdfghklmn" for b in "aeiouy" for c in ("nder", "lling", "stone", "xqzj", "9")]
    tracemalloc.start()
    own.encode([" ".join(w + v for v in words) for w in words[:60]])
    held = tracemalloc.get_traced_memory()[0] / len(own.ids)
    tracemalloc.stop()
    assert len(own.ids) > 10_000 and held < 320
    own.forget()
    assert not own.ids and not own.fragments


def test_rows(make_docs):
    docs = make_docs((3, "Hello  World"), (3, "Hello  World"), (None, "a"), (4, None), (5, ""))
    rows = bpe.encode(docs, WORDS).collect()
    assert len(rows) == 5 and {bytes(r.ids) for r in rows if r.doc_id in (4, 5)} == {b""}
    short = {str(r.doc_id): r for r in bpe.digests(docs, WORDS).collect()}
    (whole,) = {(len(r.ids) // 4, hashlib.sha256(r.ids).hexdigest()) for r in rows if r.doc_id == 3}
    assert (short["3"].n_tokens, short["3"].ids_sha256) == whole
    assert next(r.decoded for r in rows if r.doc_id == 3) == "hello</w> world</w>"
    counts = token_counts.token_counts(docs, BYTES).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counts) == [
        ("3", 12, 3), ("3", 12, 3), ("4", 0, 0), ("5", 0, 0), ("None", 1, 1),
    ]
    for made in (bpe.encode(make_docs(), WORDS), bpe.digests(make_docs(), WORDS), token_counts.token_counts(make_docs(), BYTES)):
        assert made.collect() == []
