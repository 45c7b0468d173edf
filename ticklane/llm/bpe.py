"""BPE encoding and decoding with forced boundaries.

A word of the tokenizer is first cut wherever two neighbouring symbols occur side by side
in no token of the vocabulary: no merge can ever join them, so the cut is certain. The
fragments are encoded on their own and the results are concatenated. Short fragments recur
across words, so that few of them are ever merged anew.

This is for vocabularies with word ends (a suffix on a word's last symbol), lower case and
white space dropped, and gives the ids of the tokenizers library for such a file.
"""

import hashlib
import json
import re
import struct
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE

from ticklane.llm.tables import texts, tidied

#: Words of the tokenizer: contractions, letters, single digits, other runs.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = regex.compile(rf"\p{{L}}+|'s|'t|'re|'ve|'m|'ll|'d|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Words whose encoding is kept by a task.
_KEPT = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file.

    Inside, a symbol is one character: the byte's value, or 256 more for the last byte of a
    word. So the word end needs no suffix, and a fragment from any place in a word can be
    merged on its own. Merging itself is the tokenizers library's.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.byte = {ord(c): b for b, c in enumerate(byte_symbols())}
        vocab = {self.inner(token): i for token, i in model["vocab"].items() if not self.special_like(token, spec)}
        merges = [(self.inner(a), self.inner(b)) for a, b in model["merges"]]
        self.merger = Tokenizer(BPE(vocab, merges))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.tokens) + 1)]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.joined = {token[i : i + 2] for token in vocab for i in range(len(token) - 1)}
        self.fragments: dict[str, bytes] = {}
        self.ids: dict[str, bytes] = {}

    @staticmethod
    def special_like(token: str, spec: dict) -> bool:
        return any(token == t["content"] for t in spec["added_tokens"])

    def inner(self, token: str) -> str:
        """A vocabulary entry in one character a symbol."""
        ends = token.endswith(self.end) and token != self.end
        chars = [chr(self.byte[ord(c)]) for c in (token[: -len(self.end)] if ends else token)]
        return "".join(chars[:-1]) + chr(ord(chars[-1]) + 256) if ends else "".join(chars)

    def boundaries(self, word: str) -> list[str]:
        """The symbols of a word, cut where no token holds both neighbours side by side."""
        joined = self.joined
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def learn(self, words: set[str]) -> None:
        """Encodes words that have not been seen: all their new fragments in one call."""
        parts = {}
        for w in words:
            inner = w.encode("utf-8").decode("latin-1")
            parts[w] = self.boundaries(inner[:-1] + chr(ord(inner[-1]) + 256))
        new = list({p for own in parts.values() for p in own if p not in self.fragments})
        if new:
            merged = self.merger.encode(new, is_pretokenized=True, add_special_tokens=False)
            ids = [[] for _ in new]
            for at, i in zip(merged.word_ids, merged.ids):
                ids[at].append(self.packed[i])
            self.fragments.update(zip(new, map(b"".join, ids)))
        for w, own in parts.items():  # a word of one fragment shares its bytes
            self.ids[w] = b"".join(map(self.fragments.__getitem__, own)) if len(own) > 1 else self.fragments[own[0]]

    def words(self, text: str) -> list[str]:
        """Words of a text, special tokens standing for themselves."""
        if "<" in text and self.cut.search(text):
            return [w for piece in self.cut.split(text) for w in ([piece] if piece in self.special else self.words(piece))]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return _WORD.findall(text.lower())

    def decoded(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Per text its ids as little-endian 32-bit integers, and what they decode to."""
        if len(self.ids) >= _KEPT:
            self.forget()
        for content, i in self.special.items():
            self.ids[content] = self.packed[i]
        found = [self.words(t) for t in texts]
        self.learn({w for own in found for w in own if w not in self.ids})
        joined = [b"".join(map(self.ids.__getitem__, own)) for own in found]
        return [(ids, self.decoded(ids)) for ids in joined]

    def forget(self) -> None:
        """Lets go of the words and fragments seen so far."""
        self.ids.clear()
        self.fragments.clear()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a file; one per Python worker, which tasks use in turn."""
    return Codec(path)


def _parts(batches):
    """(doc_ids, texts) with about 100,000 characters of text each, so that few words are held."""
    for batch in batches:
        doc_ids, found = batch.column("doc_id"), batch.column("text").to_pylist()
        low = held = 0
        for at, text in enumerate(found, 1):
            held += len(text)
            if held >= 100_000 or at == len(found):
                yield doc_ids.slice(low, at - low), found[low:at]
                low, held = at, 0


def _encoded(batches, path: str):
    own = codec(path)
    for doc_ids, found in _parts(batches):
        ids, decoded = zip(*own.encode(found))
        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary, decoded string) for each row, of whole texts.

    ids are little-endian unsigned 32-bit integers. A null text is empty and has no ids.
    Rows stay as they are, also repeated ones and those with a null doc_id; other columns go.
    Every executor needs the vocabulary file at path.
    """
    return texts(docs).mapInArrow(lambda b: tidied(_encoded(b, path)), "doc_id long, ids binary, decoded string")


def _digested(batches, path: str):
    own = codec(path)
    for doc_ids, found in _parts(batches):
        rows = [(len(a) // 4, hashlib.sha256(a).hexdigest(), hashlib.sha256(b.encode("utf-8")).hexdigest()) for a, b in own.encode(found)]
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([doc_ids, *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() in short, without moving the ids."""
    return texts(docs).mapInArrow(lambda b: tidied(_digested(b, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
