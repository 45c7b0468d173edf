"""Token counts of byte-level BPE vocabularies, huge documents by overlapping chunks.

The tokenizer first splits a text by a pattern into pieces, and no token crosses a piece.
A chunk is encoded on its own, with the offsets of its pieces and the tokens before each.
Chunk k+1 starts at an arbitrary place, so its first pieces may be cut wrongly; the splice
with chunk k is the first offset in their overlap at which both start a piece, and which is
so far from the end of chunk k that the cut-off text cannot have changed it. From a place
where a piece starts, the pattern sees the same text in both, so from there on chunk k+1 is
cut as the whole text is. Without such an offset the overlap doubles, up to the text's end.

Memory: one chunk's offsets besides the text. Counts of pieces seen before are kept.
"""

from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from ticklane.llm.bpe import SPACE
from ticklane.llm.tables import texts

#: Code points of a chunk and of the first overlap tried.
CHUNK, OVERLAP = 65_536, 256
_PIECE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Pieces whose count is kept by a task, each of at most LONG code points.
_KEPT, _LONG = 400_000, 64


class Counter:
    """Counts tokens with one vocabulary file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[str, int] = {}

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces)
        merged = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
        counts = np.bincount(np.array(merged.word_ids, np.int64), minlength=len(new))
        self.known.update(zip(new, counts.tolist()))

    def counts(self, pieces: list[str]) -> list[int]:
        if len(self.known) > _KEPT:
            self.known = {}
        new = {p for p in pieces if p not in self.known}
        if new:
            self.learn(new)
        found = list(map(self.known.__getitem__, pieces))
        for p in new:
            if len(p) > _LONG:
                del self.known[p]
        return found

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Offsets at which pieces start, and the number of tokens before each."""
        pieces = _PIECE.findall(text)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return starts[:-1], np.concatenate([[0], np.cumsum(self.counts(pieces))])

    def segment(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        if len(text) <= self.chunk:
            return sum(self.counts(_PIECE.findall(text)))
        total, base = 0, 0  # tokens before `begin`, a true piece start; where the chunk starts
        begin = 0
        while True:
            end, overlap = base + self.chunk, self.overlap
            while True:
                stop = min(end + overlap, len(text))
                starts, before = self.encode(text[base:stop])
                at = int(np.searchsorted(starts, begin - base))
                if stop == len(text):
                    return total + int(before[-1] - before[at])
                right, _ = self.encode(text[end:stop])
                # the last piece but one and what follows may depend on text cut off
                common = np.intersect1d(starts[:-2] + base, right[:-2] + end)
                if len(common):
                    break
                overlap *= 2
            splice = int(common[0])
            total += int(before[int(np.searchsorted(starts, splice - base))] - before[at])
            base, begin = end, splice

    def count(self, text: str) -> int:
        """Tokens of a text; each special token's string counts as one, as in the library."""
        parts = [text]
        for content in self.special:
            if content in text:
                parts = [q for p in parts for q in p.split(content)]
        return sum(map(self.segment, parts)) + len(parts) - 1


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of a file; one per Python worker, which tasks use in turn."""
    return Counter(path)


def _counted(frames, path: str):
    own = counter(path)
    for frame in frames:
        out = frame[["doc_id"]].astype("Int64")
        out["n_bytes"] = [len(t.encode("utf-8")) for t in frame.text]
        out["n_tokens"] = [own.count(t) for t in frame.text]
        yield out


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row, of whole texts.

    A null text is empty: 0 and 0. Rows stay as they are, also repeated ones and those with
    a null doc_id; other columns go. Every executor needs the vocabulary file at path.
    """
    return texts(docs).mapInPandas(lambda f: _counted(f, path), "doc_id long, n_bytes long, n_tokens long")
