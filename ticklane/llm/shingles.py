"""Word shingles as 64-bit hashes, in tasks.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return; A-Z are lower-cased. A shingle is five words; a text with fewer words
has its whole word sequence as its one shingle, a text without words has none.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

WIDTH = 5
_WORDS_KEPT = 100_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """Word to 64-bit hash, kept for words seen before; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: Bytes of text that are hashed together, and of a word that is hashed alone.
_TOGETHER, _LONG = 200_000, 128
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of these bytes its start and its hash.

    A word is taken eight bytes at a time and mixed one to one with what came before, so
    words of one length up to eight bytes never share a hash. Long words are hashed one by one.
    """
    data = np.frombuffer(joined + bytes(8), np.uint8)
    inside = np.ones(len(data) - 6, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_IS_SPACE[data[:-8]], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, left = edges[0::2], edges[1::2] - edges[0::2]
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = mixed(left.astype(np.uint64) * _MULTIPLIERS[1])
    h = mixed(h ^ (eights[starts] & _LOW_BYTES[np.minimum(left, 8)]))
    for i in np.flatnonzero(left > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : starts[i] + left[i]])
    which, at = np.flatnonzero((left > 8) & (left <= _LONG)), 8
    while len(which):
        rest = np.minimum(left[which] - at, 8)
        h[which] = mixed(h[which] * _MULTIPLIERS[2] ^ (eights[starts[which] + at] & _LOW_BYTES[rest]))
        at += 8
        which = which[left[which] > at]
    return starts, h


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    lengths = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(lengths)
    starts, h = _word_hashes(b"\n".join(texts))
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    windows = max(0, len(h) - WIDTH + 1)
    out = h[:windows] * _MULTIPLIERS[0]
    for i in range(1, WIDTH):
        out += h[i : windows + i] * _MULTIPLIERS[i]
    out = mixed(out)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = high - low
        if not n:
            yield np.zeros(0, np.uint64)
        elif n < WIDTH:
            total = np.array([n], np.uint64)
            for x in h[low:high]:
                total = mixed(total * _MULTIPLIERS[0] + x)
            yield total
        else:
            found = np.sort(out[low : high - WIDTH + 1])
            new = np.empty(len(found), bool)
            new[0] = True
            np.not_equal(found[1:], found[:-1], out=new[1:])
            yield found if new.all() else found[new]


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingle hashes (uint64); many texts are hashed at a time."""
    part, held = [], 0
    for text in texts:
        part.append((text or "").encode("utf-8", "surrogatepass").lower())
        held += len(part[-1])
        if held >= _TOGETHER:
            yield from _sets(part)
            part, held = [], 0
    if part:
        yield from _sets(part)
