"""Line quality: a linear-chain conditional random field marks lines as content or boilerplate.

A text's lines with at least one word are a sequence. Each line has binary features of its
shape and of repetition within the text; the field scores features per state and pairs of
neighbouring states, and Viterbi decoding finds the best marking. A document is kept if
content lines hold at least `share` of its words.

The field is trained on a bounded sample of documents with a quality label: lines of a
low-quality document are boilerplate, lines of another are content unless they repeat an
earlier line. Training maximises the conditional likelihood (forward-backward).
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ticklane.llm.shingles import WordHashes, mixed
from ticklane.llm.tables import share as share_of
from ticklane.llm.tables import sized, stored, texts

#: Bounds of training: documents, and lines of one training sequence (longer ones are cut up).
TRAIN_ROWS, TRAIN_LINES = 4_000, 64
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
FEATURES = 16
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_ODD = mixed(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def repeated(words: list[bytes], hashes: WordHashes) -> int:
    """Words that lie in a window of 8 words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    window = h[:n] * _ODD[0]
    for i in range(1, WINDOW):
        window = window + h[i : n + i] * _ODD[i]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def features(lines: list[bytes]) -> tuple[np.ndarray, list[int], list[bool]]:
    """Per line its features, number of words, and whether it equals an earlier line.

    Lines without words must be left out before.
    """
    seen: set[bytes] = set()
    x, sizes, again = np.zeros((len(lines), FEATURES), np.float32), [], []
    for i, line in enumerate(lines):
        words = line.split()
        n, size = len(words), len(line)
        symbols = size - len(line.translate(None, SYMBOLS))
        upper = size - len(line.translate(None, _UPPER))
        lower = size - len(line.translate(None, _LOWER))
        digits = size - len(line.translate(None, b"0123456789"))
        distinct = len(set(words))
        old = line in seen
        seen.add(line)
        x[i] = (
            1, n < 3, n < 6, n > 20, line.rstrip()[-1:] in b".!?", symbols > 0, symbols * 20 > size, symbols > n // 2,
            upper > 2 * lower, digits * 5 > size, old, n > 8 and distinct * 2 < n, line.count(b"|") * 4 > n,
            line.count(b"!") * 4 > n, size > 14 * n, i == 0,
        )
        sizes.append(n)
        again.append(old)
    return x, sizes, again


def viterbi(emission: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best states of a sequence. emission: lines by 2; trans[from, to]. Ties go to state 1."""
    back, best = np.zeros((len(emission), 2), np.int8), emission[0]
    for t in range(1, len(emission)):
        scores = best[:, None] + trans
        back[t] = scores[1] >= scores[0]
        best = np.where(back[t] == 1, scores[1], scores[0]) + emission[t]
    states = np.zeros(len(emission), np.int8)
    states[-1] = best[1] >= best[0]
    for t in range(len(emission) - 1, 0, -1):
        states[t - 1] = back[t, states[t]]
    return states


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """(weights of state 1, trans[2, 2]) from sequences of (features, states)."""
    if not sequences:
        return np.zeros(FEATURES), np.zeros((2, 2))
    n, longest = len(sequences), max(len(x) for x, _ in sequences)
    x, y, mask = np.zeros((n, longest, FEATURES), np.float32), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (a, b) in enumerate(sequences):
        x[i, : len(a)], y[i, : len(b)], mask[i, : len(a)] = a, b, True
    pair = mask[:, 1:]
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    lines = mask.sum()
    w, trans = np.zeros(FEATURES), np.zeros((2, 2))
    first, second = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for step in range(1, steps + 1):
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = x @ w.astype(np.float32)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = _logsum(forward[:, t - 1][:, :, None] + trans, 1) + e[:, t]
            forward[:, t] = np.where(mask[:, t][:, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _logsum(trans + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1][:, None], new, 0.0)
        z = _logsum(forward[:, -1], 1)
        p1 = np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None])
        both = forward[:, :-1, :, None] + trans + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expected = np.exp(both)[pair].sum(axis=0)
        gradient = np.concatenate([
            np.tensordot(((p1 - y) * mask).astype(np.float32), x, 2) / lines + 1e-4 * w,
            ((expected - observed) / lines + 1e-4 * trans).ravel(),
        ])
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        move = 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, trans = w - move[:FEATURES], trans - move[FEATURES:].reshape(2, 2)
    return w, trans


def _lines(text: str) -> list[bytes]:
    return [line for line in text.encode("utf-8").split(b"\n") if line.split()]


def _training(frames):
    for frame in frames:
        rows = []
        for text, quality in zip(frame.text, frame.quality):
            x, _, again = features(_lines(text))
            for start in range(0, len(x), TRAIN_LINES):
                part = slice(start, start + TRAIN_LINES)
                rows.append((x[part].astype("uint8").tobytes(), bytes(int(quality == 1 and not a) for a in again[part])))
        yield pd.DataFrame(rows, columns=["x", "y"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The field, from about `rows` labelled documents, chosen by a hash of doc_id."""
    labels = labels.select("doc_id", "quality").dropna().dropDuplicates(["doc_id"])
    sample = stored(labels.filter(share_of("doc_id", rows, labels.count())), "line-labels")
    found = texts(docs).join(sized(sample), "doc_id").mapInPandas(_training, "x binary, y binary").toPandas()
    return fit([
        (np.frombuffer(x, np.uint8).reshape(-1, FEATURES).astype(np.float32), np.frombuffer(y, np.uint8).astype(int))
        for x, y in zip(found.x, found.y) if len(y)
    ])


def _judged(frames, model, least: float):
    hashes = WordHashes()
    w, trans = model
    for frame in frames:
        rows = []
        for text in frame.text:
            raw = text.encode("utf-8")
            words = raw.split()
            n = len(words)
            x, sizes, again = features(_lines(text))
            content = 1.0
            if len(x):
                emission = np.zeros((len(x), 2))
                emission[:, 1] = x @ w
                content = float(np.dot(viterbi(emission, trans), sizes)) / n
            twice = repeated(words, hashes)
            chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r")))
            failed = n < 20 or 100 * twice > 30 * n
            rows.append((n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), sum(again), twice, failed, not failed and content >= least, content))
        out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])
        out.insert(0, "doc_id", frame.doc_id.astype("Int64").array)
        yield out


def judge(docs: DataFrame, model, share: float = 0.5) -> DataFrame:
    """(doc_id, counts ..., base_failed, kept, content_share) for each row, of whole texts.

    A null or empty text has no words and fails the base. Rows stay as they are, also
    repeated ones and those with a null doc_id; other columns go.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    return texts(docs).mapInPandas(
        lambda f: _judged(f, known.value, share),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double",
    )
