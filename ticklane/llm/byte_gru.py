"""Language of a text by a bidirectional gated recurrent network over its UTF-8 bytes.

A text is cut into windows of at most 256 bytes. In each a recurrent unit reads forwards and
another one backwards; at every byte both states together give probabilities of the
languages, and those of a document are the means over all its bytes. Weights are fitted on
the driver by backpropagation through time with Adam steps, over short windows of a bounded
sample of labelled documents. A step of many windows is a handful of array operations.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.tables import ship, sized, stored, texts

#: Bytes of a window and windows that are read at a time.
WINDOW, AT_ONCE = 256, 1_024
HIDDEN = 8
#: Labelled documents and their windows that are learned from, in the mean.
TRAIN_ROWS, TRAIN_WINDOWS, TRAIN_BYTES = 2_000, 6, 64
EPOCHS, BATCH, RATE = 4, 256, 0.02
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def new_unit(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
    """Weights of one direction: bytes to gates (update, reset, new), states to gates."""
    return {
        "x": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
        "h": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32),
        "b": np.zeros(3 * hidden, np.float32),
    }


def step(unit: dict, rows: np.ndarray, state: np.ndarray):
    """One byte of each window: h' = (1 - z) n + z h, n = tanh(x + r (h U)). Gates are returned too."""
    k = state.shape[1]
    x = unit["x"][rows] + unit["b"]
    u = state @ unit["h"]
    gates = _sigmoid(x[:, : 2 * k] + u[:, : 2 * k])
    z, r = gates[:, :k], gates[:, k:]
    new = np.tanh(x[:, 2 * k :] + r * u[:, 2 * k :])
    return new + z * (state - new), z, r, new, u[:, 2 * k :]


def unit_gradient(unit: dict, rows: np.ndarray, kept: list, d_states: np.ndarray, inside: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of a direction by backpropagation through time.

    rows, d_states, inside: bytes, gradients of the states and whether there is a byte, step by
    step in reading order; without a byte the state is 0. kept: per step the state before it
    and what step() returned.
    """
    k = d_states.shape[2]
    out = {name: np.zeros_like(w) for name, w in unit.items()}
    back = np.zeros(d_states.shape[1:], np.float32)
    for t in range(len(rows) - 1, -1, -1):
        before, (_, z, r, new, u) = kept[t]
        d = (d_states[t] + back) * inside[t][:, None]
        d_new = d * (1 - z) * (1 - new * new)
        d_gates = np.hstack([d * (before - new) * z * (1 - z), d_new * u * r * (1 - r), d_new])
        d_u = d_gates.copy()
        d_u[:, 2 * k :] = d_new * r
        np.add.at(out["x"], rows[t], d_gates)
        out["b"] += d_gates.sum(axis=0)
        out["h"] += before.T @ d_u
        back = d * z + d_u @ unit["h"].T
    return out


@dataclass
class Network:
    """Weights of both directions and of the output layer; languages in the order of its columns."""

    languages: list[str]
    forward: dict[str, np.ndarray]
    backward: dict[str, np.ndarray]
    out: dict[str, np.ndarray]

    def gradient(self, windows: np.ndarray, sizes: np.ndarray, y: np.ndarray):
        """(loss, gradients) of the mean cross-entropy over all bytes. windows: rows of bytes, 0 beyond sizes."""
        n, length, k = len(windows), windows.shape[1], self.out["w"].shape[0] // 2
        rows, inside = windows.T, (np.arange(length)[:, None] < sizes).astype(np.float32)
        states = np.zeros((2, length, n, k), np.float32)
        kept: list[list] = [[], []]
        for way, unit in enumerate((self.forward, self.backward)):
            h = np.zeros((n, k), np.float32)
            for t in range(length) if way == 0 else range(length - 1, -1, -1):
                made = step(unit, rows[t], h)
                kept[way].append((h, made))
                h = made[0] * inside[t][:, None]
                states[way, t] = h
        both = np.concatenate([states[0], states[1]], axis=2)
        p = _softmax(both @ self.out["w"] + self.out["b"])
        weight = (inside / max(inside.sum(), 1.0))[:, :, None]
        loss = float(-(np.log(p[:, np.arange(n), y] + 1e-9) * weight[:, :, 0]).sum())
        d = p.copy()
        d[:, np.arange(n), y] -= 1
        d *= weight
        d_both = d @ self.out["w"].T * inside[:, :, None]
        flat = both.reshape(-1, 2 * k)
        gradients = {"out": {"w": flat.T @ d.reshape(len(flat), -1), "b": d.sum(axis=(0, 1))}}
        gradients["forward"] = unit_gradient(self.forward, rows, kept[0], d_both[:, :, :k], inside)
        gradients["backward"] = unit_gradient(self.backward, rows[::-1], kept[1], d_both[::-1, :, k:], inside[::-1])
        return loss, gradients

    def summed(self, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probabilities of each language summed over the bytes of each window; sizes must fall."""
        k, w, b = self.out["w"].shape[0] // 2, self.out["w"], self.out["b"]
        length = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(length), side="left")  # windows with a byte at t
        rows, h = windows.T, np.zeros((len(windows), k), np.float32)
        seen = np.empty((length, len(windows), w.shape[1]), np.float32)
        for t in range(length):
            m = active[t]
            h[:m] = step(self.forward, rows[t, :m], h[:m])[0]
            seen[t, :m] = h[:m] @ w[:k]
        total, h = np.zeros((len(windows), w.shape[1]), np.float64), np.zeros_like(h)
        for t in range(length - 1, -1, -1):
            m = active[t]
            h[:m] = step(self.backward, rows[t, :m], h[:m])[0]
            total[:m] += _softmax(seen[t, :m] + h[:m] @ w[k:] + b)
        return total


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(windows: list[bytes], y: list[int], languages: list[str], hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """A network from labelled windows (at most TRAIN_BYTES each); languages weigh the same."""
    rng = np.random.default_rng(7)
    net = Network(
        languages, new_unit(rng, hidden), new_unit(rng, hidden),
        {"w": rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32), "b": np.zeros(len(languages), np.float32)},
    )
    if len(languages) < 2 or not windows:
        return net
    sizes, y = np.array([len(x) for x in windows]), np.array(y)
    data = np.zeros((len(windows), sizes.max()), np.uint8)
    for i, x in enumerate(windows):
        data[i, : len(x)] = np.frombuffer(x, np.uint8)
    # An epoch draws as many windows as there are, each language as often as the others.
    chance = 1.0 / np.bincount(y, minlength=len(languages))[y]
    chance /= chance.sum()
    parts = [net.forward, net.backward, net.out]
    moments = [({k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}) for p in parts]
    at, steps = 0, max(1, epochs * -(-len(windows) // BATCH))
    for at in range(1, steps + 1):
        pick = rng.choice(len(windows), min(BATCH, len(windows)), p=chance)
        _, found = net.gradient(data[pick, : sizes[pick].max()], sizes[pick], y[pick])
        rate = RATE * (1 - at / (steps + 1))
        for part, (m, v), g in zip(parts, moments, (found["forward"], found["backward"], found["out"])):
            for name in part:
                m[name] += 0.1 * (g[name] - m[name])
                v[name] += 0.01 * (g[name] ** 2 - v[name])
                part[name] -= (rate * (m[name] / (1 - 0.9**at)) / (np.sqrt(v[name] / (1 - 0.99**at)) + 1e-6)).astype(np.float32)
    return net


def train(docs: DataFrame, column: str = "lang", rows: int = TRAIN_ROWS) -> Network:
    """A network for the values of a column, from about `rows` documents in which it isn't null.

    As many documents of each value are wanted, chosen by a hash of doc_id, and of each
    TRAIN_WINDOWS windows spread evenly over the text. Texts without a letter are left out. Without
    any labelled text the network has no language; with one, it always answers that.
    """
    labelled = docs.filter((F.col(column) != UNKNOWN) & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy(F.col(column).alias("lang")).count().collect()}
    wanted = rows / max(len(counts), 1)
    chosen = labelled.select("doc_id", "text", F.col(column).alias("lang"))
    shares = stored(docs.sparkSession.createDataFrame([(k, min(1.0, wanted / n)) for k, n in counts.items()], "lang string, part double"), "gru-shares")
    chosen = chosen.join(sized(shares), "lang").filter(F.pmod(F.xxhash64(F.lit(78), "doc_id"), F.lit(1_000_003)) <= F.col("part") * 1_000_003)
    # Windows leave the executors, whole texts do not.
    raw = F.encode("text", "UTF-8")
    gap = F.greatest(F.floor((F.octet_length("text") - TRAIN_BYTES) / (TRAIN_WINDOWS - 1)), F.lit(0))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)), lambda i: (i * gap + 1).cast("int")))
    cut = chosen.select("lang", "doc_id", F.explode(F.transform(starts, lambda s: F.substring(raw, s, F.lit(TRAIN_BYTES)))).alias("bytes"))
    found = cut.orderBy("doc_id", "lang", "bytes").toPandas()
    languages = sorted(counts)
    number = {name: i for i, name in enumerate(languages)}
    return fit([bytes(x) for x in found["bytes"]], [number[x] for x in found["lang"]], languages)


def _sums(net: Network, encoded: list[bytes]) -> np.ndarray:
    """Per text, the probabilities summed over its bytes; windows of all texts are read together."""
    at = np.cumsum([0, *(-(-len(x) // WINDOW) for x in encoded)])
    owner = np.repeat(np.arange(len(encoded)), np.diff(at))
    total = np.zeros((len(encoded), len(net.languages)))
    whole = np.frombuffer(b"".join(encoded), np.uint8)
    first = np.cumsum([0, *map(len, encoded)])
    begins = first[owner] + (np.arange(len(owner)) - at[owner]) * WINDOW
    sizes = np.minimum(first[owner + 1] - begins, WINDOW)
    order = np.argsort(-sizes, kind="stable")
    for i in range(0, len(order), AT_ONCE):
        some = order[i : i + AT_ONCE]
        length = int(sizes[some[0]])
        places = np.minimum(begins[some][:, None] + np.arange(length), len(whole) - 1)
        np.add.at(total, owner[some], net.summed(whole[places], sizes[some]))
    return total


def _groups(column, limit: int):
    """Places and bytes of the texts with a letter, so many bytes (or one text) at a time."""
    places, encoded, size = [], [], 0
    for i, text in enumerate(column):
        text = text.as_py()
        if _LETTER.search(text):
            places.append(i)
            encoded.append(text.encode("utf-8", "surrogatepass"))
            size += len(encoded[-1])
        if size >= limit:
            yield places, encoded
            places, encoded, size = [], [], 0
    if places:
        yield places, encoded


def _predicted(batches, net: Network):
    for batch in batches:
        names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
        for places, encoded in _groups(batch.column("text"), AT_ONCE * WINDOW * 4) if net.languages else ():
            sums = _sums(net, encoded)
            for i, row, raw in zip(places, sums, encoded):
                names[i], scores[i] = net.languages[int(row.argmax())], min(1.0, row.max() / len(raw))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang_pred, score) for each row; every byte of a text counts.

    score is the mean probability of the language that has the highest. A text that is null or has
    no letter is `und`, with score 0; so is every text if nothing was learned. Rows are kept
    as they are, also repeated ones and those with a null doc_id. Other columns go.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    return texts(docs).mapInArrow(lambda b: _predicted(b, sent.value), "doc_id long, lang_pred string, score double")
