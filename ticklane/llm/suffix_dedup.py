"""Removal of repeated byte strings, by a blockwise suffix order over a difference cover.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (in a document of
smaller doc_id, or earlier in the same). The suffixes that are sorted are those at offsets
whose remainder by PERIOD is in the difference cover: for two equal strings at any offsets
there is a shift below PERIOD at which both have such a sample suffix, with HEAD equal
bytes from there on. So it is enough to sort samples, a share of len(COVER) / PERIOD.

1. Every sample gives the rank of its head and the rank of its surroundings, all the bytes
   that strings around the sample can reach, as fingerprints. Samples go to buckets by
   head, and one bucket at a time is sorted in a task; the number of buckets grows with the
   input, so the memory of a task is bounded.
2. In a bucket, samples with equal head and equal surroundings (long ties) need no bytes to
   be compared: all but the earliest are covered as far as the surroundings reach.
3. Samples with an equal head, but other surroundings, are at the edges of repeats. For
   these the surroundings themselves are fetched and compared byte by byte with those of
   every earlier sample of the same head, in buckets again.
4. Per document the covered intervals are united and the bytes removed.

Within a block of documents, samples with equal head and surroundings are sent once, so a
passage found in a third of all documents sends as many entries as there are blocks. Heads
with many different surroundings, as those in rule lines, are dealt out: in 1 by head and
surroundings (a sample of documents tells the heads, and so the places of work only), in 3 by
the strings around their samples, which equal an earlier string or not.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklane.llm.shingles import mixed
from ticklane.llm.tables import sized, stored, texts

LENGTH = 100
#: A difference cover of 73: every difference modulo 73 is one of two members, once.
PERIOD = 73
COVER = np.array([1, 2, 4, 8, 16, 32, 37, 55, 64])
HEAD = LENGTH - PERIOD + 1
BEFORE = PERIOD - 1
#: Bytes of documents in a block, and about how many samples or surroundings a bucket has.
BLOCK_BYTES, BUCKET_SAMPLES, BUCKET_EDGES = 1_000_000, 700_000, 40_000
#: Heads with more samples than this are compared by sets, not in pairs.
PAIRS = 12
#: Heads with more open samples than one in WIDE_SHARE of all are not kept together, nor those with
#: more than a task may hold: their strings are dealt out. Either way gives the same intervals.
WIDE_SHARE, WIDE_LEAST, WIDE_MOST = 100_000, 100, 20_000
#: One in so many documents is looked at for heads that fill a tenth of a bucket.
SAMPLED = 64
#: Strings of wide heads of which a task sends equal ones once.
STRINGS = 200_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse; a worker keeps them from block to block."""
    if len(_tables[0]) < n:
        for i, factor in enumerate((_BASE, _INVERSE)):
            table = np.full(max(n, BLOCK_BYTES * 5 // 4), factor, np.uint64)
            table[0] = 1
            _tables[i] = np.cumprod(table, out=table)
    return [t[:n] for t in _tables]


class _Hashes:
    """Fingerprints of any stretch of a byte string."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        own = self.sums[1:]
        own += raw
        own += np.uint64(1)
        own *= power[:-1]
        np.cumsum(own, out=own)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def sample_offsets(n: int) -> np.ndarray:
    """Sample offsets of a document of n bytes: in the cover, with a whole head after them."""
    if n < LENGTH:
        return np.zeros(0, np.int64)
    at = (np.arange(0, n - HEAD + 1, PERIOD)[:, None] + COVER).ravel()
    return at[at <= n - HEAD]


def _blocks(frames):
    """Documents in blocks of about BLOCK_BYTES, as lists of (doc_id, bytes)."""
    block, size = [], 0
    for frame in frames:
        for doc_id, text in zip(frame.doc_id, frame.text):
            raw = text.encode("utf-8")
            if len(raw) >= LENGTH:
                block.append((doc_id, raw))
                size += len(raw)
            if size >= BLOCK_BYTES:
                yield block
                block, size = [], 0
    if block:
        yield block


def _placed(block):
    """(lengths, starts, samples a document, document starts by sample, samples) in the joined block."""
    lengths = np.array([len(raw) for _, raw in block])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    offsets = [sample_offsets(n) for n in lengths]
    sizes = [len(o) for o in offsets]
    base = np.repeat(starts[:-1], sizes)
    return lengths, starts, sizes, base, np.concatenate(offsets) + base


def _heads(frames):
    for block in _blocks(frames):
        at = _placed(block)[-1]
        head, n = np.unique(_Hashes(np.frombuffer(b"".join(raw for _, raw in block), np.uint8)).of(at, at + HEAD), return_counts=True)
        yield pd.DataFrame({"head": head.view(np.int64), "n": n})


def wide_heads(docs: DataFrame) -> np.ndarray:
    """Sorted fingerprints of heads with about a tenth of a bucket of samples or more."""
    some = docs.filter(F.pmod(F.xxhash64(F.lit(78), "doc_id"), F.lit(SAMPLED)) == 0)
    heads = some.mapInPandas(_heads, "head long, n long").groupBy("head").agg(F.sum("n").alias("n"))
    found = heads.filter(F.col("n") * 10 * SAMPLED >= BUCKET_SAMPLES).select("head").collect()
    return np.sort(np.array([r.head for r in found], np.int64).view(np.uint64))


def _ranked(frames, buckets: int, wide: np.ndarray):
    """Per block and bucket the samples (heads, surroundings, places), and the block's documents.

    Samples of wide heads go to buckets from `buckets` on, by their surroundings; these have
    the place of the head in `wide`, and all 64 bits of the surroundings.
    """
    for block in _blocks(frames):
        lengths, starts, sizes, base, at = _placed(block)
        low = np.maximum(at - BEFORE, base)
        high = np.minimum(at + LENGTH, base + np.repeat(lengths, sizes))
        hashes = _Hashes(np.frombuffer(b"".join(raw for _, raw in block), np.uint8))
        head, around = hashes.of(at, at + HEAD), mixed(hashes.of(low, high) + (at - low).astype(np.uint64))
        del hashes
        ids = np.array([d for d, _ in block], np.int64)
        doc = np.repeat(np.arange(len(block)), sizes)
        order = np.lexsort((at, ids[doc], around, head))
        head, around, at, doc = head[order], around[order], at[order], doc[order]
        again = np.zeros(len(at), bool)
        again[1:] = (head[1:] == head[:-1]) & (around[1:] == around[:-1])
        bucket = ((head >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)
        name = head & np.uint64(0xFFFFFFFF)
        if len(wide):
            index = np.minimum(np.searchsorted(wide, head), len(wide) - 1)
            dealt = wide[index] == head
            bucket = np.where(dealt, buckets + ((around & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), bucket)
            name = np.where(dealt, index.astype(np.uint64), name)
            order = np.argsort(bucket, kind="stable")
            bucket, name, around, at, doc, again = bucket[order], name[order], around[order], at[order], doc[order], again[order]
        edge = np.searchsorted(bucket, np.arange(2 * buckets + 1))  # sorted by head, so by bucket
        at -= starts[doc]
        rows = []
        for b in np.flatnonzero(np.diff(edge)):
            own = slice(edge[b], edge[b + 1])
            used, place = np.unique(doc[own], return_inverse=True)
            # the earliest of equal samples of a block stands for the others, which are covered
            new, old = ~again[own], again[own]
            rows.append((
                int(b), name[own][new].astype(np.uint32).tobytes(),
                (around[own][new] if b >= buckets else (around[own][new] >> np.uint64(32)).astype(np.uint32)).tobytes(),
                at[own][new].astype(np.uint32).tobytes(), place[new].astype(np.uint32).tobytes(),
                at[own][old].astype(np.uint32).tobytes(), place[old].astype(np.uint32).tobytes(), ids[used].tobytes(),
            ))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RANKED.split(", ")])


_RANKED = "bucket int, heads binary, arounds binary, offsets binary, places binary, old_offsets binary, old_places binary, docs binary"


def _bucket(key, frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Of one bucket: covered samples (head 0), and open ones with their head.

    In a bucket of wide heads the earliest of equal surroundings is open in any case, as other
    surroundings of the head are in other buckets; such heads are below 0.
    """
    dealt = key[0] >= buckets
    joined = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in frame[name]])
    named = lambda places: np.concatenate([np.frombuffer(d, np.int64)[np.frombuffer(p, np.uint32)] for d, p in zip(frame.docs, frame[places])])
    head, around, at, doc = joined("heads", np.uint32), joined("arounds", np.uint64 if dealt else np.uint32), joined("offsets", np.uint32), named("places")
    old = pd.DataFrame({"doc_id": named("old_places"), "at": joined("old_offsets", np.uint32).astype(np.int32), "head": np.int64(0)})
    order = np.argsort(head, kind="stable")
    same = head[order[1:]] == head[order[:-1]]
    twice = np.full(len(head), dealt)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    head, around, at, doc = head[twice], around[twice], at[twice], doc[twice]
    order = np.lexsort((at, doc, around, head))
    head, around, at, doc = head[order], around[order], at[order], doc[order]
    first = np.ones(len(head), bool)
    first[1:] = (head[1:] != head[:-1]) | (around[1:] != around[:-1])
    # a head all of whose samples have equal surroundings is done
    change = np.ones(len(head), bool)
    change[1:] = head[1:] != head[:-1]
    group = np.cumsum(change) - 1
    kinds = np.bincount(group, weights=first) if len(group) else np.zeros(0)
    keep = ~first | (kinds[group] > 1) | dealt
    cls = -1 - head.astype(np.int64) if dealt else (np.int64(key[0]) << np.int64(32)) + head.astype(np.int64) + 1
    found = pd.DataFrame({"doc_id": doc, "at": at.astype(np.int32), "head": np.where(first, cls, 0)})[keep]
    return pd.concat([old, found], ignore_index=True)


def _parts(frames):
    """The rows of the frames a thousand at a time, so that results stay small."""
    for frame in frames:
        for start in range(0, len(frame), 1_000):
            yield frame.iloc[start : start + 1_000]


def _surroundings(frames):
    """The bytes around open samples."""
    for frame in _parts(frames):
        rows = []
        for doc_id, text, places, heads in zip(frame.doc_id, frame.text, frame.places, frame.heads):
            raw = text.encode("utf-8")
            for at, head in zip(places.tolist(), heads.tolist()):
                low = max(0, at - BEFORE)
                rows.append((head, doc_id, at, at - low, raw[low : at + LENGTH]))
        yield pd.DataFrame(rows, columns=["head", "doc_id", "at", "before", "around"])


def _sent(digests: list[bytes], doc: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Strings once each, the earliest of equal ones, and intervals of the later ones (again)."""
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    order = np.lexsort((start, doc, both[:, 1], both[:, 0]))
    both, doc, start = both[order], doc[order], start[order]
    again = np.zeros(len(doc), bool)
    again[1:] = (both[1:] == both[:-1]).all(axis=1)
    new = pd.DataFrame({"one": both[~again, 0], "two": both[~again, 1], "doc_id": doc[~again], "start": start[~again]})
    doc, start = doc[again], start[again]
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    # later strings that start side by side are one interval
    apart = np.flatnonzero((np.diff(doc, prepend=doc[:1] - 1) != 0) | (np.diff(start, prepend=start[:1]) > 1))
    last = np.append(apart[1:], len(doc))[: len(apart)] - 1
    old = pd.DataFrame({"one": start[apart], "two": doc[apart], "doc_id": doc[apart], "start": start[apart], "end": start[last] + LENGTH})
    return pd.concat([new.assign(end=new.start + LENGTH, again=False), old.assign(again=True)], ignore_index=True)


def _strings(frames):
    """All strings that hold an open sample of a wide head, by a digest of 128 bits."""
    digests, docs, starts = [], [], []
    for frame in frames:
        for doc_id, text, places in zip(frame.doc_id, frame.text, frame.places):
            raw = text.encode("utf-8")
            own = np.unique(np.asarray(places, np.int64)[:, None] + np.arange(-BEFORE, 1))
            own = own[(own >= 0) & (own <= len(raw) - LENGTH)]
            for s in range(0, len(own), STRINGS):
                part = own[s : s + STRINGS]
                digests += [hashlib.blake2b(raw[i : i + LENGTH], digest_size=16).digest() for i in part.tolist()]
                docs.append(np.full(len(part), doc_id, np.int64))
                starts.append(part)
                if len(digests) >= STRINGS:
                    yield _sent(digests, np.concatenate(docs), np.concatenate(starts))
                    digests, docs, starts = [], [], []
    if digests:
        yield _sent(digests, np.concatenate(docs), np.concatenate(starts))


def _paired(around: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal bytes before and from the sample on, for pairs of rows of aligned surroundings."""
    left, right = np.empty(len(one), np.int32), np.empty(len(one), np.int32)
    for s in range(0, len(one), 20_000):
        part = slice(s, s + 20_000)
        a, b = around[one[part]], around[two[part]]
        same = (a == b) & (a < 256)
        before, after = same[:, BEFORE - 1 :: -1], same[:, BEFORE:]
        left[part] = np.where(before.all(axis=1), BEFORE, before.argmin(axis=1))
        right[part] = np.where(after.all(axis=1), LENGTH, after.argmin(axis=1))
    return left, right


def _earlier_by_sets(around: list[bytes], before: list[int]) -> list[tuple[int, int]]:
    """Per sample of one head, in order: the first and last place, from the sample on, of a
    string that an earlier one has at the same place; (1, 0) if there is none."""
    found = [(1, 0)] * len(around)
    for place in range(-BEFORE, 1):
        seen: set[bytes] = set()
        for i, (raw, b) in enumerate(zip(around, before)):
            string = raw[b + place : b + place + LENGTH] if b + place >= 0 else b""
            if len(string) == LENGTH:
                if string in seen:
                    found[i] = (min(found[i][0], place), place)
                seen.add(string)
    return found


def _edges(frame: pd.DataFrame) -> pd.DataFrame:
    """Intervals of later samples that earlier samples of the same head cover, one a sample.

    All intervals around a sample hold its head, so their union is one interval.
    """
    frame = frame.sort_values(["head", "doc_id", "at"], kind="stable", ignore_index=True)
    head, at, doc = frame["head"].to_numpy(), frame["at"].to_numpy(np.int64), frame.doc_id.to_numpy()
    n = len(frame)
    around = np.full((n, BEFORE + LENGTH), 256, np.uint16)  # 256: outside the document
    for i, (b, raw) in enumerate(zip(frame.before, frame.around)):
        around[i, BEFORE - b : BEFORE - b + len(raw)] = np.frombuffer(raw, np.uint8)
    change = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1], [True]]))
    size = np.diff(change)
    rank = np.arange(n) - np.repeat(change[:-1], size)
    few = np.repeat(size <= PAIRS, size)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for back in range(1, PAIRS):
        two = np.flatnonzero(few & (rank >= back))
        if len(two):
            left, right = _paired(around, two - back, two)
            ok = left + right >= LENGTH
            low[two[ok]] = np.maximum(low[two[ok]], left[ok])
            high[two[ok]] = np.maximum(high[two[ok]], right[ok])
    del around
    for a, b in zip(change[:-1], change[1:]):
        if b - a > PAIRS:
            for i, (first, last) in enumerate(_earlier_by_sets(frame.around[a:b].tolist(), frame.before[a:b].tolist()), a):
                if first <= last:
                    low[i], high[i] = -first, last + LENGTH
    hit = high > 0
    return pd.DataFrame({"doc_id": doc[hit], "start": at[hit] - low[hit], "end": at[hit] + high[hit]}).astype(np.int64)


def united(starts, ends, n: int) -> list[tuple[int, int]]:
    """Maximal intervals within 0..n from intervals that, so cut, have LENGTH bytes at least."""
    out: list[list[int]] = []
    for s, e in sorted((max(s, 0), min(e, n)) for s, e in zip(starts, ends)):
        if e - s >= LENGTH:
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
    return [(a, b) for a, b in out]


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end): byte intervals to remove; they overlap, and may pass a text's ends."""
    docs = texts(docs).filter("doc_id is not null")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    samples = size * len(COVER) // PERIOD
    buckets = samples // BUCKET_SAMPLES + 1
    wide = wide_heads(docs) if buckets > 1 else np.zeros(0, np.uint64)
    ranked = docs.mapInPandas(lambda f: _ranked(f, buckets, wide), _RANKED)
    found = stored(ranked.groupBy("bucket").applyInPandas(lambda key, f: _bucket(key, f, buckets), "doc_id long, at int, head long"), "repeat-samples")
    opened = found.filter("head <> 0")
    limit = min(max(samples // WIDE_SHARE, WIDE_LEAST), WIDE_MOST)
    large = stored(opened.groupBy("head").count().filter(f"count > {limit}").select("head"), "repeat-wide-heads")
    covered = found.filter("head = 0").selectExpr("doc_id", f"bigint(at - {BEFORE}) start", f"bigint(at + {LENGTH}) end")
    if not large.isEmpty():
        covered = covered.union(_wide_edges(docs, opened.join(sized(large), "head", "left_semi")))
        opened = opened.join(sized(large), "head", "left_anti")
    groups = opened.count() // BUCKET_EDGES + 1
    places = opened.groupBy("doc_id").agg(F.collect_list("at").alias("places"), F.collect_list("head").alias("heads"))
    around = docs.join(places, "doc_id").mapInPandas(_surroundings, "head long, doc_id long, at int, before int, around binary")
    around = around.withColumn("part", F.pmod(F.xxhash64("head"), F.lit(groups)))
    edges = stored(around.groupBy("part").applyInPandas(lambda f: _edges(f.drop(columns="part")), "doc_id long, start long, end long"), "repeat-edges")
    return covered.union(edges)


def _wide_edges(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """Intervals of strings around the samples that equal an earlier such string.

    A task sends equal strings once, so a string has at most as many rows as there are parts.
    """
    places = opened.groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    strings = docs.join(places, "doc_id").mapInPandas(_strings, "one long, two long, doc_id long, start long, end long, again boolean")
    order = Window.partitionBy("one", "two", "again").orderBy("doc_id", "start")
    later = strings.withColumn("nth", F.row_number().over(order)).filter("again or nth > 1")
    return stored(later.select("doc_id", "start", "end"), "repeat-wide-edges")


def _removed(frames):
    for frame in _parts(frames):
        rows = []
        for text, starts, ends in zip(frame.text, frame.starts, frame.ends):
            raw = text.encode("utf-8")
            cut = united(starts.tolist(), ends.tolist(), len(raw)) if starts is not None else []
            kept, last = [], 0
            for a, b in cut:
                kept.append(raw[last:a])
                last = b
            kept.append(raw[last:])
            rows.append((len(raw), sum(b - a for a, b in cut), len(cut), b"".join(kept)))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
        out.insert(0, "doc_id", frame.doc_id.astype("Int64").array)
        yield out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row; kept: the remaining bytes.

    A null text is empty. Texts under 100 bytes keep all. A row with a null doc_id keeps all
    its bytes and removes none from others. doc_id should be unique; rows that repeat one
    each lose the intervals found in any of them. Other columns go.
    """
    return _applied(docs, _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _digested(frames):
    for frame in _removed(frames):
        frame["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in frame.kept]
        yield frame.drop(columns="kept")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): remove_repeats() in short."""
    return _applied(docs, _digested, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _applied(docs: DataFrame, run, schema: str) -> DataFrame:
    spans = repeats(docs).groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return texts(docs).join(spans, "doc_id", "left").mapInPandas(run, schema)
