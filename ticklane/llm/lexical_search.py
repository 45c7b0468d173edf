"""Ranked lexical search for a set of items over all documents, by dual trees.

Terms are maximal runs of ASCII letters, ASCII digits and characters beyond ASCII; A-Z are
lower-cased. With N documents that hold a term, L terms in them, n terms in a document, df
documents that hold a term and tf occurrences in the document:

    w = floor(1000 * ln((2N + 2) / (2df + 1)))          m = 50 + (50 * n * N) div L
    score = sum over the item's distinct terms of w * ((10**9 * tf) div (1000 * tf + 20 * m))

A document is a vector of such summands, an item a set of terms. Documents are dealt out in
the order of their heaviest term, so that neighbours are alike; branches of 4,096 documents
and leaves of 128 hold the largest summand of each term, and groups of 8, 64, ... items the
union of their terms. The largest summands of a document node, summed over the terms of an
item group, bound all its scores: a pair of nodes whose bound is below the weakest k-th
score of its items is left out, which loses nothing. A first pass scores only the most
promising leaf of each branch, to give each item a k-th score to start from.

Items are taken in parts of a bounded number of terms; a part's terms are sent to every
task, documents are not collected anywhere.
"""

from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklane.llm.tables import ship, stored, texts

TOP = 50
BRANCH, LEAF, FANOUT = 4_096, 128, 8
#: Item terms of a part, in the mean; what is broadcast is bounded by it.
PART_TERMS = 300_000
#: Places in a task's best scores that are told to the other tasks.
_TOLD = (1, 2, 5, 10, 20, 50)
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms, lower-cased; all others become a space.
_TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32) for b in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): distinct terms of each item that has any."""
    text = F.min(F.coalesce("text", F.lit(""))).alias("text")
    found = items.filter("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(text)
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_PATTERN), F.lit(0)))
    return found.select("item_id", terms.alias("terms")).filter(F.size("terms") > 0)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


@dataclass
class ItemTree:
    """Items in the order of their rarest term. levels[k] has the terms of groups of FANOUT ** k."""

    ids: np.ndarray
    vocabulary: dict[bytes, int]
    levels: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    floors: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def of(cls, items: list[tuple[int, list[str]]]) -> "ItemTree":
        seen: dict[str, int] = {}
        for _, terms in items:
            for t in terms:
                seen[t] = seen.get(t, 0) + 1
        vocabulary = {t: i for i, t in enumerate(sorted(seen, key=lambda t: (seen[t], t)))}
        sets = sorted((sorted(vocabulary[t] for t in terms), item) for item, terms in items)
        groups, levels = [np.array(s, np.int64) for s, _ in sets], []
        while True:
            levels.append((np.concatenate(groups), np.cumsum([0, *map(len, groups)])))
            if len(groups) == 1:
                break
            groups = [np.unique(np.concatenate(groups[i : i + FANOUT])) for i in range(0, len(groups), FANOUT)]
        ids = np.array([item for _, item in sets], np.int64)
        return cls(ids, {t.encode(): i for t, i in vocabulary.items()}, levels, floors=np.zeros(len(ids)))

    def terms(self, item: int) -> np.ndarray:
        flat, at = self.levels[0]
        return flat[at[item] : at[item + 1]]

    def bounds(self, level: int, groups: np.ndarray, largest: np.ndarray) -> np.ndarray:
        flat, at = self.levels[level]
        sizes = at[groups + 1] - at[groups]
        summands = largest[flat[_ranges(at[groups], sizes)]]
        return np.add.reduceat(summands, np.cumsum(sizes) - sizes)

    def reached(self, largest: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Items whose bound over a document node reaches their floor, from the root down."""
        groups = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            bounds = self.bounds(level, groups, largest)
            least = np.minimum.reduceat(floors, np.arange(0, len(floors), FANOUT**level))[groups]
            groups = groups[(bounds > 0) & (bounds >= least)]
            if not len(groups):
                break
            if level:
                groups = (groups[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                groups = groups[groups < len(self.levels[level - 1][1]) - 1]
        return groups


def _vectors(batches, tree: ItemTree):
    """(doc_id, n, ids, tfs): all terms of a document counted, those of items by number."""
    get, width = tree.vocabulary.get, len(tree.vocabulary)
    for whole in batches:
        for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
            counts, keys = [], [np.zeros(0, np.int64)]
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                words = text.as_py().translate(_TERM_BYTES).split()
                found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                counts.append(len(words))
                keys.append(found[found >= 0] + i * width)
            keys, tfs = np.unique(np.concatenate(keys), return_counts=True)
            at = np.searchsorted(keys, np.arange(batch.num_rows + 1) * width)
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys % max(width, 1), pa.int32()))
            tfs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tfs, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), ids, tfs], ["doc_id", "n", "ids", "tfs"])


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = np.asarray(column.offsets, np.int64)
    return np.asarray(column.flatten()), at - at[0]


def _weighed(batches, weights: np.ndarray, n_docs: int, n_terms: int):
    """(doc_id, anchor, ids, summands) of vectors that are not empty; anchor is the heaviest term."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, at = _flat(batch.column("ids"))
        tf = _flat(batch.column("tfs"))[0].astype(np.int64)
        m = 50 + (50 * np.asarray(batch.column("n"), np.int64) * n_docs) // n_terms
        summands = weights[ids] * ((10**9 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(at))))
        row = np.repeat(np.arange(batch.num_rows), np.diff(at))
        anchors = ids[np.lexsort((-summands, row))[at[:-1]]]
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (ids, summands)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(anchors), *lists], ["doc_id", "anchor", "ids", "summands"])


class _Node:
    """A branch of documents with its leaves; entries are in the order of (leaf, term)."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.docs = np.asarray(batch.column("doc_id"), np.int64)
        ids, at = _flat(batch.column("ids"))
        doc = np.repeat(np.arange(len(self.docs)), np.diff(at))
        summands = _flat(batch.column("summands"))[0].astype(np.float64)  # whole numbers below 2 ** 53
        order = np.lexsort((ids, doc // LEAF))
        ids, self.doc, self.summand = ids[order].astype(np.int64), doc[order], summands[order]
        keys = self.doc // LEAF * width + ids
        self.start = np.flatnonzero(np.diff(keys, prepend=-1))
        self.size = np.diff(self.start, append=len(keys))
        self.term, self.largest = ids[self.start], np.maximum.reduceat(self.summand, self.start)
        self.n_leaves = -(-len(self.docs) // LEAF)
        self.leaf_at = np.searchsorted(self.doc[self.start] // LEAF, np.arange(self.n_leaves + 1))

    def leaf(self, k: int) -> slice:
        return slice(self.leaf_at[k], self.leaf_at[k + 1])


class _Search:
    """The best documents of a task so far, per item."""

    def __init__(self, tree: ItemTree):
        self.tree, n, width = tree, len(tree.ids), len(tree.vocabulary)
        self.floors = tree.floors.copy()
        self.best = [(np.zeros(0), np.zeros(0, np.int64))] * n
        self.largest, self.first, self.count = np.zeros(width), np.zeros(width, np.int64), np.zeros(width, np.int64)
        self.width = width

    def branches(self, batches):
        """Nodes of BRANCH documents, whatever the size of the batches."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BRANCH:
                rows = pa.concat_batches(held)
                yield _Node(rows.slice(0, BRANCH), self.width)
                held = [rows.slice(BRANCH)]
        if any(b.num_rows for b in held):
            yield _Node(pa.concat_batches(held), self.width)

    def at_leaf(self, node: _Node, k: int, find):
        """Calls find with the leaf's largest summands laid out by term."""
        part = node.leaf(k)
        terms = node.term[part]
        self.largest[terms], self.first[terms], self.count[terms] = node.largest[part], node.start[part], node.size[part]
        find(self.largest)
        self.largest[terms], self.count[terms] = 0, 0

    def score(self, node: _Node, k: int, item: int) -> None:
        terms = self.tree.terms(item)
        at = _ranges(self.first[terms], self.count[terms])
        scores = np.bincount(node.doc[at] - k * LEAF, node.summand[at], LEAF)
        found = np.flatnonzero((scores > 0) & (scores >= self.floors[item]))
        if not len(found):
            return
        scores = np.concatenate([self.best[item][0], scores[found]])
        docs = np.concatenate([self.best[item][1], node.docs[found + k * LEAF]])
        order = np.lexsort((docs, -scores))[:TOP]
        self.best[item] = scores[order], docs[order]
        if len(order) == TOP:
            self.floors[item] = max(self.floors[item], scores[order[-1]])

    def search(self, batches):
        for node in self.branches(batches):
            np.maximum.at(self.largest, node.term, node.largest)
            worth = self.tree.reached(self.largest, self.floors)
            self.largest[node.term] = 0
            for k in range(node.n_leaves if len(worth) else 0):

                def find(largest, k=k, node=node):
                    for item in self.tree.reached(largest, self.floors):
                        self.score(node, k, item)

                self.at_leaf(node, k, find)

    def promise(self, batches):
        """Scores, for each item, the leaf of each branch whose bound is highest."""
        every = np.arange(len(self.tree.ids))
        for node in self.branches(batches):
            high = np.zeros((node.n_leaves, len(every)))
            for k in range(node.n_leaves):
                self.at_leaf(node, k, lambda largest, k=k, high=high: high.__setitem__(k, self.tree.bounds(0, every, largest)))
            chosen = high.argmax(axis=0)
            for k in range(node.n_leaves):
                items = np.flatnonzero((chosen == k) & (high.max(axis=0) >= np.maximum(self.floors, 1)))

                def find(largest, k=k, node=node, items=items):
                    for item in items:
                        self.score(node, k, item)

                self.at_leaf(node, k, find)


def _told(batches, tree: ItemTree):
    """(item, score, docs): docs documents more have this score at least."""
    run = _Search(tree)
    run.promise(batches)
    rows = [(i, scores[place - 1], place - before) for i, (scores, _) in enumerate(run.best) for before, place in zip((0, *_TOLD), _TOLD) if place <= len(scores)]
    kinds = (("item", pa.int32()), ("score", pa.float64()), ("docs", pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])


def _found(batches, tree: ItemTree):
    run = _Search(tree)
    run.search(batches)
    items = np.repeat(tree.ids, [len(s) for s, _ in run.best])
    scores, docs = (np.concatenate([b[i] for b in run.best]).astype(np.int64) for i in (0, 1))
    yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(docs), pa.array(scores)], ["item_id", "doc_id", "score"])


def _search_part(docs: DataFrame, items: list, top: int) -> DataFrame:
    """(item_id, doc_id, score) rows that hold the best documents of some items."""
    spark, tree = docs.sparkSession, ItemTree.of(items)
    sent = spark.sparkContext.broadcast(tree)
    vectors = docs.mapInArrow(lambda b: _vectors(b, sent.value), "doc_id long, n long, ids array<int>, tfs array<int>")
    vectors = stored(vectors.filter("n > 0"), "lexical-vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(tree.vocabulary))
    for r in vectors.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # a row for each term of the items
        df[r["id"]] = r["count"]
    tree.weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

    weights = spark.sparkContext.broadcast(tree.weights)
    weighed = vectors.filter("size(ids) > 0").mapInArrow(
        lambda b: _weighed(b, weights.value, n_docs, n_terms), "doc_id long, anchor int, ids array<int>, summands array<long>"
    )
    placed = weighed.repartitionByRange("anchor", "doc_id").sortWithinPartitions("anchor", "doc_id")
    leaves = stored(placed.drop("anchor"), "lexical-leaves")

    told = leaves.mapInArrow(lambda b: _told(b, sent.value), "item int, score double, docs int")
    so_far = F.sum("docs").over(Window.partitionBy("item").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    told = told.withColumn("docs", so_far).filter(F.col("docs") >= top)
    for r in told.groupBy("item").agg(F.max("score").alias("score")).collect():  # a row for each item of the part
        tree.floors[r["item"]] = r["score"]
    with_floors = spark.sparkContext.broadcast(tree)
    return leaves.mapInArrow(lambda b: _found(b, with_floors.value), "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, part_terms: int = PART_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` (50 at most) best documents of each item with a score above 0.

    rank counts from 1, by falling score, then rising doc_id. A null text has no terms;
    documents or items without an id are left out, of rows that share an item_id the one with
    the least text counts, and rows that share a doc_id are documents of their own. Items
    without terms, or with terms that no document holds, have no rows. Other columns go.
    """
    if not 1 <= top <= TOP:
        raise ValueError(f"top must be in [1, {TOP}]")
    spark = docs.sparkSession
    ship(spark)
    terms = stored(item_terms(items), "lexical-items")
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = -(-total // part_terms)
    rows = texts(docs.filter("doc_id is not null")).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for part in range(parts):
        chosen = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()  # part_terms terms in the mean
        if chosen:
            found = found.unionByName(_search_part(rows, [(r["item_id"], r["terms"]) for r in chosen], top))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
