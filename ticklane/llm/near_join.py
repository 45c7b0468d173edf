"""N-gram Jaccard join: size-aware, light sets by fixed-size subsets, heavy sets by inverted lists.

A document's set is its distinct word shingles (see shingles). Two sets link when
100 * intersection >= percent * union. The join is exact:

1. Equal sets are one class, found by a digest; only classes with two shingles or more go on.
2. Shingles have one global order: those found in many documents last, others by hash.
   A set of n can only link with a set that shares k of its first n - ceil(t n) + k shingles.
3. Light sets (n <= boundary) enumerate the 2-subsets of that prefix (k = 2); heavy sets
   post single shingles (k = 1) to inverted lists, as do the light sets large enough to
   link with a heavy one. The boundary has the least estimated cost: subsets against list
   entries times mean list length, taken per size from the data.
4. In each list sets are compared with its earliest document and with the earliest one of
   about their size (stars, not all pairs).
   Verified links form components; only list mates of different components are compared
   after that, and only at entries so early in both sets that the overlap which their two
   sizes need is still possible. Of such a pair the shared entries are counted, and only if
   they are as many as the prefixes of a linked pair share are the texts compared. So
   groups of copies cost links in proportion to their members, passages that many texts
   share cost short lists of keys, and no link between components is lost.

Hot keys: list sizes and pivots are combined before the shuffle, and the joins on a key may
be split by adaptive execution. A set is never gathered across documents in one task.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.components import components
from ticklane.llm.shingles import mixed, shingle_sets
from ticklane.llm.tables import sized, stored, texts, tidied

#: Sizes at which a boundary between light and heavy sets may lie.
BOUNDARIES = (2, 4, 8, 12, 16, 24, 32, 48, 64)
#: A shingle is common if found in one of so many documents, and in COMMON_LEAST at least.
#: At most (mean set size * COMMON_SHARE) shingles can be common, whatever the corpus size.
COMMON_SHARE, COMMON_LEAST = 10_000, 8
#: Times that a shingle must occur in a stretch of so many shingles of a task to be reported at all.
COMMON_IN_TASK, STRETCH = 2, 6_000_000
#: Parts of the range of hashes in which a stretch is counted.
PARTS = 8


def _digest(s: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mixed(s)) ^ np.add.reduce(mixed(s * np.uint64(3)))) if len(s) else 0


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _profile(frames):
    """Per document its set size, digests and first shingle; per task its common shingles."""
    sets = []

    def common():
        """The counts, by parts of the range of hashes: sets are sorted, so a part is a slice."""
        borders = np.arange(1, PARTS, dtype=np.uint64) * np.uint64((1 << 64) // PARTS)
        cuts = np.array([[0, *np.searchsorted(s, borders), len(s)] for s in sets]).reshape(len(sets), PARTS + 1)
        for i in range(PARTS if sets else 0):
            values = np.concatenate([s[a:b] for s, a, b in zip(sets, cuts[:, i], cuts[:, i + 1])])
            values.sort()
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
            counts = np.diff(first, append=len(values))
            often = counts >= COMMON_IN_TASK
            yield pd.DataFrame({"doc_id": None, "n": counts[often], "d1": _signed(values[first[often]]), "d2": 0, "first": 0, "kind": 1})

    held = 0
    for frame in frames:
        found = list(shingle_sets(frame.text))
        yield pd.DataFrame({
            "doc_id": frame.doc_id.astype("Int64"),
            "n": [len(s) for s in found],
            "d1": _signed([_digest(s) for s in found]),
            "d2": _signed([_digest(s ^ np.uint64(0x5851F42D4C957F2D)) for s in found]),
            "first": _signed([s[0] if len(s) else 0 for s in found]),
            "kind": 0,
        })
        sets += found
        held += sum(map(len, found))
        if held > STRETCH:  # bounds the memory of a long task
            yield from common()
            sets, held = [], 0
    yield from common()


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set it links with."""
    return -(-n * percent // 100)


def prefix(n: int, k: int, percent: int) -> int:
    return n - needed(n, percent) + k


def boundary(sizes: list[tuple[int, int, float]], percent: int) -> int:
    """Light sets have this many shingles at most. sizes: (n, sets, mean list length)."""

    def cost(b: int) -> float:
        light = sum(c * math.comb(prefix(n, 2, percent), 2) for n, c, _ in sizes if n <= b)
        return light + sum(c * prefix(n, 1, percent) * mean for n, c, mean in sizes if 100 * n >= percent * (b + 1))

    return min(BOUNDARIES, key=lambda b: (cost(b), b))


def _postings(frames, common: np.ndarray, limit: int, percent: int):
    """(key, doc_id, late): late is the place of the key's last shingle in the set's order,
    less one for a subset of two. Sets of n and m that must share c have a key in common
    with late at most n - c in one and m - c in the other.
    """
    for frame in frames:
        keys, ids, late = [], [], []
        for doc_id, s in zip(frame.doc_id, shingle_sets(frame.text)):
            n = len(s)
            if n < 2:  # one shingle links with its equal only
                continue
            if len(common):
                at = np.searchsorted(common, s)
                often = common[np.minimum(at, len(common) - 1)] == s
                s = np.concatenate([s[~often], s[often]])
            if n <= limit:
                head = s[: prefix(n, 2, percent)]
                i, j = np.triu_indices(len(head), 1)
                keys.append(mixed(np.minimum(head[i], head[j]) * np.uint64(3) + mixed(np.maximum(head[i], head[j]))))
                ids.append(np.full(len(i), doc_id))
                late.append(j - 1)
            if 100 * n >= percent * (limit + 1):
                head = s[: prefix(n, 1, percent)]
                keys.append(head)
                ids.append(np.full(len(head), doc_id))
                late.append(np.arange(len(head)))
        if keys:
            yield pd.DataFrame({
                "key": _signed(np.concatenate(keys)), "doc_id": np.concatenate(ids).astype(np.int64), "late": np.concatenate(late).astype(np.int32)
            })


def _linked(frames, percent: int):
    last, one = None, None
    for frame in frames:
        links = []
        new = [a != b for a, b in zip(frame.a, [last, *frame.a[:-1]])]  # runs of one a share its set
        firsts = shingle_sets(x for x, is_new in zip(frame.text_a, new) if is_new)
        for a, b, is_new, two in zip(frame.a, frame.b, new, shingle_sets(frame.text_b)):
            if is_new:
                last, one = a, next(firsts)
            both = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * both >= percent * (len(one) + len(two) - both):
                links.append((a, b))
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link; whole sets are compared."""
    pairs = stored(pairs, "near-pairs")
    ids = stored(pairs.selectExpr("explode(array(a, b)) doc_id").distinct(), "near-ids")
    own = stored(docs.join(sized(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "near-texts")
    rows = pairs.join(own.selectExpr("doc_id a", "text text_a"), "a").join(own.selectExpr("doc_id b", "text text_b"), "b")
    return stored(rows.select("a", "b", "text_a", "text_b").mapInPandas(lambda f: tidied(_linked(f, percent)), "a long, b long"), "near-links")


def near_join(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; exact links at percent of Jaccard.

    Null text or no words: n_shingles 0, linked with nothing. Rows with a null doc_id can't
    be linked: their component_id is null. Rows that repeat a doc_id are one node, with the
    set of any one of them deciding its links to others. No rows: no result. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    rows = stored(docs.mapInPandas(lambda f: tidied(_profile(f)), "doc_id long, n long, d1 long, d2 long, first long, kind int"), "near-profile")
    sets = rows.filter("kind = 0").drop("kind")
    known = sets.filter("doc_id is not null")
    total = sets.count()
    least = max(COMMON_LEAST, total // COMMON_SHARE)
    often = rows.filter("kind = 1").groupBy("d1").agg(F.sum("n").alias("c")).filter(F.col("c") >= least).select("d1")
    common = spark.sparkContext.broadcast(np.sort(np.array([r.d1 for r in often.toLocalIterator()], np.int64).view(np.uint64)))
    by_size = (
        known.filter("n >= 2").groupBy(F.least("n", F.lit(2 * BOUNDARIES[-1])).alias("n"))
        .agg(F.count("*").alias("c"), F.approx_count_distinct("first").alias("f")).collect()
    )
    limit = boundary([(r.n, r.c, r.c / max(r.f, 1)) for r in by_size], percent)

    classes = known.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    classes = stored(known.filter("n > 0").join(classes, ["d1", "d2", "n"]).select("doc_id", "n", "rep"), "near-classes")
    reps = classes.filter("doc_id = rep").select("doc_id", "n").distinct()

    postings = docs.filter("doc_id is not null").mapInPandas(lambda f: tidied(_postings(f, common.value, limit, percent)), "key long, doc_id long, late int")
    postings = stored(postings, "near-postings")
    lists = postings.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("key")
    mates = stored(postings.join(lists, "key").join(reps, "doc_id").select("key", "doc_id", "n", "late"), "near-mates")

    # Stars: each set with the earliest document of a list, and with the earliest of its own
    # size there. They find most links, not all; what they leave out comes below.
    mates = mates.withColumn("band", F.floor(F.log("n") / math.log(100 / percent) * 2))
    pivots = mates.groupBy("key").agg(F.min("doc_id").alias("a")).withColumn("band", F.lit(None).cast("bigint"))
    by_size = mates.groupBy("key", "band").agg(F.min("doc_id").alias("a"))
    star = mates.select("key", "doc_id", "n").join(pivots.select("key", "a"), "key").unionByName(
        mates.join(by_size, ["key", "band"]).select("key", "doc_id", "n", "a")
    )
    star = star.filter("doc_id > a").groupBy("a", F.col("doc_id").alias("b"), F.col("n").alias("nb")).agg(F.count_distinct("key").alias("k"))
    star = star.join(reps.selectExpr("doc_id a", "n na"), "a")
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    # Sets that link share at least so many entries; light ones are known by pairs of them.
    likely = (small <= limit) | ((100 + percent) * (F.col("k") + F.ceil(large * percent / 100)) > percent * (small + large))
    star = stored(star.filter((100 * small >= percent * large) & likely).select("a", "b"), "near-star")
    links = verified(star, docs, percent)

    roots = components(links)
    placed = mates.join(roots.selectExpr("node doc_id", "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    placed = stored(placed, "near-placed")
    open_lists = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    placed = stored(placed.join(open_lists, "key"), "near-open")
    # a is the smaller set of a pair (of equals the earlier), so its entry is early by more, and
    # b is in the same band of sizes or in the next.
    size = F.floor(F.log("n") / (1.001 * math.log(100 / percent)))  # a little wide, for rounding
    fits = (F.col("ra") != F.col("rb")) & (F.struct("na", "a") < F.struct("nb", "b"))
    for x in "ab":  # n - late at least the overlap that both sizes need
        fits = fits & ((100 + percent) * (F.col(f"n{x}") - F.col(f"late_{x}")) >= percent * (F.col("na") + F.col("nb")))
    one, two = (placed.select("key", F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}"), F.col("late").alias(f"late_{x}"), size.alias(f"size_{x}")) for x in "ab")
    one = one.filter((100 + percent) * (F.col("na") - F.col("late_a")) >= 2 * percent * F.col("na"))
    one = one.withColumn("size_b", F.explode(F.array("size_a", F.col("size_a") + 1)))
    crossing = one.join(two, ["key", "size_b"]).filter(fits).select("a", "b", "na", "nb").distinct()
    crossing = stored(crossing, "near-crossing")
    in_pair = crossing.selectExpr("explode(array(a, b)) doc_id").distinct()
    entries = mates.join(in_pair, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))  # a prefix each
    entries = stored(entries, "near-entries")
    for x in "ab":
        crossing = crossing.join(entries.select(F.col("doc_id").alias(x), F.col("keys").alias(f"keys_{x}")), x)
    crossing = crossing.withColumn("k", F.size(F.array_intersect("keys_a", "keys_b"))).filter(likely)
    crossing = crossing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = verified(crossing.join(star, ["a", "b"], "left_anti"), docs, percent)

    same = classes.filter("doc_id > rep").selectExpr("rep a", "doc_id b")
    roots = components(links.union(more).union(same))
    return sets.join(roots.selectExpr("node doc_id", "root"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id")
    )


def without_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents, all columns, without those whose component has a smaller doc_id.

    Rows with a null doc_id stay. Of rows that repeat a doc_id, all stay or all go.
    """
    gone = near_join(docs, percent).filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(sized(stored(gone, "near-gone")), "doc_id", "left_anti").select(docs.columns)
