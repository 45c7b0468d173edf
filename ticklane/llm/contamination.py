"""Benchmark decontamination: size-partitioned MinHash containment search.

An item of a benchmark is found in a document if the document holds at least `percent` of
the item's distinct word shingles (five words; A-Z lower-cased; an item with fewer words is
its whole word sequence as one shingle, sought as such in documents).

Items are parted by the size of their shingle set, doubling from part to part. An item's
sketch is the SKETCH shingles of least hash. The sketches of a part lie below a bound, the
lower the larger its items are. A document keeps its shingles up to the largest bound of the
parts whose items are small enough for it to hold. A document and an item that share a
sketch shingle are a candidate: an item held to 75 percent is missed with a chance of
0.25 ** SKETCH. Items of at most SKETCH shingles have all of them in the sketch. Candidates
are then verified by exact containment on the shingles themselves.

All of it is column expressions. Hot passages: the shingles of a document are looked up by a
join on the hash, which adaptive execution may split; nothing is grouped by shingle or item.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.llm.tables import sized, stored, texts

WIDTH = 5
SKETCH = 8
#: Upper bounds of the parts by number of shingles; the last part has no bound.
PARTS = (8, 16, 32, 64, 128, 256, 512)
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _SPACE), lambda w: w != "")


def shingles_of(words: str, width: int) -> Column:
    """Shingles of one width, as texts; none if there are fewer words."""
    last = F.size(words) - F.lit(width - 1)
    at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.slice(words, i, width))))


def hashes_of(words: str, width: int) -> Column:
    last = F.size(words) - F.lit(width - 1)
    at = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: hashed(*[F.get(words, i + k) for k in range(width)]))


def hashed(*words: Column) -> Column:
    """Hash of a shingle, at least 0."""
    return F.xxhash64(*words).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def _rehashed(shingles: str, width: int) -> Column:
    return F.transform(shingles, lambda s: hashed(*[F.get(F.split(s, " "), F.lit(i)) for i in range(width)]))


def _sought(width: int, parts: list[tuple[int, int]]) -> Column:
    """Array of (width, h): hashes of a document's shingles, up to the bound of its size.

    parts: the fewest shingles with which a document can hold an item of a part, and the
    bound of the part.
    """
    n = F.size("words") - F.lit(width - 1)
    bound = F.greatest(F.lit(-1), *[F.when(n >= need, F.lit(top)).otherwise(F.lit(-1)) for need, top in parts])
    kept = F.array_distinct(F.filter(hashes_of("words", width), lambda h: h <= bound))
    return F.transform(kept, lambda h: F.struct(F.lit(width).alias("width"), h.alias("h")))


def _once(frame: DataFrame, **values: Column) -> DataFrame:
    """Adds columns behind a generator, so that later filters do not compute them anew."""
    struct = F.struct(*[v.alias(k) for k, v in values.items()])
    return frame.select("*", F.explode(F.array(struct)).alias("_once")).select(*frame.columns, "_once.*")


def find_items(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) for each document that holds an item.

    n_item: distinct shingles of the item; n_shared: those found in the document. Null or
    empty texts hold nothing and are held by nothing. Rows that repeat an id count as one row
    each for items (the pair appears once, with the largest share) and are one document if
    ids repeat in docs. Null ids never match. Other columns are ignored.
    """
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).filter("item_id is not null")
    items = _once(items.distinct(), words=words_of(F.col("text"))).filter(F.size("words") > 0)
    items = items.withColumn("width", F.least(F.size("words"), F.lit(WIDTH)))
    full = F.when(F.col("width") == WIDTH, shingles_of("words", WIDTH)).otherwise(F.array(F.concat_ws(" ", "words")))
    items = stored(items.select("item_id", "width", full.alias("shingles")).withColumn("n_item", F.size("shingles")), "items")
    by_width = F.coalesce(*[F.when(F.col("width") == k, _rehashed("shingles", k)) for k in range(1, WIDTH + 1)])
    part = F.coalesce(*[F.when(F.col("n_item") <= bound, F.lit(i)) for i, bound in enumerate(PARTS)], F.lit(len(PARTS)))
    sketches = items.select("item_id", "width", part.alias("part"), "n_item", F.slice(F.array_sort(by_width), 1, SKETCH).alias("h"))
    sketches = stored(sketches.select("item_id", "width", "part", "n_item", F.explode("h").alias("h")), "item-sketches")
    # at most (widths x parts) rows, whatever the tables hold
    bounds = sketches.groupBy("width", "part").agg(F.max("h").alias("top"), F.min("n_item").alias("least")).collect()

    rows = _once(texts(docs).filter("doc_id is not null"), words=words_of(F.col("text")))
    sought = [
        _sought(width, [(-(-b.least * percent // 100), b.top) for b in bounds if b.width == width])
        for width in sorted({b.width for b in bounds})
    ]
    if not sought:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item int, n_shared int")
    found = rows.select("doc_id", F.explode(F.concat(*sought)).alias("s")).select("doc_id", "s.*")
    pairs = stored(found.join(sized(sketches.select("width", "h", "item_id")), ["width", "h"]).select("doc_id", "item_id").distinct(), "leak-pairs")

    ids = stored(pairs.select("doc_id").distinct(), "leak-ids")
    held = _once(texts(docs).join(sized(ids), "doc_id", "left_semi"), words=words_of(F.col("text")))
    both = pairs.join(held.select("doc_id", "words"), "doc_id").join(sized(items), "item_id")
    in_doc = F.coalesce(*[F.when(F.col("width") == k, shingles_of("words", k)) for k in range(1, WIDTH + 1)])
    both = _once(both, n_shared=F.size(F.array_intersect("shingles", in_doc)))
    both = both.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return both.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared")).alias("best")).select(
        "doc_id", "item_id", "best.n_item", "best.n_shared"
    )


def without_items(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """The documents, all columns, that hold no item. Rows with a null doc_id stay."""
    bad = stored(find_items(docs, items, percent).select("doc_id").distinct(), "leaks")
    return docs.join(sized(bad), "doc_id", "left_anti").select(docs.columns)
