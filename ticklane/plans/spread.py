"""Building blocks that keep a hot key from landing in one task.

A single run may hold a large share of all rows, so nothing here groups raw
rows by run alone. Rows are placed by ``(run, slice)``, where a slice is a fixed
range of ticks or log offsets. Both are unique within their key, so a slice
has a known largest size, and what has to cross slice borders is first reduced
to one row per slice.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ticks are 32-bit, so a run has at most 2**32 / TICK_SLICE, about 262,000 slices.
TICK_SLICE = 16_384
OFFSET_SLICE = 262_144
#: Rows of a dimension, an id and a few numbers each, that may be copied to every task. A copy is
#: built on the driver and stays there for a while: 256 bytes a row and its blocks, some 15 MB.
COPIED_ROWS = 50_000


def slice_of(column: str, size: int) -> Column:
    """Number of the fixed-size range that an integer column falls in.

    Whole-number division rounds towards zero, so the range at zero is twice as wide
    when there are negative values; ranges keep their order all the same.
    """
    return F.expr(f"{column} div {size}")


def few(rows: DataFrame, limit: int = COPIED_ROWS) -> bool:
    """Whether rows are few enough to be copied to every task; they should be a stored table."""
    return rows.limit(limit + 1).count() <= limit


def uncopied(rows: DataFrame) -> DataFrame:
    """Rows that a join must not copy to every task, as the driver would have to hold them.

    Spark takes a stored table for as large as its compressed files; in memory a set of ticks
    has a hundred times that.
    """
    return rows.hint("merge")


def spread_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    slice_by: Column,
    how: str = "inner",
    keep_slice: bool = False,
    copied: bool = False,
) -> DataFrame:
    """Many-to-one join of a large table to one row per key, without hot tasks.

    The dimension is first copied to the (key, slice) pairs that occur in the
    facts. That table has one row per slice, and the facts then join on the pair,
    so a hot key is spread over as many tasks as it has slices. Spark still
    broadcasts the pairs when they are below its size threshold. The slice stays as
    column _slice on demand, for a next step that wants the same placement.

    With ``copied`` the dimension goes to every task as it is, and the facts stay where
    they are. Whoever sets it has counted the dimension (see ``few``).
    """
    if copied:
        sliced = facts.withColumn("_slice", slice_by) if keep_slice else facts
        return sliced.join(F.broadcast(dim), key, how)
    sliced = facts.withColumn("_slice", slice_by)
    pairs = sliced.select(key, "_slice").distinct()
    pairs = pairs.join(dim, key, "inner")
    joined = sliced.join(pairs, [key, "_slice"], how)
    return joined if keep_slice else joined.drop("_slice")


def with_neighbours(
    rows: DataFrame,
    key: str,
    order: str,
    previous: Sequence[str] = (),
    following: Sequence[str] = (),
    size: int = TICK_SLICE,
) -> DataFrame:
    """Add ``prev_<c>`` / ``next_<c>``: values of the rows before and after.

    Equals ``lag`` / ``lead`` over (key, order) with order unique within the
    key, and null at either end, but the window runs over (key, slice). Each
    slice is given one extra edge row on either side, holding the values of the
    nearest row of the neighbouring slices; edge rows are dropped afterwards.
    """
    carried = sorted(set(previous) | set(following))
    sliced = rows.withColumn("_slice", slice_of(order, size))

    ends = sliced.groupBy(key, "_slice").agg(
        *[F.max_by(c, order).alias(f"_last_{c}") for c in previous],
        *[F.min_by(c, order).alias(f"_first_{c}") for c in following],
    )
    across = Window.partitionBy(key).orderBy("_slice")
    sides = []
    if previous:
        sides.append((-1, F.lag, {c: f"_last_{c}" for c in previous}))
    if following:
        sides.append((1, F.lead, {c: f"_first_{c}" for c in following}))
    parts = [sliced.withColumn("_edge", F.lit(0))]
    for edge, shift, names in sides:
        parts.append(
            ends.select(
                key,
                "_slice",
                *[shift(names[c]).over(across).alias(c) for c in carried if c in names],
                shift(F.lit(True)).over(across).alias("_present"),
            )
            .filter("_present")
            .drop("_present")
            .withColumn("_edge", F.lit(edge))
        )
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part, allowMissingColumns=True)

    within = Window.partitionBy(key, "_slice").orderBy("_edge", order)
    for c in previous:
        everything = everything.withColumn(f"prev_{c}", F.lag(c).over(within))
    for c in following:
        everything = everything.withColumn(f"next_{c}", F.lead(c).over(within))
    return everything.filter(F.col("_edge") == 0).drop("_edge", "_slice")


def running_totals(
    rows: DataFrame, key: str, order: str, totals: dict[str, Column], size: int
) -> DataFrame:
    """Add inclusive running sums over (key, order), order unique within the key."""
    sliced = rows.withColumn("_slice", slice_of(order, size))
    sums = sliced.groupBy(key, "_slice").agg(
        *[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()]
    )
    earlier = (
        Window.partitionBy(key)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = sums.select(
        key,
        "_slice",
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_carry_{name}")
            for name in totals
        ],
    )
    within = (
        Window.partitionBy(key, "_slice")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = sliced.join(carry, [key, "_slice"])
    for name, value in totals.items():
        out = out.withColumn(name, F.sum(value).over(within) + F.col(f"_carry_{name}"))
    return out.drop("_slice", *[f"_carry_{name}" for name in totals])
