"""The prefix trie of conversations, measured by an Euler tour.

A node is a distinct sequence of first turns, named by its smallest member conversation and
its depth. The tour enters and leaves every node; children follow in the order of their
names. Its arcs form a linked list, which is ranked without walking it in one place:

1. The nodes that one conversation names are a path, so their enter arcs are one run, and
   their exit arcs fall into runs that end where a next sibling follows. Runs are counted
   by sums over (conversation, depth slice), so a very long conversation is spread.
2. The list of runs is ranked by ruling sets: some runs, chosen by hash, are rulers; the
   others find the ruler before them by pointer doubling; the rulers form a shorter list,
   ranked in the same way, down to a bounded rest that is walked.
3. Arc positions are dense. Prefix sums of leaves and savings over them, by slices of
   positions, give those of a subtree as the difference between exit and enter.

Turns are numbered by a global sort, so no conversation has to fit in a task. A prefix is
known by two sums of 64-bit hashes of (depth, turn); equal sums count as equal prefixes.
"""

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.llm.tables import ship, stored
from ticklane.plans.spread import running_totals, slice_of, spread_join, with_neighbours

#: Rows of a slice of turns, depths or arc positions.
SLICE = 16_384
#: One run in so many is a ruler.
RULER_SHARE = 8
#: A list of at most so many runs is walked.
WALKED = 10_000
#: Conversation ids of a chunk of a digest, and the parts that children of a node are dealt to.
CHUNK, PARTS = 4_096, 64
_WORDS = r"[^\x20\x09-\x0D]+"
_DENSE = (1 << 33) - 1


def numbered(rows: DataFrame, order: list, keep: list[str], name: str) -> DataFrame:
    """The columns in keep and pos, the place in the order from 0, by a range-sorted copy.

    Only the row count of each sorted part is brought together.
    """
    sorted_rows = rows.orderBy(*order).select(*keep, F.monotonically_increasing_id().alias("_at"))
    kept = stored(sorted_rows, name).withColumn("_part", F.shiftright("_at", 33))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    placed = kept.join(F.broadcast(firsts), "_part")  # a row for each part of the sort
    return placed.select(*keep, (F.col("_first") + F.col("_at").bitwiseAND(F.lit(_DENSE))).alias("pos"))


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the one it belongs to."""
    return F.crc32(conv_id.cast("string")) % 4


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): turns (conv_id, d, t1, t2, words, is_end), convs (conv_id, length).

    d counts from 1. Each conversation c starts with the first h turns of c - c % 20, if
    there are such, and goes on with its own after its first h. A null role or text is empty;
    turns go by turn (null first), then role and text; repeated rows are turns of their own;
    rows without conv_id are left out. Other columns are not read.
    """
    text = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    hashed = text.withColumns(
        {
            "t1": F.xxhash64(F.lit(1), "role", "text"),
            "t2": F.xxhash64(F.lit(2), "text", "role"),
            "words": F.regexp_count("text", F.lit(_WORDS)).cast("long"),
        }
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    rows = numbered(hashed, order, ["conv_id", "t1", "t2", "words"], "trie-turns")
    convs = rows.groupBy("conv_id").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    convs = convs.withColumns({"h": shared_turns(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % 20})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = stored(convs.select("conv_id", "first", "h", "base", "taken", length.alias("length")), "trie-conversations")

    own = spread_join(rows, convs.drop("base"), "conv_id", slice_of("pos", SLICE)).withColumn("i", F.col("pos") - F.col("first"))
    turn = ["t1", "t2", "words", (F.col("d") == F.col("length")).alias("is_end")]
    later = own.filter("i >= h").withColumn("d", F.col("taken") + F.col("i") - F.col("h") + 1).select("conv_id", "d", *turn)
    heads = own.filter("i < 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "i", "t1", "t2", "words")
    lent = convs.filter("taken > 0").join(heads, "base").filter("i < h").withColumn("d", F.col("i") + 1).select("conv_id", "d", *turn)
    return stored(lent.unionByName(later), "trie-rebuilt"), convs.select("conv_id", "length")


def _key(depth, one, two) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, one, two)))


def _root() -> Column:
    return _key(F.lit("0"), F.lit("0"), F.lit("0"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns with key, which stands for all turns up to this one, and parent, that of the one before."""
    x1, x2 = F.xxhash64("d", "t1", "t2").cast("decimal(20,0)"), F.xxhash64(F.lit(5), "t2", "d", "t1").cast("decimal(20,0)")
    sums = running_totals(turns, "conv_id", "d", {"s1": x1, "s2": x2}, SLICE)
    return sums.select(
        "conv_id", F.col("d").alias("depth"), "words", "is_end",
        _key(F.col("d").cast("string"), F.col("s1").cast("string"), F.col("s2").cast("string")).alias("key"),
        _key((F.col("d") - 1).cast("string"), (F.col("s1") - x1).cast("string"), (F.col("s2") - x2).cast("string")).alias("parent"),
    )


def _digested(frames):
    """SHA-256 of the chunks of each key, which follow each other; one state at a time."""
    open_key, state = None, None
    for frame in frames:
        done = []
        for key, ids in zip(frame.key, frame.ids):
            if key == open_key:
                state.update(b"," + ids.encode())
                continue
            if open_key is not None:
                done.append((open_key, state.hexdigest()))
            open_key, state = key, hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if open_key is not None:
        yield pd.DataFrame([(open_key, state.hexdigest())], columns=["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) from (key, conv_id): the digest of the ascending ids, comma-joined.

    Ids are joined in chunks of a fixed id range; a digest takes its chunks one by one.
    """
    ship(ends.sparkSession)
    chunk = F.floor(F.col("conv_id") / F.lit(CHUNK)).alias("chunk")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    chunks = ends.groupBy("key", chunk).agg(ids).repartition("key").sortWithinPartitions("key", "chunk")
    return chunks.select("key", "ids").mapInPandas(_digested, "key binary, ends_sha256 string")


def _walk(links: pd.DataFrame, head: str) -> pd.DataFrame:
    after = dict(zip(links["id"], zip(links["next"], links["size"])))
    at, before, out = head, 0, []
    while at in after:
        out.append((at, before))
        at, size = after[at]
        before += int(size)
    return pd.DataFrame(out, columns=["id", "before"])


def ranked(links: DataFrame, head: str, walked: int = WALKED, level: int = 0) -> DataFrame:
    """(id, before): the summed sizes of the list's entries before each.

    links: a stored table (id string, next string, size long), one list that starts at head;
    the last entry's next is null.
    """
    if links.count() <= walked:
        return links.sparkSession.createDataFrame(_walk(links.toPandas(), head), "id string, before long")

    def is_ruler(name):
        return (F.pmod(F.xxhash64(F.lit(level), F.col(name)), F.lit(RULER_SHARE)) == 0) | (F.col(name) == head)

    # Each entry points to the one before it, and jumps on until that is a ruler.
    back = links.filter("next is not null").select(F.col("next").alias("id"), F.col("id").alias("to"), F.col("size").alias("gap"))
    state = stored(back.withColumn("done", is_ruler("to")), "trie-jumps")
    while not state.filter("not done").isEmpty():
        target = state.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("gap").alias("gap2"), F.col("done").alias("done2"))
        moved = state.filter("not done").join(target, "to").select("id", F.col("to2").alias("to"), (F.col("gap") + F.col("gap2")).alias("gap"), F.col("done2").alias("done"))
        state = stored(state.filter("done").unionByName(moved), "trie-jumps")
    ruler_links = state.filter(is_ruler("id")).select(F.col("to").alias("id"), F.col("id").alias("next"), F.col("gap").alias("size"))
    last = links.filter(is_ruler("id")).select("id").join(ruler_links.select("id"), "id", "left_anti")
    shorter = stored(ruler_links.unionByName(last.selectExpr("id", "cast(null as string) next", "0L size")), "trie-rulers")
    rulers = ranked(shorter, head, walked, level + 1)
    rest = state.filter(~is_ruler("id")).join(rulers.select(F.col("id").alias("to"), "before"), "to")
    return rulers.unionByName(rest.select("id", (F.col("before") + F.col("gap")).alias("before")))


def _run(kind: str, conv_id: str, segment: Column | None = None) -> Column:
    """Name of a run: the enter arcs of a conversation's nodes, or a segment of their exit arcs."""
    return F.concat_ws(":", F.lit(kind), F.col(conv_id).cast("string"), *([] if segment is None else [segment.cast("string")]))


def _nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(key, parent, conv_id, depth, n_convs, words) of every node, the root among them."""
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(_root().alias("key"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    below = turns.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").cast("long").alias("depth"),
        F.count("*").alias("n_convs"), F.min("words").alias("words"),
    )
    return root.unionByName(below)


def _toured(nodes: DataFrame) -> DataFrame:
    """Nodes with what the tour needs: next sibling, first child, segment, parent's name and segment."""
    kept = ["key", "parent", "conv_id", "depth", "n_convs", "words"]
    in_order = numbered(nodes, [F.asc_nulls_first("parent"), "conv_id"], kept, "trie-siblings").withColumn("all", F.lit(0))
    siblings = with_neighbours(in_order, "all", "pos", following=["parent", "conv_id"], size=SLICE)
    next_conv = F.when(F.col("next_parent") == F.col("parent"), F.col("next_conv_id")).alias("next_conv")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    paths = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"))
    found = siblings.select(*kept, next_conv).join(children, "key", "left").fillna(0, ["n_children"])
    found = spread_join(found, paths, "conv_id", slice_of("depth", SLICE))
    # Exit arcs of a path, from its end up, are cut above each node that ends a segment.
    ends = F.when((F.col("depth") == F.col("top")) | F.col("next_conv").isNotNull(), 1).otherwise(0)
    cut = stored(running_totals(found, "conv_id", "depth", {"segment": ends}, SLICE), "trie-nodes")
    above = cut.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("segment").alias("parent_segment"))
    return stored(spread_join(cut, above, "parent", F.pmod(F.xxhash64("conv_id"), F.lit(PARTS)), "left"), "trie-toured")


def _positions(toured: DataFrame, walked: int) -> DataFrame:
    """Nodes with the places of their enter and exit arcs in the tour."""
    segments = toured.groupBy("conv_id", "segment").agg(
        F.max("depth").alias("start"), F.count("*").alias("size"),
        F.min_by(F.struct("next_conv", "parent_conv_id", "parent_segment"), "depth").alias("end"),
    )
    segments = segments.withColumn("id", _run("x", "conv_id", F.col("segment")))
    up = F.when(F.col("end.next_conv").isNotNull(), F.concat_ws(":", F.lit("e"), F.col("end.next_conv").cast("string")))
    up = up.when(F.col("end.parent_conv_id").isNotNull(), F.concat_ws(":", F.lit("x"), F.col("end.parent_conv_id").cast("string"), F.col("end.parent_segment").cast("string")))
    exits = segments.select("id", up.alias("next"), "size")
    paths = toured.groupBy("conv_id").agg(F.min("depth").alias("top"), F.count("*").alias("size"), F.max_by(F.struct("first_child", "segment"), "depth").alias("low"))
    down = F.when(F.col("low.first_child").isNotNull(), F.concat_ws(":", F.lit("e"), F.col("low.first_child").cast("string"))).otherwise(_run("x", "conv_id", F.col("low.segment")))
    enters = paths.select(_run("e", "conv_id").alias("id"), down.alias("next"), "size")
    links = stored(enters.unionByName(exits), "trie-runs")
    head = toured.filter("depth = 0").select(_run("e", "conv_id")).first()
    places = stored(ranked(links, head[0], walked) if head else links.select("id", F.lit(0).cast("long").alias("before")), "trie-ranks")

    enter_at = paths.select("conv_id", _run("e", "conv_id").alias("id"), "top").join(places, "id").select("conv_id", (F.col("before") - F.col("top")).alias("enter_base"))
    exit_at = segments.select("id", "conv_id", "segment", "start").join(places, "id").select("id", "conv_id", "segment", (F.col("before") + F.col("start")).alias("exit_base"))
    bases = spread_join(exit_at, enter_at, "conv_id", slice_of("segment", SLICE)).select("id", "enter_base", "exit_base")
    placed = spread_join(toured.withColumn("id", _run("x", "conv_id", F.col("segment"))), bases, "id", slice_of("depth", SLICE))
    return placed.withColumns({"enter": F.col("enter_base") + F.col("depth"), "exit": F.col("exit_base") - F.col("depth")})


def trie(conversations: DataFrame, walked: int = WALKED) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    saved_tokens sums (members - 1) * words of the last text over the subtree; ends_sha256 is
    of the ids of the conversations that end at the node, ascending. Odd rows are as rebuilt()
    says; conversations without turns count at the root; without conversations there is no node.
    """
    turns, convs = rebuilt(conversations)
    rows = prefixes(turns)
    ends = rows.filter("is_end").select("key", "conv_id").unionByName(convs.filter("length = 0").select(_root().alias("key"), "conv_id"))
    nodes = stored(_nodes(rows, convs), "trie-prefixes")
    placed = _positions(_toured(nodes), walked).join(end_digests(ends), "key", "left")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    own = {"leaves": leaf, "saved": (F.col("n_convs") - 1) * F.col("words")}
    facts = ["parent_conv_id", "n_convs", "n_children", "ends_sha256"]
    node = stored(placed.withColumns(own).select("conv_id", "depth", *facts, "enter", "exit", *own), "trie-placed")
    empty = {"leaves": F.lit(0), "saved": F.lit(0).cast("long")} | {c: F.lit(None).cast(node.schema[c].dataType) for c in facts}
    enter = node.drop("exit").withColumn("is_exit", F.lit(False)).withColumnRenamed("enter", "at")
    leave = node.withColumns(empty).drop("enter").withColumn("is_exit", F.lit(True)).withColumnRenamed("exit", "at")
    arcs = enter.unionByName(leave).withColumn("tour", F.lit(0))
    sums = running_totals(arcs, "tour", "at", {"leaves_to": F.col("leaves"), "saved_to": F.col("saved")}, SLICE)

    def within(total, weight):
        return F.sum(F.when(F.col("is_exit"), F.col(total)).otherwise(F.col(weight) - F.col(total))).cast("long")

    return sums.groupBy("conv_id", "depth").agg(
        *[F.max(c).alias(c) for c in facts[:-1]],
        within("leaves_to", "leaves").alias("n_leaves"),
        within("saved_to", "saved").alias("saved_tokens"),
        F.coalesce(F.max("ends_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
