"""Prefix trie of conversations by van Emde Boas recursion: sequences are cut at half depth.

A cut prefix gets a name, the hash of the names of its two halves, so that equal prefixes meet under
equal names. Going up, blocks of turns are named in pairs (the halves of ever larger tries, all of one
height at once); going down, the prefixes at the cuts are named from the prefix above and the block
between. Tries of HEIGHT turns or fewer are built directly. Totals are then grafted the same way: the
lower tries' totals onto the leaves of the upper ones, from low to high, and from the top to the rest.
A sequence of any length so takes twice log2(length / HEIGHT) rounds, and no task holds more than HEIGHT
of its turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import shared

WORD = r"[^\x20\x09-\x0D]+"
#: Height of the tries that are built directly, bytes of a name, and ids of a hashed chunk.
HEIGHT, NAME, CHUNK = 16, 16, 500


def _root() -> Column:
    return F.lit(b"")


def _name(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, NAME)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, length, turn_name, words): turns of each conversation from 0, and how many it has.

    Null turn numbers come first, turns of equal number in the order of their names; null role or text
    is empty; rows without conv_id belong to no conversation and are left out. Positions come from a range sort and
    counts per partition, so a conversation may have any number of turns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", _name(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8")).alias("turn_name"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    rows = shared.ordered_rows(slim, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_name")], "trie-turns")
    runs = rows.groupBy("_pid", "conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("_idx").alias("first"))
    one = W.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(one.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_pid", "conv_id", (before - F.col("first")).alias("base"), F.sum("n").over(one).alias("length"))
    placed = rows.join(runs, ["_pid", "conv_id"]).select("conv_id", (F.col("base") + F.col("_idx")).alias("pos"), "length", "turn_name", "words")
    placed = shared.materialize(placed, "trie-placed")
    shared.discard(rows)
    return placed


def spliced(turn: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin like the first of their group, and (conv_id, length) of all of them.

    Conversation c takes the first h turns of c - c % every and goes on with its own after its first h;
    h = crc32(decimal c) % most. At most most - 1 turns of a conversation are copied to `every` others.
    """
    taken = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    convs = turn.where("pos = 0").select("conv_id", "length", (F.col("conv_id") - F.col("conv_id") % every).alias("from"), taken.alias("h"))
    heads = turn.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1))
    sizes = heads.where("pos = 0").select(F.col("conv_id").alias("from"), F.col("length").alias("given"))
    convs = convs.join(sizes, "from", "left").withColumn("k", F.least("h", F.coalesce("given", F.lit(0))))
    convs = convs.select("conv_id", "from", "h", "k", (F.greatest(F.col("length") - F.col("h"), F.lit(0)) + F.col("k")).alias("length"))
    convs = shared.materialize(convs, "trie-convs")
    own = turn.where(F.col("pos") >= taken).drop("length").join(convs, "conv_id")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "length", "turn_name", "words")
    copied = heads.select(F.col("conv_id").alias("from"), "pos", "turn_name", "words").join(convs, "from").where(F.col("pos") < F.col("h"))
    return own.unionByName(copied.select("conv_id", "pos", "length", "turn_name", "words")), convs.select("conv_id", "length")


def _units(turn: DataFrame) -> DataFrame:
    """(conv_id, q, ends, words, names): each HEIGHT turns of a conversation; names hash the unit's first turns."""
    unit = turn.groupBy("conv_id", F.expr(f"pos div {HEIGHT}").alias("q")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn_name", "words"))).alias("t"), (F.max("pos") + 1 == F.max("length")).alias("ends")
    )
    names = F.aggregate("t.turn_name", F.array().cast("array<binary>"), lambda a, t: F.array_append(a, _name(F.coalesce(F.try_element_at(a, F.lit(-1)), _root()), t)))
    return unit.select("conv_id", "q", "ends", F.col("t.words").alias("words"), names.alias("names"))


def _cut_names(units: DataFrame, rounds: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Names of the prefixes of whole units, (conv_id, e, name), and between them, by round k, who hangs below whom.

    up[k] has the prefixes of an odd multiple of 2^k units with their beginnings 2^k units above;
    down[k] those of a multiple of 2^(k + 1) with theirs 2^k units above: (name, above), each name once.
    """
    blocks = [units.where(F.size("names") == HEIGHT).select("conv_id", F.col("q").alias("i"), F.element_at("names", -1).alias("b"))]
    for _ in range(rounds - 1):
        half = F.col("i") % 2
        pair = blocks[-1].groupBy("conv_id", F.expr("i div 2").alias("i")).agg(F.first(F.when(half == 0, F.col("b")), True).alias("l"), F.first(F.when(half == 1, F.col("b")), True).alias("r"))
        blocks.append(shared.materialize(pair.where("l is not null and r is not null").select("conv_id", "i", _name("l", "r").alias("b")), "trie-blocks"))
    named, up, down = None, [None] * rounds, [None] * rounds
    for k in reversed(range(rounds)):
        step = 1 << k
        here = blocks[k].where("i % 2 = 0").select("conv_id", (F.col("i") * step).alias("at"), "b")
        if named is None:
            here = here.select("conv_id", "at", "b", _root().alias("above"))
        else:
            here = here.join(named.select("conv_id", F.col("e").alias("at"), F.col("name").alias("above")), ["conv_id", "at"], "left")
            here = here.select("conv_id", "at", "b", F.coalesce("above", _root()).alias("above"))
        here = shared.materialize(here.select("conv_id", (F.col("at") + step).alias("e"), _name(F.lit(bytes([k])), "above", "b").alias("name"), "above"), "trie-cuts")
        up[k] = here.groupBy("name").agg(F.first("above").alias("above"))
        if named is not None:
            over = here.select("conv_id", (F.col("e") + step).alias("e"), F.col("name").alias("above"))
            down[k] = named.join(over, ["conv_id", "e"]).groupBy("name").agg(F.first("above").alias("above"))
        here = here.select("conv_id", "e", "name")
        named = here if named is None else named.union(here)
    return named, up, down


def _sum(rows: DataFrame, name: str = "name") -> DataFrame:
    return rows.groupBy(F.col(name).alias("name")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _grafted(own: DataFrame, up: list[DataFrame], down: list[DataFrame]) -> DataFrame:
    """(name, leaves, saved) of all below a cut prefix, from own: what lies in the one unit below it."""
    rounds, odd, tops = len(up), [], own
    for k in range(rounds):
        odd.append(shared.materialize(tops.join(up[k], "name"), "trie-graft"))
        tops = tops.join(up[k], "name", "left_anti").union(_sum(odd[k], "above"))
        tops = shared.materialize(_sum(tops), "trie-graft")
    whole = tops
    for k in reversed(range(rounds)):
        here = odd[k].drop("above")
        if down[k] is not None:
            here = _sum(here.union(_sum(whole.join(down[k], "name"), "above")))
        whole = whole.union(shared.materialize(here, "trie-graft"))
    return whole


def _ends_hash(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): hash of the comma-joined ids of a name, ascending.

    Ids are sorted over all tasks and joined to chunks there; a hash has to read its text in order, so
    the chunks of one name then pass through one task, a batch at a time.
    """

    def chunks(batches):
        last, ids = None, []

        def done():
            return pa.RecordBatch.from_pydict({"name": pa.array([last], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "part": [",".join(map(str, ids))]})

        for batch in batches:
            for name, i in zip(batch["name"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if ids and (name != last or len(ids) == CHUNK):
                    yield done()
                    ids = []
                last = name
                ids.append(i)
        if ids:
            yield done()

    def hashed(batches):
        last, state, out = None, None, []
        for batch in shared.in_slices(batches):
            for name, part in zip(batch["name"].to_pylist(), batch["part"].to_pylist(), strict=True):
                if name == last:
                    state.update(b"," + part.encode())
                    continue
                if state is not None:
                    out.append((last, state.hexdigest()))
                last, state = name, hashlib.sha256(part.encode())
            if out:
                yield pa.RecordBatch.from_pydict({"name": pa.array([n for n, _ in out], pa.binary()), "ends_sha256": [h for _, h in out]})
                out = []
        if state is not None:
            yield pa.RecordBatch.from_pydict({"name": pa.array([last], pa.binary()), "ends_sha256": [state.hexdigest()]})

    order = ["name", "conv_id"]
    parts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "name binary, first long, part string")
    return parts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(hashed, "name binary, ends_sha256 string")


def prefix_trie(turn: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of sequences turn(conv_id, pos, length, turn_name, words) of convs(conv_id, length), a row per node.

    name, parent (names), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (tokens that members share with another, summed over the subtree) and
    ends_sha256 of the members that end there. Positions count from 0; convs has empty sequences too.
    Without conversations there is no node. Copies meet in aggregates that tasks combine first; only the
    lookup of a parent's conversation has a row per child under the parent's name, which Spark splits where
    it is skewed.
    """
    units = shared.materialize(_units(turn), "trie-units")
    longest = convs.agg(F.max("length").alias("m"), F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n")).first()
    rounds = ((longest.m or 0) // HEIGHT).bit_length()
    start, full = _root(), F.lit(None).cast("binary")
    placed = units
    if rounds:
        cuts, up, down = _cut_names(units, rounds)
        placed = placed.join(cuts.select("conv_id", F.col("e").alias("q"), F.col("name").alias("start")), ["conv_id", "q"], "left")
        placed = placed.join(cuts.select("conv_id", (F.col("e") - 1).alias("q"), F.col("name").alias("full")), ["conv_id", "q"], "left")
        start, full = F.coalesce("start", _root()), F.col("full")
    # the last name of a whole unit is that of the cut, however the cut was reached
    names = F.transform("names", lambda p, r: F.when((r == HEIGHT - 1) & full.isNotNull(), full).otherwise(_name(F.lit(b"n"), start, p)))
    placed = placed.select("conv_id", "q", "ends", "words", start.alias("start"), names.alias("names"))
    path = placed.select("conv_id", "q", "start", "words", "names", F.posexplode("names").alias("r", "name"))
    path = path.select(
        "name", "start", "conv_id", (F.col("q") * HEIGHT + F.col("r") + 1).alias("depth"), F.expr("slice(names, 1, r + 1)").alias("line"),
        F.when(F.col("r") > 0, F.try_element_at("names", F.col("r"))).otherwise(F.col("start")).alias("parent"), F.try_element_at("words", F.col("r") + 1).alias("words"),
    )
    nodes = path.groupBy("name").agg(*[F.first(c).alias(c) for c in ("start", "depth", "line", "parent", "words")], F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = shared.materialize(nodes, "trie-nodes")
    kids = nodes.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    nodes = nodes.join(kids, "name", "left").fillna(0, ["n_children"])
    nodes = shared.materialize(nodes.withColumn("leaves", leaves).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie-nodes")
    below = _sum(nodes, "start")
    if rounds:
        below = _grafted(below, up, down)
        onto = below.select("name", F.col("leaves").alias("l"), F.col("saved").alias("s"))
        grown = nodes.join(onto, "name", "left").select("line", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
    else:
        grown = nodes
    totals = _sum(grown.select(F.explode("line").alias("name"), "leaves", "saved"))
    ends = placed.where("ends").select(F.element_at("names", -1).alias("name"), "conv_id").union(convs.where("length = 0").select(_root().alias("name"), "conv_id"))
    top = kids.where(F.col("name") == _root()).agg(F.coalesce(F.max("n_children"), F.lit(0)).alias("n_children"))
    top = top.crossJoin(below.where(F.col("name") == _root()).agg(F.max("leaves").alias("l"), F.max("saved").alias("s")))
    top = top.select(
        _root().alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(longest.c).cast("long").alias("conv_id"),
        F.lit(longest.n).cast("long").alias("n_convs"), "n_children", F.coalesce("l", F.lit(1)).alias("n_leaves"), F.coalesce("s", F.lit(0)).alias("saved_tokens"),
    ).where(F.lit(longest.n > 0))
    rest = nodes.drop("leaves", "saved").join(totals, "name").select("name", "parent", "depth", "conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    tree = rest.union(top).join(_ends_hash(ends), "name", "left").fillna(hashlib.sha256().hexdigest(), ["ends_sha256"])
    # the root's children, which may be a large part of all nodes, need no lookup and are spread by their own names
    tree = tree.withColumn("key", F.when(F.col("depth") > 1, F.col("parent")).otherwise(F.col("name")))
    tree = tree.join(nodes.select(F.col("name").alias("key"), F.col("conv_id").alias("p")), "key", "left")
    of_parent = F.when(F.col("depth") > 1, F.col("p")).when(F.col("depth") == 1, F.lit(longest.c).cast("long"))
    return tree.select("name", "parent", "conv_id", "depth", of_parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
