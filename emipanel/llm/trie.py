"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Its name is a sum of 128-bit digests of (position, role, text), so the names of all
prefixes of a conversation are running sums and a conversation may lie in many tasks. Subtree totals come from rounds of joins:
*rake* adds every leaf to its parent, *compress* takes nodes out of unary chains, no two of them adjacent, and leaves a weighted
edge; each round shortens chains to about a half, so rounds grow with the logarithm of the tree's size, not with its depth.
Contracted nodes are then expanded again from what their edges led to.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emipanel.llm.common import rows, stored

LANES = ["lane0", "lane1", "lane2", "lane3"]
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Conversation ids joined to one string in a row before a node's digest runs over the rows.
SEGMENT_IDS = 256
#: Characters of a text that deal turns out to tasks (ties beyond them go by a digest).
HEAD_CHARS = 64


def _before(name: str, keys: list[str], order: str) -> Column:
    """Sum of the rows before this one."""
    span = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(span), F.lit(0))


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, pieces): turns have conv_id, part, place (from 1, inside the piece), role and text; a piece is what one task holds of
    a conversation, with ``before``, its turns in earlier pieces, and ``n``.

    Turns are dealt out by ranges of (conv_id, turn, role, text), so a conversation of any length is cut. Equal turns of a
    conversation go by role, then by the text's first characters, then by its digest. Rows without a conv_id are no conversation's.
    """
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = (turns.withColumn("head", F.substring("text", 1, HEAD_CHARS)).withColumn("digest", F.xxhash64("text"))
             .withColumn("row", F.monotonically_increasing_id()))
    dealt = turns.repartitionByRange("conv_id", "turn", "role", "head", "digest", "row")
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()).drop("row"), "turns")
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "head", "digest")
    pieces = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    pieces = pieces.withColumn("before", _before("n", ["conv_id"], "part"))
    return dealt.select("conv_id", "part", F.row_number().over(inside).cast("long").alias("place"), "role", "text"), pieces


def rebuilt(conversations: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, members). Conversation c begins with the first h turns of conversation c - c % block, h being the unsigned crc32 of
    its decimal id modulo ``heads``, and goes on with its own turns after its first h. ``members`` has every conv_id once, also those
    left without turns. Turns have conv_id, part, pos (from 1), role and text. The remainder has the sign of c, as in SQL.
    """
    turns, pieces = numbered_turns(conversations)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    sizes = pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))
    members = stored(sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base")), "members")
    base = members.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = members.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("kept"))
    placed = pieces.join(head.select("conv_id", "h", "kept"), "conv_id").select("conv_id", "part", "before", "h", "kept")
    at = F.col("before") + F.col("place")
    placed_turns = turns.join(placed, ["conv_id", "part"])
    own = placed_turns.where(at > F.col("h")).select("conv_id", "part", (F.col("kept") + at - F.col("h")).alias("pos"), "role", "text")
    first = placed_turns.where(at < heads).select(F.col("conv_id").alias("base"), at.alias("pos"), "role", "text")
    borrowed = (head.filter("kept > 0").join(first, "base").where(F.col("pos") <= F.col("kept"))
                .select("conv_id", F.lit(-1).alias("part"), "pos", "role", "text"))
    return own.unionByName(borrowed), members.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, depth, the name of the prefix that ends with it (lane0..3), the name without it (up0..3) and the
    words of its text. Lanes are sums of 32-bit numbers, so they don't overflow."""
    tagged = F.md5(F.concat_ws(":", F.col("pos"), F.octet_length("role"), F.concat("role", "text")))
    lanes = [F.conv(F.substring(tagged, 8 * i + 1, 8), 16, 10).cast("long").alias(lane) for i, lane in enumerate(LANES)]
    turns = turns.select("conv_id", "part", "pos", F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long").alias("words"), *lanes)
    sums = turns.groupBy("conv_id", "part").agg(*[F.sum(lane).alias(lane) for lane in LANES])
    sums = sums.select("conv_id", "part", *[_before(lane, ["conv_id"], "part").alias(f"{lane}_before") for lane in LANES])
    running = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = turns.join(sums, ["conv_id", "part"]).select(
        "conv_id", F.col("pos").alias("depth"), "words",
        *[(F.sum(lane).over(running) + F.col(f"{lane}_before")).alias(f"{lane}_sum") for lane in LANES], *LANES)
    return named.select("conv_id", "depth", "words", *[F.col(f"{lane}_sum").alias(lane) for lane in LANES],
                        *[(F.col(f"{lane}_sum") - F.col(lane)).alias(lane.replace("lane", "up")) for lane in LANES])


def id_digests(ended: DataFrame, keys: list[str], value: str = "conv_id") -> DataFrame:
    """SHA-256 of the ascending decimal values of each key, comma-joined: keys and ends_sha256.

    Values are sorted by ranges and joined to strings of SEGMENT_IDS each where they lie; a key's digest then reads those strings
    in order, so it holds one batch of them whatever the key's size. The digest itself is a sequence by definition.
    """
    ended = ended.select(*keys, F.col(value).alias("value"))
    spread = ended.repartitionByRange(*keys, "value").sortWithinPartitions(*keys, "value").withColumn("part", F.spark_partition_id())
    named = [f.simpleString().replace(":", " ", 1) for f in spread.select(*keys).schema]
    wide = len(keys)

    def join_ids(batches):
        held, ids, count, part, schema = None, [], 0, 0, None
        for batch in batches:
            schema = schema or pa.schema([*[batch.schema.field(i) for i in range(wide)], pa.field("part", pa.int32()), pa.field("at", pa.int64()), pa.field("ids", pa.string())])
            part = batch.column(wide + 1)[0].as_py() if batch.num_rows else part
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if row[:wide] != held or len(ids) == SEGMENT_IDS:
                    if ids:
                        out.append((*held, part, count, ",".join(map(str, ids))))
                        count += 1
                    held, ids = row[:wide], []
                ids.append(row[wide])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if ids:
            last = (*held, part, count, ",".join(map(str, ids)))
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(last, schema)], schema=schema)

    joined = spread.mapInArrow(join_ids, ", ".join([*named, "part int", "at bigint", "ids string"]))
    ordered = joined.repartition(*keys).sortWithinPartitions(*keys, "part", "at")

    def digest(batches):
        held, running, schema = None, None, None
        for batch in batches:
            schema = schema or pa.schema([*[batch.schema.field(i) for i in range(wide)], pa.field("ends_sha256", pa.string())])
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:wide] != held:
                    if running is not None:
                        out.append((*held, running.hexdigest()))
                    held, running = row[:wide], hashlib.sha256(row[-1].encode())
                else:
                    running.update(b"," + row[-1].encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if running is not None:
            yield rows(schema, **{f.name: [v] for f, v in zip(schema, (*held, running.hexdigest()))})

    return ordered.mapInArrow(digest, ", ".join([*named, "ends_sha256 string"]))


def subtree_totals(tree: DataFrame, values: list[str], priority: Column | None = None) -> DataFrame:
    """Totals of ``values`` over every node's subtree, the node included: node and the values, by parallel tree contraction.

    ``tree`` has node (any type that compares), parent (null for a root; several roots may be there), children (their number) and
    the values. ``priority`` decides which node of a unary chain is taken out first; neighbours with different ones are best.

    A round: leaves give their totals to their parents, which sums them before the shuffle, and are done. Of the nodes left
    with one child, those whose priority is above both neighbours' in the chain are taken out: the child's edge now leads to
    the grandparent and carries what was skipped. All joins are by node, each of which occurs once on both sides.
    """
    # one number, the priority in its upper bits; neighbours that happen to be equal wait for a later round
    rank = F.shiftleft((priority if priority is not None else F.lit(0)).cast("long"), 48) + F.shiftrightunsigned(F.xxhash64("node"), 16)
    edge = {v: f"edge_{v}" for v in values}
    state = stored(tree.select("node", "parent", F.col("children").cast("long").alias("children"), rank.alias("rank"), *values,
                               *[F.lit(0).cast(tree.schema[v].dataType).alias(edge[v]) for v in values], F.lit("active").alias("status"),
                               F.col("node").alias("kid")), "contract")
    rounds = [state]
    while not (active := state.filter("status = 'active'")).isEmpty():
        leaf = F.col("children") == 0
        given = active.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            *[F.coalesce(F.sum(F.when(leaf, F.col(v) + F.col(edge[v]))), F.lit(0)).alias(f"given_{v}") for v in values],
            F.count_if(~leaf).alias("rest"), F.max(F.when(~leaf, F.col("node"))).alias("only"))
        # what the joins below read several times is written first: nested, they would plan every join before them twice over
        inner = stored(active.where(~leaf).join(given, "node").select(
            "node", "parent", F.col("rest").alias("children"), "rank", *[(F.col(v) + F.col(f"given_{v}")).alias(v) for v in values],
            *edge.values(), F.col("only").alias("kid"), ((F.col("rest") == 1) & F.col("parent").isNotNull()).alias("unary")), "inner")
        down = inner.filter("unary").select(
            F.col("kid").alias("node"), F.col("rank").alias("rank_above"), F.col("parent").alias("grandparent"),
            *[(F.col(v) + F.col(edge[v])).alias(f"skipped_{v}") for v in values])
        told = inner.join(down, "node", "left")
        up = told.filter("rank_above is not null").select(
            F.col("parent").alias("node"), F.when(F.col("unary"), F.col("rank")).alias("rank_below"), *[F.col(edge[v]).alias(f"below_{v}") for v in values])
        told = told.join(up, "node", "left")
        above_both = F.coalesce(F.col("rank") > F.col("rank_above"), F.lit(True)) & F.coalesce(F.col("rank") > F.col("rank_below"), F.lit(True))
        told = stored(told.withColumn("out", F.col("unary") & above_both), "told")
        gone = told.filter("out").select(F.col("kid").alias("node"), F.lit(True).alias("bridged"))
        told = told.join(gone, "node", "left").withColumn("bridged", F.coalesce("bridged", F.lit(False)))
        next_state = told.select(
            "node", F.when(F.col("bridged"), F.col("grandparent")).otherwise(F.col("parent")).alias("parent"), "children", "rank",
            # a node that is taken out keeps what its total has beyond its child's
            *[(F.col(v) + F.when(F.col("out"), F.col(f"below_{v}")).otherwise(F.lit(0))).alias(v) for v in values],
            *[(F.col(edge[v]) + F.when(F.col("bridged"), F.col(f"skipped_{v}")).otherwise(F.lit(0))).alias(edge[v]) for v in values],
            F.when(F.col("out"), "spliced").otherwise("active").alias("status"), "kid")
        raked = active.where(leaf).withColumn("status", F.lit("raked"))
        state = stored(next_state.unionByName(raked), "contract")
        rounds.append(state)
    # one table of all rounds keeps the plans that follow small
    everything = stored(reduce(DataFrame.unionByName, [r.filter("status <> 'active'") for r in rounds]), "contracted")
    done = everything.filter("status = 'raked'").select("node", *values)
    spliced = everything.filter("status = 'spliced'").select("node", "kid", *values)
    # a spliced node's child was spliced in a later round or raked: follow the first kind, twice as far each time
    reach = 1
    while reach < len(rounds) - 1:
        spliced = stored(spliced, "expand")
        ahead = spliced.select(F.col("node").alias("kid"), F.col("kid").alias("next"), *[F.col(v).alias(f"next_{v}") for v in values])
        spliced = spliced.join(ahead, "kid", "left").select(
            "node", F.coalesce("next", "kid").alias("kid"), *[(F.col(v) + F.coalesce(f"next_{v}", F.lit(0))).alias(v) for v in values])
        reach *= 2
    spliced = stored(spliced, "expand")
    ends = done.select(F.col("node").alias("kid"), *[F.col(v).alias(f"end_{v}") for v in values])
    expanded = spliced.join(ends, "kid").select("node", *[(F.col(v) + F.col(f"end_{v}")).alias(v) for v in values])
    return done.unionByName(expanded)


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of the trie over ``turns`` (conv_id, part, pos, role, text) of ``members`` (conv_id, each once).

    Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Nodes are
    named by (conv_id, depth). Without members there are no nodes. Members without turns end at the root, which has no text.
    """
    ups = [lane.replace("lane", "up") for lane in LANES]
    named = stored(prefixes(turns), "prefixes")
    nodes = named.groupBy("depth", *LANES).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
                                               *[F.min(up).alias(up) for up in ups])
    zero = [F.lit(0).cast("long").alias(c) for c in (*LANES, *ups)]
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), *zero[:4], "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), *zero[4:])
    nodes = stored(nodes.unionByName(root), "nodes")
    # the smallest member of a node passes through the parent, which many nodes may share: Spark can split that side
    above = nodes.select(F.col("depth").alias("depth_above"), *[F.col(lane).alias(up) for lane, up in zip(LANES, ups)], F.col("conv_id").alias("parent_conv_id"))
    hung = nodes.withColumn("depth_above", F.col("depth") - 1).join(above, ["depth_above", *ups], "left")
    hung = stored(hung.select("conv_id", "depth", "parent_conv_id", "n_convs", "words", *LANES), "hung")
    node = F.struct("conv_id", "depth")
    counts = hung.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    hung = hung.join(counts, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    hung = stored(hung, "counted")
    parent = F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))
    # depths in a chain follow each other: odd ones go first, then those divisible by two and no more, and so on
    evenness = -F.bit_count(F.col("depth").bitwiseXOR(F.col("depth") - 1))
    tree = hung.select(node.alias("node"), parent.alias("parent"), F.col("n_children").alias("children"), evenness.alias("evenness"),
                       F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"], F.col("evenness")).select("node.conv_id", "node.depth", "n_leaves", "saved_tokens")
    last = named.groupBy("conv_id").agg(F.max_by(F.struct("depth", *LANES), "depth").alias("last"))
    ended = members.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"last.{c}", F.lit(0).cast("long")).alias(c) for c in ("depth", *LANES)])
    digests = id_digests(ended, ["depth", *LANES])
    none = hashlib.sha256(b"").hexdigest()
    return (hung.join(totals, ["conv_id", "depth"]).join(digests, ["depth", *LANES], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))


def prefix_trie(conversations: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuilt``). Turns are ordered by turn, null first; a null role or text is empty.

    Repeated rows are turns of their own. Columns beside conv_id, turn, role and text are not read. An empty table gives no rows.
    Nothing is gathered: long conversations, common first turns and groups of equal conversations are cut or summed where they lie.
    """
    turns, members = rebuilt(conversations, block, heads)
    return trie(stored(turns, "rebuilt"), members)
