"""Operator 13, a trie of conversation prefixes whose subtree totals come from parallel tree contraction.

A node is a distinct sequence of first turns; a conversation is a member of
every node that it starts with. A prefix is named by its depth and the sums
of two 60-bit hash values of its (place, turn SHA-256) pairs, so one grouped
count over all prefixes of all conversations gives the nodes (a hundred and
twenty bits: no collision is to be expected below 10**15 nodes). The sums
run over blocks of ``BLOCK`` turns with block offsets, so a conversation with
a third of all turns is spread over many tasks. At one depth a conversation
belongs to one node, so (depth, smallest member) is a node's key from there.

Subtree totals (``subtree_sums``): rounds of rake and compress. Rake takes
every leaf off and adds its total to its parent's. Compress splices nodes
with a single child out of their chains, no two neighbours in one round: of
two neighbours the one whose depth has the lower lowest bit goes first (so a
whole chain halves each round), then the one with the smaller hash. A
spliced node's own sum goes to its parent, and its total is its sum plus its
child's total, whenever that is known. When the roots alone are left, the
rounds are undone from the last to the first and every spliced node gets its
total. Each round shrinks the tree by a constant part, so there are some
log n rounds and linear work. Every join of a round is on a key that is
unique on both sides, and sums are combined before the shuffle, so a node
with any number of children or a chain of any length is no hot key.

A node's ends are hashed in numeric order. They are joined into pieces of
``PIECE`` neighbouring ids by a grouped job; only the SHA-256 of the pieces,
a sequence by nature, streams through one task a node, holding one piece.

Edge cases: null role and text are empty; turns are ordered by (turn, role,
text), nulls first, and repeated rows are turns of their own; rows without a
conversation id belong to none and are left out; a conversation without
turns is a member of the root alone; an empty table has no nodes; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize, slices, spread
from fleetlens.operators.joins import salted_join
from fleetlens.operators.windows import assign_ordinals

BLOCK = 1024
SPREAD_CHILDREN = 256  # a parent with more children is looked up in salted copies
PIECE_BITS = 10  # a piece joins the ids of one range of 2**10
WORDS = r"[^\x20\x09-\x0D]+"
SUM = "decimal(38,0)"


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv, ordinal from 0, turn_key, words) of every turn: its place, the hash of role and text, the text's words."""
    src = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return materialize(assign_ordinals(src, "conv", "turn", tiebreak=("role", "text")).select(
        "conv", "ordinal", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256).alias("turn_key"),
        F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words")), "turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns (conv, depth from 1, turn_key, words) with the names (a, b) of the prefix that ends there and (pa, pb) of
    the one before."""
    digest = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "turn_key").cast("binary"), 256)
    part = [F.conv(F.substring("_h", at, 15), 16, 10).cast(SUM) for at in (1, 16)]
    rows = (turns.withColumn("_h", digest).withColumn("_block", F.expr(f"depth div {BLOCK}"))
            .select("conv", "depth", "words", "_block", part[0].alias("va"), part[1].alias("vb")))
    blocks = rows.groupBy("conv", "_block").agg(F.sum("va").cast(SUM).alias("sa"), F.sum("vb").cast(SUM).alias("sb"))
    earlier = W.partitionBy("conv").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast(SUM)
    offsets = blocks.select("conv", "_block", *[
        F.coalesce(F.sum(s).over(earlier), zero).cast(SUM).alias(o) for s, o in (("sa", "oa"), ("sb", "ob"))])
    local = W.partitionBy("conv", "_block").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = rows.select("conv", "depth", "words", "_block", "va", "vb",
                      F.sum("va").over(local).alias("ra"), F.sum("vb").over(local).alias("rb"))
    return run.join(offsets, ["conv", "_block"]).select(
        "conv", "depth", "words", (F.col("oa") + F.col("ra")).cast(SUM).alias("a"), (F.col("ob") + F.col("rb")).cast(SUM).alias("b"),
        (F.col("oa") + F.col("ra") - F.col("va")).cast(SUM).alias("pa"), (F.col("ob") + F.col("rb") - F.col("vb")).cast(SUM).alias("pb"))


def _ends(ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ends_sha256): the hash of the decimal ids of each group, numerically ascending, comma-joined."""
    pieces = ends.groupBy(*keys, F.shiftright("conv", PIECE_BITS).alias("_piece")).agg(
        F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("_ids"))
    pieces = spread(pieces, *keys).sortWithinPartitions(*keys, "_piece").select(
        F.struct(*keys).alias("_k"), F.concat_ws(".", *[F.col(k).cast("string") for k in keys]).alias("_name"), "_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = key = digest = None
        for b in slices(batches, 4 << 20, "_ids"):
            out = []
            for i, (now, ids) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if now == name:
                    digest.update(b"," + ids.encode())
                    continue
                if name is not None:
                    out.append((key, digest.hexdigest()))
                name, key, digest = now, b.column(0)[i].as_py(), hashlib.sha256(ids.encode())
            if out:
                yield batch(out, b.column(0).type)
            kind = b.column(0).type
        if name is not None:
            yield batch([(key, digest.hexdigest())], kind)

    def batch(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind), pa.array([h for _, h in rows], pa.string())],
                                          names=["_k", "ends_sha256"])

    key_type = pieces.schema["_k"].dataType.simpleString()
    return pieces.mapInArrow(run, f"_k {key_type}, ends_sha256 string").select(
        *[F.col(f"_k.{k}").alias(k) for k in keys], "ends_sha256")


def subtree_sums(nodes: DataFrame, node: str, parent: str, weights: Sequence[str], depth: str) -> DataFrame:
    """(node, one sum per weight) over each node's subtree, itself included, by rake and compress rounds.

    ``node`` is unique; roots have a null ``parent``, and every other parent
    is a node. ``depth`` (a node's distance from its root) only decides which
    nodes of a chain go first. The driver reads one emptiness flag a step.
    """
    sums = list(weights)
    add = [F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(f"_{s}") for s in sums]
    plus = [(F.col(s) + F.coalesce(F.col(f"_{s}"), F.lit(0))).alias(s) for s in sums]
    first = nodes.select(F.col(node).alias("id"), F.col(parent).alias("up"),
                         F.col(depth).cast("long").alias("depth"), *[F.col(s).cast("long").alias(s) for s in sums])
    kids = first.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    tree = materialize(first.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0))), "tree")
    rounds: list[tuple[DataFrame, DataFrame | None]] = []  # what each round raked, what it spliced
    rank = F.struct(F.col("depth").bitwiseAND(-F.col("depth")).alias("bit"), F.xxhash64("id").alias("hash"), F.col("id").alias("id"))
    while True:
        leaves, inner = tree.where("kids = 0"), tree.where("kids > 0")
        raked = leaves.select("id", *sums)
        if inner.isEmpty():
            rounds.append((raked, None))
            break
        # rake: a parent takes its leaves' totals, and counts and names the children that stay
        stays = F.col("kids") > 0
        of = tree.where("up is not null").groupBy(F.col("up").alias("_p")).agg(
            F.count_if(stays).alias("_kids"), F.max(F.when(stays, F.col("id"))).alias("only"),
            *[F.coalesce(F.sum(F.when(~stays, F.col(s))), F.lit(0)).cast("long").alias(f"_{s}") for s in sums])
        bare = materialize(inner.join(of, F.col("id") == F.col("_p")).select(
            "id", "up", "depth", F.col("_kids").alias("kids"), "only", *plus), "raked")
        # compress: of two neighbours with one child each, the one that ranks later stays
        unary = bare.where("kids = 1 and up is not null").select("id", "up", "only", *sums, rank.alias("rank"))
        below = unary.select(F.col("id").alias("_c"), F.col("rank").alias("_r"))
        losers = (unary.join(below, F.col("only") == F.col("_c"))
                  .select(F.greatest("rank", "_r")["id"].alias("id")).distinct())
        spliced = materialize(unary.join(losers, "id", "left_anti").drop("rank"), "spliced")
        if spliced.isEmpty():
            rounds.append((raked, None))
            tree = bare.drop("only")
            continue
        rounds.append((raked, spliced))
        moved = spliced.select(F.col("only").alias("id"), F.col("up").alias("_up"))
        given = spliced.groupBy(F.col("up").alias("id")).agg(*add)
        tree = materialize(bare.drop("only").join(spliced.select("id"), "id", "left_anti").join(moved, "id", "left")
                           .join(given, "id", "left").select("id", F.coalesce("_up", "up").alias("up"), "depth", "kids", *plus), "tree")
    # re-expand: a spliced node's total is its own sum and its child's total, known from the later rounds
    done: list[DataFrame] = []
    for raked, spliced in reversed(rounds):
        if spliced is not None:
            later = _union(done).select(F.col("id").alias("only"), *[F.col(s).alias(f"_{s}") for s in sums])
            done.append(materialize(spliced.join(later, "only").select("id", *plus), "expanded"))
        done.append(raked)
    return _union(done).select(F.col("id").alias(node), *sums)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of ``turns`` (conv, depth from 1, turn_key, words) and ``lengths`` (conv, n_turns; every conversation).

    One row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves (childless nodes of the subtree),
    saved_tokens (over the subtree, members beyond the first times words),
    ends_sha256 (of the members that end there).
    """
    every = materialize(prefixes(turns), "prefixes")
    convs = lengths.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast(SUM)
    root = convs.select(F.lit(0).cast("long").alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"),
                        F.lit(0).cast("long").alias("words"), "conv_id", "n_convs")
    found = every.groupBy("depth", "a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("words").alias("words"),
                                                 F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    named = materialize(root.unionByName(found.select(*root.columns)), "trie-nodes")
    above = [(F.col("depth") - 1).alias("_pd"), F.col("pa"), F.col("pb")]
    children = named.where("depth > 0").select("*", above[0])
    counts = materialize(children.groupBy("_pd", "pa", "pb").agg(F.count(F.lit(1)).alias("n_children")), "trie-children")
    parents = named.select(F.col("depth").alias("_pd"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                           F.col("conv_id").alias("parent_conv_id"))
    linked = salted_join(children, parents, ["_pd", "pa", "pb"], "left", hot=counts.where(F.col("n_children") > SPREAD_CHILDREN))
    columns = ["depth", "a", "b", "words", "conv_id", "n_convs", "parent_conv_id"]
    linked = linked.select(*columns).unionByName(named.where("depth = 0").withColumn(
        "parent_conv_id", F.lit(None).cast("long")).select(*columns))
    last = every.join(lengths.select("conv", F.col("n_turns").alias("depth")), ["conv", "depth"])
    ends = last.select("conv", "depth", "a", "b").unionByName(
        lengths.where("n_turns = 0").select("conv", F.lit(0).cast("long").alias("depth"), zero.alias("a"), zero.alias("b")))
    node, parent = (F.struct(d.cast("long").alias("depth"), F.col(c).alias("conv")) for d, c in
                    ((F.col("depth"), "conv_id"), (F.col("depth") - 1, "parent_conv_id")))
    trie = materialize(
        linked.join(counts.select(F.col("_pd").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children"),
                    ["depth", "a", "b"], "left")
        .join(_ends(ends, ("depth", "a", "b")), ["depth", "a", "b"], "left")
        .select(node.alias("node"), F.when(F.col("depth") > 0, parent).alias("parent"), "conv_id", "depth", "parent_conv_id", "n_convs",
                F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
                F.when(F.col("n_children").isNull(), 1).otherwise(0).alias("leaf"),
                ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "trie")
    sums = subtree_sums(trie, "node", "parent", ["leaf", "saved"], "depth").select(
        "node", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return trie.join(sums, "node").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                          "saved_tokens", "ends_sha256")
