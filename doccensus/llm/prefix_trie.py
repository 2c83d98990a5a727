"""The trie of conversation prefixes, with what sharing prefixes saves, by an Euler tour.

A node is a distinct sequence of a conversation's first turns; the root has none. A node is named by its smallest member and
its depth, since that member's first turns are the node. How it runs:

1. Turns become digests, numbered by segmented ranking. A prefix's fingerprint is the pair of sums, over its turns, of 60-bit
   words taken from SHA-256 of (depth, turn digest); prefixes are equal if their depths and fingerprints are, up to a chance
   of 2^-120 a pair. Sums run along a conversation by segmented prefix sums, so one with a third of all turns is
   spread over many tasks, and a row knows its parent's fingerprint without looking back.
2. Grouping by fingerprint gives the nodes; aggregates reduce before the shuffle, so the root costs a row a task.
3. Every node has an enter and an exit arc. An enter arc leads to the first child's, or to the own exit arc; an exit
   arc to the next sibling's enter arc, or to the parent's exit arc. Siblings are numbered by segmented ranking, as the
   root's children may be nearly all conversations.
4. ``list_ranking`` sums the weights from every arc to the end of the tour. A subtree's sums are the difference between
   its enter and its exit arc.
5. The members that end at a node are sorted over the cluster, joined to pieces of ``PIECE`` ids in the tasks that
   hold them, and only these pieces meet in order in the running digest of their node, which holds one piece at a time.

Defined cases: rows without a conversation id are left out; null role and text are empty, a null turn comes first; rows of one
turn are ordered by their digest, repeated rows count each; an empty table gives no rows, not even a root;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus.functions.common import rank_within, running_totals
from doccensus.llm.list_ranking import suffix_sums
from doccensus.llm.shared import written

#: ids of one piece of an ends list
PIECE = 256
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), told (digest of role and text), size (UTF-8 bytes of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("told"),
        F.octet_length(text).cast("long").alias("size"),
    )
    return rank_within(narrow, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("told")], "pos").select("conv_id", "pos", "told", "size")


def plain_paths(turns: DataFrame) -> DataFrame:
    """Every conversation as it is: conv_id, depth (0 for the root's row), told, size, last."""
    return graft(turns, F.col("conv_id"), F.lit(0), 0)


def graft(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Conversations whose first ``head`` turns (at most ``most``) are replaced by those of conversation ``base``.

    Both columns are functions of conv_id. A base that is absent or shorter gives what it has.
    """
    turns = written(turns, "turns")
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    told = lengths.select("conv_id", "n", base.alias("base"), head.cast("long").alias("head"))
    lent = told.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn(
        "lent", F.least("head", F.coalesce("base_n", F.lit(0)))
    ).select("conv_id", "base", "head", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("total"))
    lent = written(lent, "grafts")
    own = turns.join(lent, "conv_id").filter("pos > head").withColumn("depth", F.col("pos") - F.col("head") + F.col("lent"))
    first = turns.filter(F.col("pos") <= most).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "told", "size")
    given = lent.filter("lent > 0").join(first, "base").filter("depth <= lent")
    root = lent.withColumns({"depth": F.lit(0).cast("long"), "told": F.lit(""), "size": F.lit(0).cast("long")})
    shape = lambda df: df.select("conv_id", "depth", "told", "size", (F.col("depth") == F.col("total")).alias("last"))
    return shape(own).unionByName(shape(given)).unionByName(shape(root))


def _fingerprints(paths: DataFrame) -> DataFrame:
    """conv_id, depth, size, last, node and parent: names of the prefix and of the one before."""
    hashed = paths.withColumn("hex", F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "told"), 256))
    word = lambda i: F.when(F.col("depth") > 0, F.conv(F.substring("hex", 1 + 15 * i, 15), 16, 10)).otherwise("0").cast("decimal(20,0)")
    rows = hashed.select("conv_id", "depth", "size", "last", word(0).alias("w1"), word(1).alias("w2"))
    summed = running_totals(rows, ["conv_id"], [F.col("depth")], s1=F.col("w1"), s2=F.col("w2"))
    name = lambda *parts: F.concat_ws(".", *[p.cast("string") for p in parts])
    return summed.select(
        "conv_id", "depth", "size", "last", name(F.col("depth"), F.col("s1"), F.col("s2")).alias("node"),
        F.when(F.col("depth") > 0, name(F.col("depth") - 1, F.col("s1") - F.col("w1"), F.col("s2") - F.col("w2"))).alias("parent"),
    )


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ids of one node, in order, as strings of at most ``PIECE`` ids."""
    for frame in frames:
        change = frame["node"].ne(frame["node"].shift()).cumsum()
        part = frame.groupby(change).cumcount() // PIECE
        ids = frame["conv_id"].astype(str).groupby([change, part], sort=False).agg(",".join)
        heads = frame.groupby([change, part], sort=False).first()
        yield pd.DataFrame({"node": heads["node"].to_numpy(), "begins": heads["conv_id"].to_numpy(), "ids": ids.to_numpy()})


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest for each node of a partition whose pieces come sorted; nothing but the running digest is held."""
    node, running = None, None
    for frame in frames:
        done = []
        for name, ids in zip(frame["node"], frame["ids"], strict=True):
            if name == node:
                running.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((node, running.hexdigest()))
            node, running = name, hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["node", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(node, running.hexdigest())], columns=["node", "ends_sha256"])


def ends_digests(paths: DataFrame) -> DataFrame:
    """node, ends_sha256 of the ascending ids of the conversations that end there."""
    ends = paths.filter("last").select("node", "conv_id")
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInPandas(_pieces, "node string, begins long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "begins").mapInPandas(_digests, "node string, ends_sha256 string")


def _arcs(family: DataFrame) -> DataFrame:
    """Two arcs for each node, (conv_id, 2 * depth) entering and (conv_id, 2 * depth + 1) leaving, with their successors."""
    down, leave = F.col("depth") * 2, F.col("depth") * 2 + 1
    child, sibling, up = F.col("first_child"), F.col("next_sibling"), F.col("parent_conv_id")
    step = lambda c, at, nc, nat, *w: F.struct(c.alias("c"), at.alias("at"), nc.alias("nc"), nat.alias("nat"), *w)
    no = F.lit(0).cast("long")
    enter = step(
        F.col("conv_id"), down, F.coalesce(child, F.col("conv_id")), F.when(child.isNotNull(), down + 2).otherwise(leave),
        F.lit(1).cast("long").alias("nodes"), F.when(child.isNull(), 1).otherwise(0).cast("long").alias("leaves"), F.col("saves").alias("saved"),
    )
    out = step(
        F.col("conv_id"), leave, F.coalesce(sibling, up, no), F.when(sibling.isNotNull(), down).when(up.isNotNull(), leave - 2).otherwise(-1),
        no.alias("nodes"), no.alias("leaves"), no.alias("saved"),
    )
    return family.select(F.explode(F.array(enter, out)).alias("a")).select("a.*")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """Nodes of the trie of ``paths`` (conv_id, depth, told, size, last).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_nodes and n_leaves and saved_tokens of the subtree, ends_sha256.
    """
    named = written(_fingerprints(paths), "prefixes")
    grouped = named.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.max("parent").alias("parent")
    )
    nodes = written(grouped, "nodes")
    children = nodes.filter(F.col("parent").isNotNull())
    kids = children.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    placed = written(rank_within(children.select("parent", "conv_id", "node"), ["parent"], [F.col("conv_id")], "place"), "siblings")
    after = placed.select("parent", (F.col("place") - 1).alias("place"), F.col("conv_id").alias("next_sibling"))
    following = placed.join(after, ["parent", "place"]).select("node", "next_sibling")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    family = written(
        nodes.join(above, "parent", "left").join(kids, "node", "left").join(following, "node", "left").withColumn("saves", (F.col("n_convs") - 1) * F.col("size")),
        "family",
    )
    toured = suffix_sums(_arcs(family), ["nodes", "leaves", "saved"])
    sign = F.when(F.col("at") % 2 == 0, 1).otherwise(-1)
    subtree = toured.groupBy(F.col("c").alias("conv_id"), F.floor(F.col("at") / 2).alias("depth")).agg(
        F.sum(F.col("nodes") * sign).alias("n_nodes"), F.sum(F.col("leaves") * sign).alias("n_leaves"), F.sum(F.col("saved") * sign).alias("saved_tokens")
    )
    return family.join(subtree, ["conv_id", "depth"]).join(ends_digests(named), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "n_nodes",
    )
