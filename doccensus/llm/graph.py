"""Links between nodes with common keys, and their connected components, as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccensus.llm.shared import written

#: nodes of a key up to which all pairs are taken
FEW = 16
#: nodes of a key that are kept in one row, about
BLOCK = 256


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, root: the least node of each node's component; only nodes that have an edge.

    Large-star and small-star steps in turn: every node hands its neighbours to the least of them, so all edges come to
    point at the component's least node in a number of rounds that grows with the logarithm of its diameter. Each round
    is two aggregations that reduce before the shuffle and two joins on node ids; its edges are written to the shared
    folder. Only whether it is done comes to the driver. Nodes may be of any orderable type.
    """
    pairs = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(pairs):
            break
        pairs = written(_small_star(_large_star(pairs)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _settled(pairs: DataFrame) -> bool:
    """Whether every node has one edge down, or edges up only: then all point at the least node of their component."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        pairs.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    loose = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR down > 0 AND up > 0")
    return loose.isEmpty()


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbours and itself."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are linked to the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    linked = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def colliding(banded: DataFrame) -> DataFrame:
    """Rows (node, size, key) whose key several nodes have, with the key's least node as ``a``; written once.

    The counts are reduced before the shuffle; a key that many rows have meets its leader in a join that Spark splits.
    """
    least = banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").drop("z")
    return written(banded.join(least, "key"), "shared-keys")


def _blocks(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (key, node, size, root) as blocks of a key's nodes, at most ``parts`` for each key, with their least and greatest root."""
    part = F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part")
    held = F.collect_list(F.struct("node", "size", "root")).alias("nodes")
    return rows.groupBy("key", part).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), held)


def _nodes(blocks: DataFrame) -> DataFrame:
    return blocks.select("key", F.explode("nodes").alias("r")).select("key", "r.*")


def links(
    shared: DataFrame, verify: Callable[[DataFrame], DataFrame], size_ratio: float, exact_keys: Callable[[DataFrame], DataFrame] | None = None,
    splits: Sequence[Callable[[DataFrame], DataFrame]] = (),
) -> DataFrame:
    """All verified links (a, b) between components that the nodes of ``colliding`` fall into.

    Every node is first held against the least node of each of its keys. Keys that then still hold several components
    give all pairs of nodes of different components whose sizes are within the ratio; so a link that joins two
    components is never left out, while nodes that are connected already are not paired again. Where ``exact_keys`` turns
    nodes into (node, key) such that similar nodes, and only they, have a common key, the nodes of those keys are held
    against the least node of each exact key instead, which pairs no two others. Nodes that crowded keys connect are a
    crowd; each of ``splits`` turns nodes (node, size, root, crowd) into rows (key, node, size, root) with finer keys, of
    which similar nodes of a crowd have a common one; then those are paired. A node has as many finer keys however many
    crowded ones it had, and a second split takes the place of the first where that left keys crowded.
    Keys of at most ``FEW`` nodes are not split, since their pairs are few. Where there are still many pairs for each node,
    a part of them is verified first, and of the rest the pairs that it connects are verified no more.
    """
    star = shared.filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    found = written(verify(star), "links")
    root = components(found)
    placed = shared.join(root, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("key", "n")
    rest = written(placed.join(open_keys, "key"), "open-keys")
    if exact_keys is not None:
        near = colliding(exact_keys(rest.select("node").distinct()))
        left = near.filter("node <> a").select("a", F.col("node").alias("b")).distinct()
        return found.unionByName(verify(left.join(star, ["a", "b"], "left_anti")))
    if splits:
        few, crowded = rest.filter(F.col("n") <= FEW).drop("n"), rest.filter(F.col("n") > FEW).drop("n")
        least = crowded.groupBy("key").agg(F.min("node").alias("a"))
        crowds = written(components(crowded.join(least, "key").select("a", F.col("node").alias("b"))).withColumnRenamed("root", "crowd"), "crowds")
        parts = 1 + crowds.count() // BLOCK
        nodes = crowded.select("node", "size", "root").distinct().join(crowds, "node")
        for split in splits:
            # the nodes of a key lie in blocks, so what a crowded key carries on is a few rows for each of it, not one for each node
            finer = written(_blocks(split(nodes), parts), "finer-keys")
            held = finer.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.size("nodes")).alias("n"))
            mixed = written(finer.join(held.filter("lo <> hi").select("key", "n"), "key").select("key", "part", "n", "nodes"), "mixed-keys")
            many = mixed.filter(F.col("n") > FEW)
            few, crowded = few.unionByName(_nodes(mixed.filter(F.col("n") <= FEW))), _nodes(many)
            # a part has about BLOCK nodes, each in as many keys as it has units: no group grows with the table
            ids = many.groupBy("part").agg(F.array_distinct(F.flatten(F.collect_list("nodes.node"))).alias("ids")).select(F.explode("ids").alias("node"))
            nodes = nodes.join(ids, "node", "left_semi")
        rest = written(few.unionByName(crowded), "open-keys")
    # the nodes meet the other components of their key first, so that those of one component never meet each other
    others = rest.select("key", F.col("root").alias("rb")).distinct()
    x = rest.select("key", F.col("node").alias("a"), F.col("size").alias("na"), F.col("root").alias("ra")).join(others, "key").filter("ra < rb")
    y = rest.select("key", F.col("node").alias("b"), F.col("size").alias("nb"), F.col("root").alias("rb"))
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * size_ratio - 1e-9
    left = x.join(y, ["key", "rb"]).filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = written(left.join(star, ["a", "b"], "left_anti"), "pairs")
    if not splits or left.count() <= FEW * left.select("a").distinct().count():
        return found.unionByName(verify(left))
    # a few of many pairs connect most components; of the others those between components are left
    early = F.pmod(F.xxhash64("a", "b"), F.lit(FEW)) == 0
    found = written(found.unionByName(verify(left.filter(early))), "links")
    root = components(found)
    at = lambda n: root.select(F.col("node").alias(n), F.col("root").alias(f"r{n}"))
    ends = left.filter(~early).join(at("a"), "a", "left").join(at("b"), "b", "left")
    apart = F.coalesce("ra", "a") != F.coalesce("rb", "b")
    return found.unionByName(verify(ends.filter(apart).select("a", "b")))
