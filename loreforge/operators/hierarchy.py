"""Parent-child rows of unknown depth to roots, depths, paths and descendants.

Steps, each a number of joins in the logarithm of the depth:

1. *Pointer doubling* over the nodes that have a parent gives each the ancestor 2^k links up,
   and with it depth, root and subtree size (``size_{k+1}(v) = size_k(v) + sum of size_k(u)``
   over the ``u`` exactly 2^k below ``v``). ``MOVES`` doublings share one written table.
2. Doublings in which no walk ends prove that all walks still open run into circles.
   *Cycle separation*: the image of those nodes under 2^k steps shrinks to exactly the nodes
   on circles, and the least id met on 2^k steps is the label of the circle; they become
   roots of their own.
3. *Heavy paths*: each node's largest child continues its chain, so that any walk
   to a root meets at most log2(n) chains. Chains are labelled by doubling along
   heavy links only.
4. A node's path is the concatenation of chain segments; its descendants are the
   nodes that pass its chain at its position or further down (chain intervals).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.operators.joins import HOT_ROWS, hot_key_join
from loreforge.session import counted_table, table

MOVES = 2  # doublings between two written tables


def _lookup(many: DataFrame, key: str, one: DataFrame, how: str = "left", rows: int | None = None) -> DataFrame:
    """``many`` joined on ``key`` to ``one(id, ...)``; ``id`` of ``one`` comes back as ``key``.

    ``rows``: how many rows ``many`` has at most, where known; few rows have no hot key to look for.
    """
    small = rows is not None and rows < HOT_ROWS
    return hot_key_join(many, one.withColumnRenamed("id", key), key, how, hot=[] if small else None)


def _gains(state: DataFrame, reach: int) -> DataFrame:
    """``(id, gain)``: the sizes of the nodes exactly ``reach`` links below each node."""
    return state.filter(F.col("dist") == reach).groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("gain"))


def _grown(state: DataFrame, reach: int) -> DataFrame:
    grown = state.join(_gains(state, reach), "id", "left")
    return grown.withColumn("size", F.col("size") + F.coalesce("gain", F.lit(0))).drop("gain")


def _move(state: DataFrame, reach: int, rows: int, sizes: bool) -> DataFrame:
    """One doubling: open walks go on from where they stand; one that stands at a node without a row has ended there."""
    up = state.select("id", F.col("ptr").alias("p"), F.col("dist").alias("d"), F.col("end").alias("e"), F.col("low").alias("l"))
    moved = _lookup(state.filter(~F.col("end")), "ptr", up, rows=rows).select(
        "id",
        F.coalesce("p", "ptr").alias("ptr"),
        (F.col("dist") + F.coalesce("d", F.lit(0))).alias("dist"),
        F.coalesce("e", F.lit(True)).alias("end"),
        F.least("low", "l").alias("low"),
        "size",
    )
    out = moved.unionByName(state.filter("end"))
    if sizes:  # the rows of ``out`` with the sizes that ``state`` gives
        out = out.join(_gains(state, reach), "id", "left").withColumn("size", F.col("size") + F.coalesce("gain", F.lit(0))).drop("gain")
    return out


def _climb(forest: DataFrame, rows: int, sizes: bool) -> tuple[DataFrame, int, int]:
    """``forest(id, parent)``, nodes with a parent only, to ``(id, ptr, dist, end, low, size)``, how many walks never end, and the steps taken.

    ``ptr`` is the root and ``dist`` the depth where ``end``; ``parent`` without a row is a root.
    """
    one = F.lit(1).cast("long")
    state = forest.select("id", F.col("parent").alias("ptr"), one.alias("dist"), F.lit(False).alias("end"), F.col("id").alias("low"), one.alias("size"))
    n, left, reach = rows, -1, 1
    while n not in (0, left):
        left = n
        for _ in range(MOVES):
            state = _move(state, reach, rows, sizes)
            reach *= 2
        state, n = counted_table(state, ~F.col("end"), "climb")
    return state, n, reach


def _circles(state: DataFrame, reach: int, rows: int) -> DataFrame:
    """``(id, label)`` of the nodes on circles, from walks of ``reach`` steps that all run into circles."""
    image = -1
    while True:
        on = state.select(F.col("ptr").alias("id")).distinct()
        n = on.count()
        if n == image:  # the steps since the last count only moved these nodes among themselves
            break
        image = n
        state = table(_move(state, reach, rows, False), "circle")
        reach *= 2
    ring = state.join(on, "id", "left_semi")
    while reach < image:  # no circle is longer than all nodes on circles
        ring = table(_move(ring, reach, rows, False), "circle")
        reach *= 2
    return ring.select("id", F.col("low").alias("label"))


def resolve(links: DataFrame, node: str = "id", parent: str = "parent", sizes: bool = True) -> DataFrame:
    """``(id, parent, tree_parent, root_id, tree_root, depth, size, status)`` of every node.

    ``status`` is ``tree`` (the walk ends at a node without parent), ``open`` (it ends at
    a node whose parent is not there; that node is the root) or ``cycle`` (root_id is the
    smallest id of the circle, depth the links until the first node on it). ``size`` counts
    the node and all below it; on a circle, what hangs below the node outside the circle
    (null without ``sizes``, which spares the counting). Rows with a null id are left out;
    several rows of one id count once, with the largest parent. Extra columns are ignored. An
    empty table gives an empty result.
    """
    nodes = links.filter(F.col(node).isNotNull()).groupBy(F.col(node).cast("long").alias("id")).agg(F.max(F.col(parent).cast("long")).alias("parent"))
    nodes, total = counted_table(nodes, F.lit(True), "nodes")
    known = nodes.select("id", F.lit(True).alias("known"))
    pointing = _lookup(nodes.filter(F.col("parent").isNotNull()), "parent", known, rows=total).select("id", "parent", "known")
    pointing, held = counted_table(pointing, F.col("known"), "pointing")
    forest = pointing.filter("known").select("id", "parent")
    state, endless, reach = _climb(forest, held, sizes)
    labels = None
    if endless:
        stuck = state.filter(~F.col("end"))
        labels = table(_circles(stuck, reach, endless), "labels")
        cut = forest.join(stuck.select("id"), "id", "left_semi").join(labels.select("id"), "id", "left_anti")
        again, _, after = _climb(cut, endless, sizes)
        if sizes:
            again = _grown(again, after)
        state = (_grown(state.filter("end"), reach) if sizes else state.filter("end")).unionByName(again)
    elif sizes:
        state = _grown(state, reach)
    if sizes:
        state = table(state, "climbed")
        below = state.groupBy(F.col("ptr").alias("id")).agg(F.count("*").alias("below"))
    walked = state.select("id", F.col("ptr").alias("tree_root"), F.col("dist").alias("depth"), "size")
    every = nodes.join(pointing.select("id", "known"), "id", "left").join(walked, "id", "left")
    every = every.withColumn("tree_root", F.coalesce("tree_root", "id")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    if sizes:
        every = every.join(below, "id", "left").withColumn("size", F.coalesce("size", 1 + F.coalesce("below", F.lit(0))))
    else:
        every = every.withColumn("size", F.lit(None).cast("long"))
    dangling = pointing.filter(F.col("known").isNull()).select("id", F.lit(True).alias("open"))
    out = _lookup(every, "tree_root", dangling, rows=total)
    if labels is None:
        out = out.withColumn("label", F.lit(None).cast("long"))
    else:
        out = _lookup(out, "tree_root", labels, rows=total)
    on_circle = F.col("label").isNotNull() & (F.col("id") == F.col("tree_root"))
    status = F.when(F.col("label").isNotNull(), "cycle").when(F.col("open"), "open").otherwise("tree")
    return out.select(
        "id",
        "parent",
        F.when(F.col("known") & ~on_circle, F.col("parent")).alias("tree_parent"),
        F.coalesce("label", "tree_root").alias("root_id"),
        "tree_root",
        "depth",
        "size",
        status.alias("status"),
    )


def _chains(nodes: DataFrame) -> tuple[DataFrame, int]:
    """``nodes`` with ``chain`` (the id of its head) and ``pos`` (links from the head), and their number."""
    nodes, total = counted_table(nodes, F.lit(True), "resolved")
    heavy = nodes.filter(F.col("tree_parent").isNotNull()).groupBy("tree_parent").agg(F.max_by("id", F.struct("size", -F.col("id"))).alias("id"))
    state, n, _ = _climb(heavy.select("id", F.col("tree_parent").alias("parent")), total, False)
    placed = nodes.join(state.select("id", F.col("ptr").alias("chain"), F.col("dist").alias("pos")), "id", "left")
    return placed.withColumn("chain", F.coalesce("chain", "id")).withColumn("pos", F.coalesce("pos", F.lit(0))), total


def _levels(front: DataFrame, todo: DataFrame, step, total: int) -> DataFrame:
    """All chains, from those of the roots (``front``) down: ``step(below, upper)`` says what a chain takes from the one above it.

    One round per level of chains, at most log2 of the nodes.
    """
    done = front
    while True:
        front, n = counted_table(step(todo, front), F.lit(True), "chains")
        if not n:
            return done
        done = done.unionByName(front)


def heavy_chains(links: DataFrame, node: str = "id", parent: str = "parent") -> tuple[DataFrame, DataFrame, int]:
    """``(nodes, heads, number of nodes)``: every node with its chain and position, every chain with the node ``at`` which it hangs, and that node's place."""
    nodes, total = _chains(resolve(links, node, parent))
    nodes = table(nodes, "heavy")
    heads = nodes.filter(F.col("pos") == 0).select("chain", F.col("tree_parent").alias("at"))
    where = nodes.select("id", F.col("chain").alias("above"), F.col("pos").alias("above_pos"))
    return nodes, table(_lookup(heads, "at", where, rows=total), "heads"), total


def heavy_paths(links: DataFrame, node: str = "id", parent: str = "parent") -> tuple[DataFrame, DataFrame, int]:
    """``(nodes, chains, number of nodes)``: every node with its chain and position, every chain with its prefix.

    ``chains(chain, members, segments, prefix)``: ``members`` from the head down,
    ``segments`` the ``(chain, pos)`` at which the walk from the root leaves each chain
    above, ``prefix`` the ids of those segments joined. A chain's arrays are no longer
    than the longest path, which is one value of the result anyway.
    """
    nodes, heads, total = heavy_chains(links, node, parent)
    members = nodes.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_m"))
    every = table(heads.join(members.select("chain", F.col("_m.id").alias("members")), "chain"), "chains")
    seg = "array<struct<chain:long,pos:long>>"
    front = every.filter(F.col("at").isNull()).select("chain", "members", F.array().cast(seg).alias("segments"), F.array().cast("array<long>").alias("prefix"))

    def step(todo: DataFrame, front: DataFrame) -> DataFrame:
        upper = front.select(F.col("chain").alias("id"), F.col("members").alias("m"), F.col("segments").alias("s"), F.col("prefix").alias("p"))
        return _lookup(todo, "above", upper, "inner", rows=total).select(
            "chain",
            "members",
            F.concat("s", F.array(F.struct(F.col("above").alias("chain"), F.col("above_pos").alias("pos")))).alias("segments"),
            F.concat("p", F.slice("m", F.lit(1), (F.col("above_pos") + 1).cast("int"))).alias("prefix"),
        )

    return nodes, _levels(front, every.filter(F.col("at").isNotNull()), step, total), total


def hierarchy(links: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """Every node with ``path`` (ids from the root down to it), depth, root, status and ``descendants`` (their number).

    In a ``cycle`` the path starts at the first node on the circle.
    """
    nodes, chains, total = heavy_paths(links, node, parent)
    own = F.slice("members", F.lit(1), (F.col("pos") + 1).cast("int"))
    return _lookup(nodes, "chain", chains.withColumnRenamed("chain", "id"), "inner", rows=total).select(
        "id", "parent", "root_id", "depth", "status", F.concat("prefix", own).alias("path"), (F.col("size") - 1).alias("descendants"), "chain", "pos"
    )


def located(links: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """``(id, parent, root_id, depth, status)`` of every node, root and depth from its chain and position.

    A chain takes from the one above it only two numbers, its root and how many nodes lie above
    its head, so that no row grows with the depth of the forest.
    """
    nodes, heads, total = heavy_chains(links, node, parent)
    front = heads.filter(F.col("at").isNull()).select("chain", F.col("chain").alias("top"), F.lit(0).cast("long").alias("ahead"))

    def step(todo: DataFrame, front: DataFrame) -> DataFrame:
        upper = front.select(F.col("chain").alias("id"), F.col("top").alias("t"), F.col("ahead").alias("n"))
        return _lookup(todo, "above", upper, "inner", rows=total).select("chain", F.col("t").alias("top"), (F.col("n") + F.col("above_pos") + 1).alias("ahead"))

    chains = _levels(front, heads.filter(F.col("at").isNotNull()), step, total)
    root = F.when(F.col("status") == "cycle", F.col("root_id")).otherwise(F.col("top"))
    placed = _lookup(nodes, "chain", chains.withColumnRenamed("chain", "id"), "inner", rows=total)
    return placed.select("id", "parent", root.alias("root_id"), (F.col("ahead") + F.col("pos")).alias("depth"), "status")


def descendants(links: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """``(ancestor_id, descendant_id, distance)``, one row for each node and each node above it in its tree.

    A node's walk leaves each chain at one position; its ancestors there are the chain's
    interval from the head to it.
    """
    nodes, chains, total = heavy_paths(links, node, parent)
    own = F.struct(F.col("chain"), F.col("pos"))
    passes = hot_key_join(nodes.select("id", "chain", "pos", "depth"), chains.select("chain", "segments"), "chain")
    passes = passes.select("id", "depth", F.explode(F.concat("segments", F.array(own))).alias("s")).select("id", "depth", F.col("s.chain").alias("chain"), F.col("s.pos").alias("leave"))
    inside = hot_key_join(passes, chains.select("chain", "members"), "chain")
    rows = inside.select("id", "depth", F.explode(F.slice("members", F.lit(1), (F.col("leave") + 1).cast("int"))).alias("ancestor_id"))
    above = nodes.select(F.col("id").alias("ancestor_id"), F.col("depth").alias("above_depth"))
    out = hot_key_join(rows.filter(F.col("id") != F.col("ancestor_id")), above, "ancestor_id")
    return out.select("ancestor_id", F.col("id").alias("descendant_id"), (F.col("depth") - F.col("above_depth")).alias("distance"))
