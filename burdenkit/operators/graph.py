"""Graph jobs: closure, chains of identifiers, components, cliques."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import join_skewed
from ..functions.storage import Scratch, cut


def both_directions(edges: DataFrame) -> DataFrame:
    """(a, b, relation, contains) and the same edges turned round, with the sign of contains mirrored."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "relation", (-F.col("contains")).alias("contains"))
    return edges.select("a", "b", "relation", "contains").unionByName(turned).distinct()


def closure(start: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """id, depth of all nodes reachable from ``start`` (id) over edges (a -> b), at their least depth.

    Breadth first; each round joins only the new nodes and is cut, and nodes seen before end it, so cycles
    do no harm. Deeper than ``most`` rounds is an error.
    """
    seen = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    new = seen
    for depth in range(1, most + 1):
        step = new.join(edges, new["id"] == edges["a"]).select(F.col("b").alias("id")).distinct()
        new = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return seen
        seen = cut(seen.union(new))
    raise RuntimeError(f"more than {most} levels")


def followed(chain: DataFrame, most: int = 40) -> DataFrame:
    """(old, new) identifiers followed to the last one, by pointer jumping: each round doubles the distance.

    An old id with several new ones counts by its smallest; ids that run into a cycle are left out.
    """
    now = cut(chain.groupBy("old").agg(F.min("new").alias("new")).filter("old <> new"))
    for _ in range(most):
        nxt = now.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
        step = cut(now.join(nxt, now["new"] == nxt["_o"], "left").select("old", F.coalesce("_n", "new").alias("new"), F.col("_n").isNotNull().alias("_moved")))
        moved = step.agg(F.count_if("_moved").alias("n")).first()["n"]
        now = step.filter("old <> new").select("old", "new")
        if not moved:
            return now
    stay = now.select(F.col("old").alias("new")).distinct()
    return now.join(stay, "new", "left_anti").select("old", "new")


def _stars(batches, most: int = 1 << 20):
    """Links a, b in; out the stars of the components that each task's links make, ``most`` nodes at a time."""
    root: dict = {}

    def top(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def stars(kind):
        rows = [(top(x), x) for x in root if top(x) != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k in (0, 1)], names=["a", "b"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        if len(root) > most:
            yield stars(kind)
    if root:
        yield stars(kind)


def components(links: DataFrame, few: int = 1_000_000) -> DataFrame:
    """Connected components of links (a, b): node, root (the smallest node reachable), nodes with links only.

    Every task first contracts its own links to stars. Then large-star and small-star contraction alternate, which
    needs a number of rounds that grows with the logarithm of the component, however long its paths are; every round
    is written, so nothing is recomputed, and the one before removed. Of more than ``few`` links, a node's are dealt to many
    tasks where it has many: its smallest neighbour, all that they need, goes with them. (Fewer are no load for one task, and
    the tables that this takes would cost more.) Links with a null end take no part.
    """
    rounds = Scratch(links.sparkSession)
    own = links.filter("a <> b").select("a", "b")
    now = rounds.put("now", own.mapInArrow(_stars, own.schema).distinct())

    def with_least(rows: DataFrame, key: str, other: str, name: str, own: bool) -> tuple[DataFrame, DataFrame]:
        """``rows`` with m, the least ``other`` of their ``key`` (with ``own`` the key too), and the table key, m."""
        m = F.min(other).alias("m")
        least = rows.groupBy(key).agg(m, F.count("*").alias("_n")).select(key, F.least(key, "m").alias("m") if own else "m", "_n")
        if not spread:
            return rows.join(least.drop("_n"), key), least
        least = rounds.put(name, least)
        return join_skewed(rows, least, [key], "_n", other), least

    while True:
        # done when all are stars: no node has two roots, and no root has one
        seen = now.select(F.col("b").alias("node"), F.lit(1).alias("below")).unionByName(now.select(F.col("a").alias("node"), F.lit(0).alias("below")))
        if seen.groupBy("node").agg(F.sum("below").alias("roots"), F.min("below").alias("least")).filter("roots > 1 OR (roots > 0 AND least = 0)").isEmpty():
            break
        spread = now.count() > few
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, "a", "b", "least", True)[0].filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b")
        if spread:
            large = rounds.put("large", large.distinct())
        # now each row points from a smaller to a larger node; small-star: the larger node's smaller neighbours
        small, lowest = with_least(large.select(F.col("b").alias("u"), F.col("a").alias("v")), "u", "v", "lowest", False)
        small = small.select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").union(lowest.select(F.col("m").alias("a"), F.col("u").alias("b")))
        now = rounds.put("now", small.distinct())
    rounds.drop("least", "large", "lowest")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def undirected(links: DataFrame) -> DataFrame:
    """Each link once, a < b, without loops and null ends."""
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def peeled(edges: DataFrame) -> DataFrame:
    """node and the round in which it leaves the graph: each round takes the nodes of at most twice the mean degree left.

    At least half of the nodes leave, so rounds are as many as the logarithm of the nodes, and a node has at most four times
    as many neighbours in its own and later rounds as the densest part of the graph has edges a node.
    """
    scratch = Scratch(edges.sparkSession)
    every = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    left, out, k = scratch.put("left", edges), None, 0
    while True:
        ends = left.select(F.explode(F.array("a", "b")).alias("node"))
        degree = scratch.put("degree", ends.groupBy("node").agg(F.count("*").alias("n")))
        mean = degree.agg(F.avg("n").alias("m")).first()["m"]
        if mean is None:
            # nodes that lost all neighbours before their turn come last
            return every.withColumn("round", F.lit(k)) if out is None else every.join(out, "node", "left").select("node", F.coalesce("round", F.lit(k)).alias("round"))
        gone = scratch.put(f"gone{k}", degree.filter(F.col("n") <= 2 * mean).select("node", F.lit(k).alias("round")))
        out = gone if out is None else out.unionByName(gone)
        for end in ("a", "b"):
            left = left.join(gone.select(F.col("node").alias(end)), end, "left_anti")
        left, k = scratch.put("left", left.select("a", "b")), k + 1


def _maximal(near: dict) -> Iterator[list]:
    """Maximal cliques of an undirected graph (every node is a key): branch on vertices that the pivot does not cover."""
    stack = [([], set(near), set())]
    while stack:
        clique, maybe, never = stack.pop()
        if not maybe and not never:
            yield clique
            continue
        if not maybe:
            continue
        pivot = max(maybe | never, key=lambda x: len(near[x] & maybe))
        for x in sorted(maybe - near[pivot]):
            stack.append(([*clique, x], maybe & near[x], never & near[x]))
            maybe = maybe - {x}
            never = never | {x}


def maximal_cliques(links: DataFrame) -> DataFrame:
    """members (sorted array) of each maximal clique of links (a, b), two nodes or more.

    Nodes are ordered by rounds of peeling, so each has few later neighbours. A task per node enumerates the cliques among
    these with the edges between them. Such a clique can only grow by earlier nodes; then it is the end, in this order, of
    the larger clique that the earliest of them finds. So all proper ends of cliques are taken away, and what stays is maximal.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.put("edges", undirected(links))
    kind = edges.schema["a"].dataType
    place = scratch.put("place", peeled(edges).select("node", F.struct("round", "node").alias("at")))
    met = edges
    for end in ("a", "b"):
        degree = edges.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("_n"))
        own = scratch.put(f"own_{end}", degree.join(place, "node").select(F.col("node").alias(end), F.col("at").alias(f"at_{end}"), "_n"))
        met = join_skewed(met, own, [end], "_n", "b" if end == "a" else "a").drop("_n")
    first = F.col("at_a") < F.col("at_b")
    out = scratch.put("out", met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("v"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("u"), F.greatest("at_a", "at_b").alias("at")))
    later = scratch.put("later", out.groupBy("v").agg(F.collect_list("at").alias("near")))
    arriving = out.groupBy("u").agg(F.count("*").alias("_n"))
    groups = scratch.put("groups", arriving.join(later.select(F.col("v").alias("u"), "near"), "u", "left"))
    rows = join_skewed(out, groups, ["u"], "_n", "v").select("v", "at", "near")

    node = pa.array([], from_type(kind)).type
    schema = pa.schema([("members", pa.list_(node)), ("whole", pa.bool_())])

    def of(key: tuple, rows: pa.Table) -> pa.Table:
        order = {(r["round"], r["node"]) for r in rows["at"].to_pylist()}
        near: dict = {x: set() for x in order}
        for at, others in zip(rows["at"].to_pylist(), rows["near"].to_pylist(), strict=True):
            x = (at["round"], at["node"])
            for o in others or ():
                if (y := (o["round"], o["node"])) in near:
                    near[x].add(y)
                    near[y].add(x)
        found = []
        for clique in _maximal(near):
            ends = [x[1] for x in sorted(clique)]
            found.append((sorted([key[0].as_py(), *ends]), True))
            found += [(sorted(ends[k:]), False) for k in range(len(ends) - 1)]
        return pa.table([[x[k] for x in found] for k in (0, 1)], schema=schema)

    each = rows.groupBy("v").applyInArrow(of, f"members array<{kind.simpleString()}>, whole boolean")
    return each.groupBy("members").agg(F.bool_and("whole").alias("whole")).filter("whole").select("members")


def from_type(kind) -> pa.DataType:
    """The Arrow type of a Spark type of node ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def cliques(links: DataFrame) -> DataFrame:
    """component (its smallest node), size, members (joined by commas) of each maximal clique of links (a, b)."""
    found = maximal_cliques(links).withColumn("node", F.element_at("members", 1))
    return found.join(components(links), "node").select(F.col("root").alias("component"), F.size("members").cast("long").alias("size"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


def edge_disjoint_cliques(links: DataFrame) -> DataFrame:
    """members (sorted array) of cliques that cover every link once: greedily the largest, ties to the smallest members.

    Of the maximal cliques those are taken in parallel that no better one shares a link with; cliques that
    share one with them go, and so on; then maximal cliques of the links left, until none is. This takes the same
    cliques as going through them one by one in order.
    """
    scratch = Scratch(links.sparkSession)
    left, out, k = scratch.put("left", undirected(links)), None, 0
    rank = F.struct((-F.size("members")).alias("n"), "members").alias("rank")
    while not left.isEmpty():
        open_ = scratch.put("open", maximal_cliques(left).select(rank))
        while not open_.isEmpty():
            m = F.col("rank.members")
            pairs = F.flatten(F.transform(m, lambda x, i: F.transform(F.slice(m, i + 2, F.size(m)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
            edges = scratch.put("edges", open_.select("rank", F.explode(pairs).alias("p")).select("rank", "p.a", "p.b"))
            best = edges.groupBy("a", "b").agg(F.min("rank").alias("best"))
            mine = edges.join(best, ["a", "b"]).groupBy("rank").agg(F.bool_and(F.col("rank") == F.col("best")).alias("mine")).filter("mine").select("rank")
            taken = scratch.put(f"taken{k}", mine)
            out = taken if out is None else out.unionByName(taken)
            used = scratch.put("used", edges.join(taken, "rank", "left_semi").select("a", "b"))
            touched = edges.join(used, ["a", "b"], "left_semi").select("rank").distinct()
            open_ = scratch.put("open", open_.join(touched, "rank", "left_anti"))
            left = scratch.put("left", left.join(used, ["a", "b"], "left_anti"))
            k += 1
    return (left.select(F.array("a", "b").alias("members")) if out is None else out.select("rank.members"))
