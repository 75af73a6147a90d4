"""Spanning trees, subtree sums and bridges of networks of any shape, in logarithmic rounds of joins.

1. *Spanning forest.* Each part takes its outgoing edge of least hash, parts that meet are one; parts at least
   halve a round.
2. *Euler tour.* Every tree edge is two arcs; the arc after u -> v leaves v for its next neighbour after u. Places
   on the tour come by pointer doubling.
3. *Subtrees.* The arc of an edge that stands first leads down. What lies between an edge's arcs is its subtree, so
   sums of nodes are differences of prefix sums along the tour.
4. *Bridges.* Every edge beside the tree adds a random number at one end and takes it away at the other; over a
   subtree these cancel only if no such edge leaves it. Numbers are 62-bit hashes of edges, so a false cancellation
   has a probability of about 2 ** -62 an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspan.operators.stored import stored

#: Arcs in one block of a prefix sum.
BLOCK = 8192


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tree edges ``id, a, b`` and ``node, part`` of edges ``id, a, b``; loops and further parallel edges are no tree edges."""
    e = stored(edges.where("a <> b").select("id", "a", "b"), "forest-edges")
    part = stored(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("part", F.col("node")), "forest-parts")
    tree = e.limit(0)
    out = e.withColumn("pa", F.col("a")).withColumn("pb", F.col("b"))
    while True:
        ends = F.explode(F.array(F.struct(F.col("pa").alias("part"), F.col("pb").alias("other")), F.struct(F.col("pb").alias("part"), F.col("pa").alias("other")))).alias("s")
        best = out.select(ends, F.struct(F.xxhash64("id").alias("h"), "id", "a", "b").alias("e")).groupBy("s.part").agg(F.min_by(F.struct("s.other", "e"), "e").alias("m"))
        chosen = stored(best.select("part", F.col("m.other").alias("up"), F.col("m.e.id").alias("id"), F.col("m.e.a").alias("a"), F.col("m.e.b").alias("b")), "forest-chosen")
        if chosen.isEmpty():
            break
        tree = stored(tree.unionByName(chosen.select("id", "a", "b").distinct()), "forest-tree")
        # Two parts that chose one edge: the lesser is the root of what meets there.
        back = chosen.select(F.col("part").alias("up"), F.col("up").alias("_uu"))
        up = chosen.select("part", "up").join(back, "up", "left").select("part", F.when((F.col("_uu") == F.col("part")) & (F.col("part") < F.col("up")), F.col("part")).otherwise(F.col("up")).alias("up"))
        roots = _doubled(up)
        part = stored(part.join(roots.withColumnsRenamed({"part": "_p", "up": "_root"}), F.col("part") == F.col("_p"), "left").select("node", F.coalesce("_root", "part").alias("part")), "forest-parts")
        to = roots.withColumnsRenamed({"part": "_p", "up": "_root"})
        moved = out.join(to, F.col("pa") == F.col("_p"), "left").withColumn("pa", F.coalesce("_root", "pa")).drop("_p", "_root")
        moved = moved.join(to, F.col("pb") == F.col("_p"), "left").withColumn("pb", F.coalesce("_root", "pb")).drop("_p", "_root")
        out = stored(moved.where("pa <> pb"), "forest-out")
    return tree, part


def _doubled(up: DataFrame) -> DataFrame:
    """``part, up`` with pointers that lead to roots (which point at themselves)."""
    up = stored(up, "pointers")
    while True:
        on = up.select(F.col("part").alias("up"), F.col("up").alias("_next"))
        jumped = stored(up.join(on, "up").select("part", F.col("_next").alias("up"), (F.col("up") == F.col("_next")).alias("_done")), "pointers")
        if jumped.where("NOT _done").isEmpty():
            return jumped.drop("_done")
        up = jumped.drop("_done")


def tour(tree: DataFrame, part: DataFrame) -> DataFrame:
    """``part, id, u, v, place``: arcs of each tree in the order of a walk around it, from the node that names its part."""
    arcs = tree.select("id", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("s")).select("id", "s.*")
    own = Window.partitionBy("u").orderBy("v")
    # The walk turns at u from v to the next neighbour, and from the last to the first.
    turned = arcs.withColumn("_w", F.coalesce(F.lead("v").over(own), F.min("v").over(Window.partitionBy("u"))))
    following = turned.select(F.col("v").alias("_u"), F.col("u").alias("_v"), F.col("u").alias("nu"), F.col("_w").alias("nv"))  # after (v, u) comes (u, w)
    linked = arcs.join(following, (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v"))).drop("_u", "_v")
    rooted = linked.join(part.select(F.col("node").alias("u"), "part"), "u")
    first = arcs.join(part.where("node = part").select(F.col("node").alias("u")), "u").groupBy("u").agg(F.min("v").alias("v"))
    starts = first.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.lit(True).alias("_start"))
    # The arc before a walk's first one is its end.
    ended = rooted.join(starts, ["nu", "nv"], "left")
    nowhere = F.lit(None).cast(dict(arcs.dtypes)["u"])
    steps = stored(ended.select("part", "id", "u", "v", F.when(F.col("_start"), nowhere).otherwise(F.col("nu")).alias("nu"), F.when(F.col("_start"), nowhere).otherwise(F.col("nv")).alias("nv"), F.when(F.col("_start"), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("left")), "tour")
    while not steps.where("nu IS NOT NULL").isEmpty():
        on = steps.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("_nu"), F.col("nv").alias("_nv"), F.col("left").alias("_left"))
        jumped = steps.join(on, ["nu", "nv"], "left")
        steps = stored(jumped.select("part", "id", "u", "v", F.col("_nu").alias("nu"), F.col("_nv").alias("nv"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")), "tour")
    sizes = part.groupBy("part").agg((2 * (F.count("*") - 1)).alias("_arcs"))
    return steps.join(sizes, "part").select("part", "id", "u", "v", (F.col("_arcs") - 1 - F.col("left")).alias("place"))


def subtree_sums(arcs: DataFrame, values: DataFrame, names: list[str], block: int = BLOCK) -> DataFrame:
    """One row a tree edge: ``part, id, parent, child`` and, for each of ``names`` (columns of ``values`` by ``node``), the
    sum over the child's side and, as ``all_*``, over the whole tree. Missing nodes count 0."""
    both = Window.partitionBy("part", "id")
    down = arcs.withColumn("_first", F.min("place").over(both)).withColumn("_last", F.max("place").over(both))
    at = down.join(values.withColumnRenamed("node", "v"), "v", "left")
    # A node counts where the walk first comes to it.
    at = at.select("part", "id", "u", "v", "place", "_first", "_last", F.floor(F.col("place") / block).alias("_block"), *[F.when(F.col("place") == F.col("_first"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in names])
    at = stored(at, "tour-values")
    inside = Window.partitionBy("part", "_block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = at.groupBy("part", "_block").agg(*[F.sum(c).alias(f"_s_{c}") for c in names])
    before = Window.partitionBy("part").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", "_block", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in names])
    upto = at.join(offsets, ["part", "_block"]).select("part", "id", "u", "v", "place", "_first", "_last", *[F.col(c).alias(f"_own_{c}") for c in names], *[(F.sum(c).over(inside) + F.col(f"_b_{c}")).alias(c) for c in names])
    ends = upto.groupBy("part", "id").agg(
        F.min_by("u", "place").alias("parent"), F.min_by("v", "place").alias("child"),
        *[(F.max_by(c, "place") - F.min_by(F.col(c) - F.col(f"_own_{c}"), "place")).alias(c) for c in names],
    )
    members = arcs.select("part", F.col("v").alias("node")).unionByName(arcs.select("part", F.col("u").alias("node"))).distinct()
    totals = members.join(values, "node", "left").groupBy("part").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"all_{c}") for c in names])
    return ends.join(totals, "part")


def with_bridges(edges: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """Edges ``id, a, b`` with ``bridge`` and, for tree edges, what ``subtree_sums`` gives and the number of ends of edges
    beside the tree on the child's side (``ends``) and in all (``all_ends``)."""
    edges = stored(edges.select("id", "a", "b"), "network-edges")
    tree, part = spanning_forest(edges)
    beside = edges.join(tree.select("id"), "id", "left_anti")
    h = F.xxhash64("id", F.lit(77)).bitwiseAND((1 << 62) - 1).cast("decimal(38,0)")
    marks = beside.select(F.explode(F.array(F.struct(F.col("a").alias("node"), h.alias("mark")), F.struct(F.col("b").alias("node"), (-h).alias("mark")))).alias("s")).select("s.*")
    at_node = marks.groupBy("node").agg(F.sum("mark").cast("decimal(38,0)").alias("mark"), F.count("*").alias("ends"))
    summed = subtree_sums(tour(tree, part), values.join(at_node, "node", "full"), [*names, "mark", "ends"])
    return edges.join(summed.withColumn("bridge", F.col("mark") == 0).drop("mark", "all_mark"), "id", "left").withColumn("bridge", F.coalesce("bridge", F.lit(False)))


def bridge_flows(edges: DataFrame, injections: DataFrame) -> DataFrame:
    """``a, b, bridge, flow`` of distinct pairs of nodes: over a bridge flows what is injected beyond it (seen from ``a``),
    over an edge on a cycle nothing is said (0). ``injections`` has ``node, mw``."""
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("id", F.xxhash64("a", "b"))
    found = with_bridges(pairs, injections.groupBy("node").agg(F.sum("mw").alias("mw")), ["mw"])
    side = F.when(F.col("a") == F.col("child"), F.col("mw")).otherwise(F.col("all_mw") - F.col("mw"))
    return found.select("a", "b", "bridge", F.when(F.col("bridge"), F.abs(side)).otherwise(0.0).alias("flow"))


def hanging_edges(edges: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """``id`` of edges that hang on the rest: bridges of which one side has neither a cycle nor a protected ``node``."""
    kept = protected.select("node").distinct().withColumn("kept", F.lit(1)) if protected is not None else edges.select(F.col("a").alias("node"), F.lit(0).alias("kept")).limit(0)
    found = with_bridges(edges, kept, ["kept"])
    bare = lambda c, k: (F.col(c) == 0) & (F.col(k) == 0)
    other = ((F.col("all_ends") - F.col("ends")) == 0) & ((F.col("all_kept") - F.col("kept")) == 0)
    return found.where(F.col("bridge") & (bare("ends", "kept") | other)).select("id")
