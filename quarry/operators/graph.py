"""Graph operators on edge tables: frontier joins, never a collected graph. Lineage is cut by reliable checkpoints."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import cut, stored
from quarry.functions import metrics

#: Edges of a graph that are taken as one row.
SMALL = 64


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each distinct pair."""
    pairs = edges.select("src", "dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))


def distances(edges: DataFrame, sources: DataFrame, hops: int | None, each: bool = False) -> DataFrame:
    """node_id, dist (and source, if each) within so many hops (None: any) of the sources, ignoring direction.

    A hop joins the frontier alone with the edges; nodes of the last two rings leave by anti joins. Stops when nothing is new.
    """
    both = undirected(edges)
    key = ["source", "node_id"] if each else ["node_id"]
    start = sources.select("node_id").distinct()
    seen = (start.withColumn("source", F.col("node_id")) if each else start).withColumn("dist", F.lit(0))
    frontier = cut(seen.select(*key, "dist"))
    rings = [frontier]
    for hop in count(1) if hops is None else range(1, hops + 1):
        step = frontier.join(both, frontier["node_id"] == both["src"]).select(*([frontier["source"]] if each else []), F.col("dst").alias("node_id")).distinct()
        for ring in rings[-2:]:  # neighbours of a ring lie in it or in the rings beside it
            step = step.join(ring, key, "left_anti")
        frontier = cut(step.withColumn("dist", F.lit(hop)).select(*key, "dist"))
        if frontier.isEmpty():
            break
        rings.append(frontier)
    return reduce(DataFrame.unionByName, rings)


def k_hop_edges(edges: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """Edges between nodes of the k-hop neighbourhood."""
    return induced(edges, distances(edges, sources, k))


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends kept."""
    ends = keep.select("node_id").distinct()
    return edges.join(ends.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ends.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def _leaders(picks: DataFrame) -> DataFrame:
    """index, comp, lead of components that each picked a neighbour (index, comp, other): the root of each tree of picks.

    Picks follow one order of edges, so a tree has one pair that picked each other; the smaller of it is the root. Pointers double.
    """
    a, b = picks.alias("a"), picks.alias("b")
    mutual = (F.col("a.index").eqNullSafe(F.col("b.index"))) & (F.col("a.other") == F.col("b.comp"))
    root = (F.col("b.other") == F.col("a.comp")) & (F.col("a.comp") < F.col("a.other"))
    lead = a.join(b, mutual, "left").select("a.index", "a.comp", F.when(F.coalesce(root, F.lit(False)), F.col("a.comp")).otherwise(F.col("a.other")).alias("lead"))
    while True:
        a, b = lead.alias("a"), lead.alias("b")
        step = stored(a.join(b, F.col("a.index").eqNullSafe(F.col("b.index")) & (F.col("a.lead") == F.col("b.comp")), "left").select("a.index", "a.comp", F.coalesce("b.lead", "a.lead").alias("lead"), (F.col("b.lead") != F.col("a.lead")).alias("moved")))
        lead = step.drop("moved")
        if step.where("moved").isEmpty():
            return lead


def _joined(bridges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Boruvka's rounds for all records: labels (index, terminal, comp) after joining by the least bridges (index, a, b, w, u, v),
    and those bridges. A round picks each component's least bridge by an aggregation and at least halves the components."""
    taken = None
    while True:
        ends = {side: labels.select(F.col("index").alias(f"_i{side}"), F.col("terminal").alias(f"_t{side}"), F.col("comp").alias(f"_c{side}")) for side in "ab"}
        joined = bridges
        for side in "ab":
            joined = joined.join(ends[side], F.col("index").eqNullSafe(F.col(f"_i{side}")) & (F.col(side) == F.col(f"_t{side}")))
        between = stored(joined.where("_ca <> _cb").select(*bridges.columns, "_ca", "_cb"))
        if between.isEmpty():
            return labels, taken
        order = F.struct("w", "a", "b", "u", "v")
        each = between.select("index", F.col("_ca").alias("comp"), F.col("_cb").alias("other"), order.alias("e")).unionByName(between.select("index", F.col("_cb").alias("comp"), F.col("_ca").alias("other"), order.alias("e")))
        picks = stored(each.groupBy("index", "comp").agg(F.min(F.struct("e", "other")).alias("p")).select("index", "comp", "p.e", "p.other"))
        chosen = picks.select("index", "e.*").distinct()
        taken = chosen if taken is None else taken.unionByName(chosen)
        lead = _leaders(picks.select("index", "comp", "other"))
        by = F.col("l.index").eqNullSafe(F.col("r.index")) & (F.col("l.comp") == F.col("r.comp"))
        labels = stored(labels.alias("l").join(lead.alias("r"), by, "left").select("l.index", "l.terminal", F.coalesce("r.lead", "l.comp").alias("comp")))
        bridges = between.select(*bridges.columns)


def connecting_nodes(edges: DataFrame, records: DataFrame, hops: int | None = None) -> DataFrame:
    """G02-G04 of all records at once: index, node_id of a small connected set of nodes around each record's terminals (index, node_id).

    All records grow from all their terminals together, a ring a round; a node belongs to the terminal that reaches it first (of
    equals the least). Edges between two terminals' nodes are bridges, and the least spanning tree over them is one of the
    metric closure. After ring h all bridges up to the length 2h + 1 are known, so a record whose terminals they connect is
    done and grows no further: it never walks beyond half of its longest link. Trees are joined by rounds of aggregation, and
    paths are walked back by joins. Nothing is collected. Terminals out of reach, or farther than `hops`, stay by themselves.
    A node with one neighbour is on no way between others, so a record goes to those alone that are its terminals: a hub's
    leaves aren't walked by every record.
    """
    both = stored(undirected(edges))
    leaves = stored(both.where("src <> dst").groupBy(F.col("src").alias("_leaf")).agg(F.count("*").alias("_n")).where("_n = 1").select("_leaf"))
    inner = stored(both.join(leaves, F.col("dst") == F.col("_leaf"), "left_anti"))
    start = stored(records.select("index", F.col("node_id").cast("long").alias("node_id")).where("node_id is not null").distinct())
    own = start.join(leaves, F.col("node_id") == F.col("_leaf"), "left_semi").select(F.col("index").alias("_own"), F.col("node_id").alias("_leaf"))
    own = stored(own.join(both, F.col("_leaf") == F.col("src")).select("_own", F.col("dst").alias("_by"), "_leaf"))
    labels = start.select("index", F.col("node_id").alias("terminal"), F.col("node_id").alias("comp"))
    frontier = start.select("index", "node_id", F.col("node_id").alias("terminal"), F.lit(0).alias("dist"), F.lit(None).cast("long").alias("pred"))
    rings, trees = [frontier], []
    for hop in count():
        counted = labels.groupBy("index").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select(F.col("index").alias("_open"))
        frontier = frontier.join(counted, F.col("index").eqNullSafe(F.col("_open")), "left_semi")
        onward = frontier.join(inner, F.col("node_id") == F.col("src")).select("index", "terminal", F.col("node_id").alias("u"), F.col("dst").alias("v"), "dist")
        ends = frontier.join(own, F.col("index").eqNullSafe(F.col("_own")) & (F.col("node_id") == F.col("_by"))).select("index", "terminal", F.col("node_id").alias("u"), F.col("_leaf").alias("v"), "dist")
        step = stored(onward.unionByName(ends))
        if step.isEmpty():
            break
        near = reduce(DataFrame.unionByName, rings[-2:]).select(F.col("index").alias("_i"), F.col("node_id").alias("_n"), F.col("terminal").alias("_t"), F.col("dist").alias("_d"))
        here = F.col("index").eqNullSafe(F.col("_i")) & (F.col("v") == F.col("_n"))
        turned = F.col("terminal") > F.col("_t")
        side = lambda x, y, flip=turned: F.when(flip, y).otherwise(x)
        met = step.join(near, here).where("terminal <> _t").select("index", side(F.col("terminal"), F.col("_t")).alias("a"), side(F.col("_t"), F.col("terminal")).alias("b"), (F.col("dist") + 1 + F.col("_d")).alias("w"), side(F.col("u"), F.col("v")).alias("u"), side(F.col("v"), F.col("u")).alias("v"))
        met = met.groupBy("index", "a", "b").agg(F.min(F.struct("w", "u", "v")).alias("m")).select("index", "a", "b", "m.*")
        labels, taken = _joined(met, labels)
        if taken is not None:
            trees.append(taken)
        if hops is not None and 2 * hop + 1 >= hops:
            break
        fresh = step.join(near, here, "left_anti").groupBy("index", "v").agg(F.min(F.struct("terminal", "u")).alias("m"))
        frontier = stored(fresh.select("index", F.col("v").alias("node_id"), "m.terminal", F.lit(hop + 1).alias("dist"), F.col("m.u").alias("pred")))
        rings.append(frontier)
    nodes = start
    if trees:
        at = reduce(DataFrame.unionByName, trees).select("index", F.explode(F.array("u", "v")).alias("node_id")).distinct()
        nodes = nodes.unionByName(at)
        for ring in reversed(rings[1:]):  # from the farthest ring inwards: those of this ring, and what waits for the next
            here = F.col("w.index").eqNullSafe(F.col("r.index")) & (F.col("w.node_id") == F.col("r.node_id"))
            back = at.alias("w").join(ring.alias("r"), here, "left").select("w.index", F.coalesce("r.pred", "w.node_id").alias("node_id"))
            at = stored(back.distinct())
            nodes = nodes.unionByName(at)
    return nodes.distinct()


def connecting_subgraphs(edges: DataFrame, records: DataFrame, hops: int | None = None) -> DataFrame:
    """G02-G05 of all records: index and the columns of the edges between nodes of each record's connecting set. A record asks for the edges
    by their end of fewer edges, so a hub among its nodes doesn't bring all of the hub's edges."""
    nodes = stored(connecting_nodes(edges, records, hops))
    many = edges.select(F.explode(F.array("src", "dst")).alias("_node")).groupBy("_node").agg(F.count("*").alias("_many"))
    held = edges
    for end in ("src", "dst"):
        held = held.join(many.select(F.col("_node").alias(f"_{end}"), F.col("_many").alias(f"_many_{end}")), F.col(end) == F.col(f"_{end}"))
    fewer = F.col("_many_src") <= F.col("_many_dst")
    held = held.select(*edges.columns, F.when(fewer, F.col("src")).otherwise(F.col("dst")).alias("_by"), F.when(fewer, F.col("dst")).otherwise(F.col("src")).alias("_to"))
    own = nodes.select("index", F.col("node_id").alias("_by")).join(held, "_by")
    other = nodes.select(F.col("index").alias("_i"), F.col("node_id").alias("_n"))
    return own.join(other, F.col("index").eqNullSafe(F.col("_i")) & (F.col("_to") == F.col("_n")), "left_semi").select("index", *edges.columns)


def connecting_subgraph(edges: DataFrame, terminals: list[int], hops: int | None = None) -> DataFrame:
    """G02-G05 of one set of terminals, given by the caller."""
    records = edges.sparkSession.createDataFrame([(0, int(t)) for t in sorted(set(terminals))], "index int, node_id long")
    return connecting_subgraphs(edges.withColumnRenamed("index", "_index") if "index" in edges.columns else edges, records, hops).drop("index")


def core(edges: DataFrame, key: list[str]) -> DataFrame:
    """G05 across rows: the edges (key, src, dst) that are left when those at leaves and roots are taken off until none is: all that lie
    on cycles or on ways from one cycle to another. An edge stays in a round if something leads to its source and its target
    leads on, so a chain shrinks from both its ends; a round is two semi joins by node."""
    live = stored(edges.select(*key, "src", "dst").where("src is not null and dst is not null").distinct())
    left = live.count()
    while left:
        into = live.select(*key, F.col("dst").alias("src")).distinct()
        onward = live.select(*key, F.col("src").alias("dst")).distinct()
        live = stored(live.join(into, [*key, "src"], "left_semi").join(onward, [*key, "dst"], "left_semi").select(*key, "src", "dst"))
        now = live.count()
        if now == left:
            break
        left = now
    return live


def acyclic(edges: DataFrame, key: list[str]) -> DataFrame:
    """G05 of any number of graphs in one edge table: key, dag (1 without a cycle, else 0), of every key with an edge row. Edges
    with a null end are none, and keys must not be null. Graphs of up to `SMALL` edges are peeled in their own rows, in one pass for
    all; larger ones by rounds of joins, so no group is gathered beyond that."""
    live = stored(edges.select(*key, "src", "dst").where("src is not null and dst is not null").distinct())
    large = stored(live.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > SMALL).select(*key))
    small = live.join(large, key, "left_anti").groupBy(*key).agg(F.collect_list(F.struct("src", F.col("dst").alias("tgt"))).alias("_e"))
    rest = small.where(metrics.acyclic(F.col("_e")) == 0).select(*key)
    if not large.isEmpty():
        rest = rest.unionByName(core(live.join(large, key, "left_semi"), key).select(*key).distinct())
    return edges.select(*key).distinct().join(rest.withColumn("_cyclic", F.lit(True)), key, "left").select(*key, F.when(F.col("_cyclic"), 0).otherwise(1).alias("dag"))
