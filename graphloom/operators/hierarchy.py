"""Parent-child links to full hierarchies (problem 4).

Input: nodes (node, parent), each node once, parent null or another node's name.

1. *Cycle separation* by pointer doubling: after k rounds each node knows its
   ancestor 2^k steps up, if there is one. When a round finds no further node
   without, the rest leads into cycles; when the set of their ancestors no longer
   shrinks, doubling maps it onto itself, so it holds the nodes on cycles.
2. *Subtree sizes* by the same rounds: the descendants nearer than 2^(k+1) of
   v are those nearer than 2^k of v and of each node exactly 2^k below v.
3. *Heavy paths*: the child with the largest subtree (ties: smallest name)
   continues its parent's chain; doubling along heavy edges gives each node its
   chain's head and its place in the chain.
4. *Chains*: a light edge at least halves the subtree, so a chain lies at most
   log2(n) chains below its root. Doubling over the tree of chains gives each
   chain the chains above it and where they are left: its root is the head of the
   topmost; a node's depth is what they hold above it, plus its place; preorder
   positions add up in the same way.
5. *Paths* concatenate the segments of the chains from the root down.
6. *Descendants* of a node are the nodes whose path leaves its chain at its place
   or later: an interval of the chain, joined by the chain.

Every round is one or two joins of at most n rows, so the rounds grow with
log2(depth). Lineage is cut after each. Hot parents (a third of all nodes under
one) are aggregated map-side or are the unique side of a join, which AQE splits;
their children are numbered in buckets, first within and then over them.

Cases: a parent that isn't a node makes a root; null nodes are left out; of
repeated nodes the caller keeps one (``latest_classes`` does); a node that is its
own parent is a cycle; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import cut, small_side


def bare_name(base: Column) -> Column:
    """Last name of a base without padding, type arguments, call and qualifier."""
    plain = F.regexp_replace(F.regexp_replace(base, r"[\[(<].*$", ""), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_extract(plain, r"([^.:]*)$", 1), r"^\s+|\s+$", "")


def latest_classes(class_defs: DataFrame) -> DataFrame:
    """One row per class_uid: the one with the greatest indexed_at (ties: greatest row_id)."""
    order = F.struct(F.col("indexed_at").isNotNull(), "indexed_at", "row_id")
    return (
        class_defs.filter("class_uid is not null")
        .groupBy("class_uid")
        .agg(F.max_by(F.struct("repo", "name", "base_classes"), order).alias("r"))
        .select("class_uid", "r.repo", "r.name", "r.base_classes")
    )


def class_parents(class_defs: DataFrame) -> DataFrame:
    """(node, parent): the class named by the first base that is a class of the same repository."""
    latest = cut(latest_classes(class_defs))
    names = latest.filter("name is not null").groupBy(F.coalesce("repo", F.lit("")).alias("r"), F.col("name").alias("base")).agg(F.min("class_uid").alias("parent"))
    bases = latest.select(F.col("class_uid").alias("node"), F.coalesce("repo", F.lit("")).alias("r"), F.posexplode("base_classes").alias("i", "b"))
    bases = bases.select("node", "r", "i", bare_name(F.col("b")).alias("base")).filter("base <> ''")
    first = bases.join(names, ["r", "base"]).groupBy("node").agg(F.min_by("parent", "i").alias("parent"))
    return latest.select(F.col("class_uid").alias("node")).join(first, "node", "left")


def separate_cycles(links: DataFrame) -> DataFrame:
    """(node, parent, state, size); links: (node, parent), each node once. Sizes off the trees mean nothing and are null."""
    links = links.filter("node is not null").select("node", "parent")
    known = links.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    links = cut(links.join(known, "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("parent")))
    state = links.select("node", F.col("parent").alias("up"), F.lit(1.0).alias("size"))
    before = None
    while True:
        # up: ancestor at a distance that doubles every round, null if the root is nearer; size: descendants nearer than that
        # distance, which those exactly there and theirs double (cycles: no meaning)
        at = state.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        below = state.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        joined = state.join(at, "up", "left").join(below, "node", "left")
        state = cut(joined.select("node", F.col("up2").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0.0))).alias("size")), state)
        # depths have no gaps: if a round finds no shallower node, none is left to be found. Ancestors of the rest thin out until only cycles are left.
        now = tuple(state.filter("up is not null").agg(F.count(F.lit(1)), F.count_distinct("up")).first())
        if now[0] == 0 or now == before:
            break
        before = now
    on_cycle = state.filter("up is not null").select(F.col("up").alias("node")).distinct().withColumn("on", F.lit(True))
    rooted = F.col("up").isNull()
    return (
        links.join(state, "node")
        .join(on_cycle, "node", "left")
        .select("node", "parent", F.when(rooted, "rooted").when(F.col("on"), "on_cycle").otherwise("below_cycle").alias("state"), F.when(rooted, F.col("size").cast("bigint")).alias("size"))
    )


#: Children of one parent that are numbered together, on average.
CHILDREN_AT_ONCE = 50_000


def _light_offsets(light: DataFrame) -> DataFrame:
    """(node, before): sizes of the light siblings ahead of each light child (node, parent, size): within buckets, then over buckets."""
    buckets = max(1, -(-light.count() // CHILDREN_AT_ONCE))
    light = light.select("node", "parent", "size", F.pmod(F.xxhash64("node"), F.lit(buckets)).alias("bucket"))
    ahead = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inside = light.withColumn("within", F.coalesce(F.sum("size").over(ahead("parent", "bucket", "node")), F.lit(0)))
    if buckets == 1:
        return inside.select("node", F.col("within").alias("before"))
    sums = light.groupBy("parent", "bucket").agg(F.sum("size").alias("all"))
    sums = sums.select("parent", "bucket", F.coalesce(F.sum("all").over(ahead("parent", "bucket")), F.lit(0)).alias("over"))
    return inside.join(sums, ["parent", "bucket"]).select("node", (F.col("within") + F.col("over")).alias("before"))


def heavy_paths(separated: DataFrame) -> DataFrame:
    """(node, parent, size, head, place, root, depth, pos, above): chains and preorder positions of all rooted nodes.

    ``head`` is the top of the node's chain, ``place`` its distance from it; ``above``
    has the chains over that one, from the nearest to the root's: their heads and
    the places at which they are left. The descendants of a node are those of its
    root with a pos in (pos, pos + size).
    """
    sized = cut(separated.filter("state = 'rooted'").select("node", "parent", "size"))
    heavy = sized.filter("parent is not null").groupBy("parent").agg(F.min_by(F.struct("node", "size"), F.struct(-F.col("size"), "node")).alias("h"))
    heavy = cut(heavy.select("parent", F.col("h.node").alias("node"), F.col("h.size").alias("heavy_size")))
    # chain heads by doubling along heavy edges
    state = sized.select("node").join(heavy.select("node", F.col("parent").alias("up")), "node", "left")
    state = cut(state.select("node", "up", F.col("up").isNotNull().cast("bigint").alias("place"), F.when(F.col("up").isNull(), F.col("node")).alias("head")))
    while not state.filter("head is null").isEmpty():
        at = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("place").alias("p2"), F.col("head").alias("head2"))
        found = F.col("head").isNotNull()
        state = cut(
            state.join(at, "up", "left").select(
                "node", F.when(~found, F.col("up2")).alias("up"), F.when(found, F.col("place")).otherwise(F.col("place") + F.col("p2")).alias("place"), F.coalesce("head", "head2").alias("head")
            ),
            state,
        )
    chained = cut(sized.join(state.select("node", "head", "place"), "node"))
    # the tree of chains: where a chain's head hangs, and how far its pos is from that of the chain above
    heads = chained.filter("head = node")
    light = heads.filter("parent is not null").select("node", "parent", "size")
    over = chained.select(F.col("node").alias("parent"), F.col("head").alias("over"), F.col("place").alias("left_at"))
    hung = light.join(over, "parent").join(heavy.select("parent", "heavy_size"), "parent").join(_light_offsets(light), "node")
    shift = F.col("left_at") + 1 + F.col("heavy_size") + F.col("before")
    step = F.struct(F.col("over").alias("chain"), F.col("left_at").alias("place"), shift.alias("shift"))
    chains = hung.select(F.col("node").alias("head"), "over", F.array(step).alias("above"))
    roots = heads.filter("parent is null").select(F.col("node").alias("head"), F.lit(None).cast(dict(chains.dtypes)["over"]).alias("over"), F.array().cast(dict(chains.dtypes)["above"]).alias("above"))
    chains = cut(chains.unionByName(roots))
    while not chains.filter("over is not null").isEmpty():  # at most log2 n chains deep, so above stays short
        at = chains.select(F.col("head").alias("over"), F.col("over").alias("over2"), F.col("above").alias("above2"))
        chains = cut(chains.join(at, "over", "left").select("head", F.col("over2").alias("over"), F.when(F.col("above2").isNull(), F.col("above")).otherwise(F.concat("above", "above2")).alias("above")), chains)
    total = lambda f: F.aggregate("above", F.lit(0).cast("bigint"), lambda s, x: s + f(x))
    chains = chains.select("head", F.coalesce(F.try_element_at("above", F.lit(-1))["chain"], F.col("head")).alias("root"), total(lambda x: x["place"] + 1).alias("head_depth"), total(lambda x: x["shift"]).alias("head_pos"), "above")
    return chained.join(chains, "head").select(
        "node", "parent", "size", "head", "place", "root", (F.col("head_depth") + F.col("place")).alias("depth"), (F.col("head_pos") + F.col("place")).alias("pos"), F.transform("above", lambda x: F.struct(x["chain"].alias("chain"), x["place"].alias("place"))).alias("above")
    )


def node_paths(heavy: DataFrame) -> DataFrame:
    """(node, path): names from the root down to the node, concatenated from chain segments.

    A segment is the list of a chain's nodes down to where it is left; a chain's
    nodes are one list per chain, i.e. the longest single value is as long as
    the longest path, which the result has anyway.
    """
    segments = cut(heavy.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("s")).select("head", F.transform("s", lambda x: x["node"]).alias("chain")))
    up = heavy.filter("head = node").select("head", F.posexplode("above").alias("n", "x")).select("head", "n", F.col("x.chain").alias("over"), F.col("x.place").alias("left_at"))
    parts = up.join(segments.select(F.col("head").alias("over"), "chain"), "over").select("head", "n", F.slice("chain", F.lit(1), F.col("left_at").cast("int") + 1).alias("part"))
    above = parts.groupBy("head").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "part"))).alias("p")).select("head", F.flatten(F.transform("p", lambda x: x["part"])).alias("above_path"))
    own = heavy.select("node", "head", "place").join(segments, "head").join(above, "head", "left")
    return own.select("node", F.concat(F.coalesce("above_path", F.array().cast("array<string>")), F.slice("chain", F.lit(1), F.col("place").cast("int") + 1)).alias("path"))


def descendants_of(heavy: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, descendant) for the stated nodes (column node).

    A node lies below v if its path leaves v's chain at v's place or later. Each
    node has one row per chain of its path, at most log2(n); they are joined by
    the chain, with the interval of places as residual.
    """
    asked = heavy.join(nodes.select("node").distinct(), "node", "left_semi").select("node", F.col("head").alias("chain"), F.col("place").alias("from"))
    own = F.struct(F.col("head").alias("chain"), F.col("place").alias("place"))
    passed = heavy.select(F.col("node").alias("descendant"), F.explode(F.concat(F.array(own), "above")).alias("x")).select("descendant", "x.chain", "x.place")
    return passed.join(small_side(asked), "chain").filter((F.col("place") >= F.col("from")) & (F.col("descendant") != F.col("node"))).select("node", "descendant")


def class_hierarchy(class_defs: DataFrame) -> DataFrame:
    """(class_uid, root_uid, depth, state, subtree, chain_head, pos) of every class; the last three null off the trees."""
    separated = cut(separate_cycles(class_parents(class_defs)))
    heavy = heavy_paths(separated)
    looped = separated.filter("state <> 'rooted'").select(F.col("node").alias("class_uid"), F.lit("").alias("root_uid"), F.lit(-1).cast("bigint").alias("depth"), "state")
    rooted = heavy.select(F.col("node").alias("class_uid"), F.col("root").alias("root_uid"), "depth", F.lit("rooted").alias("state"), F.col("size").alias("subtree"), F.col("head").alias("chain_head"), "pos")
    return rooted.unionByName(looped, allowMissingColumns=True)
