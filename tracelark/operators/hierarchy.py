"""Parent-child rows of unknown depth to full hierarchies, by tree contraction.

Forward, every round rakes all leaves into their parents and then splices an independent set
of unary nodes out of their chains. A chain therefore shrinks by a constant factor a round,
whatever its length, and a bushy tree loses all its leaves: rounds grow with the logarithm of
the number of nodes, not with the depth. What stays is one node a tree, or one node that is
its own parent: the core of a loop. Backward, the recorded removals are undone in reverse, each
giving its node root, depth, path and number of descendants from nodes that were removed later.

All joins of the forward pass are on the unique node id; the only grouping by parent sums
and counts, so a parent of a third of all nodes costs no more than one row of each map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.session import Scratch


def _contract(alive: DataFrame) -> DataFrame:
    """One round: every node of ``alive`` once, with ``state`` alive, raked or spliced.

    ``kids`` is the number of children that are left: raking takes the leaves from it, and a spliced child is replaced by
    its own. The round's number is a column, not a literal, so that all rounds share one compiled plan."""
    a = alive.withColumn("leaf", (F.col("kids") == 0) & F.col("parent").isNotNull())
    inner = ~F.col("leaf")
    stats = (
        a.filter("parent is not null")
        .groupBy(F.col("parent").alias("id"))
        .agg(
            F.sum(F.when(F.col("leaf"), F.col("w") + F.col("ew"))).alias("raked_w"),
            F.count(F.when(inner, 1)).alias("ni"),
            F.max(F.when(inner, F.col("id"))).alias("kid"),
            F.max(F.when(inner, F.col("ew"))).alias("kid_ew"),
        )
    )
    coin = lambda c: F.xxhash64(c, F.col("rnd"))
    b = (
        a.join(stats, "id", "left")
        .withColumn("w", F.col("w") + F.coalesce("raked_w", F.lit(0)))
        .withColumn(
            "cut",
            F.coalesce(
                inner
                & (F.col("ni") == 1)
                & (F.col("parent") != F.col("id"))
                & (F.col("kid") != F.col("id"))
                & (coin(F.col("id")) < coin(F.col("parent")))
                & (coin(F.col("id")) < coin(F.col("kid"))),
                F.lit(False),
            ),
        )
    )
    up = b.filter("cut").select(
        F.col("kid").alias("id"),
        F.col("parent").alias("v_parent"),
        F.col("id").alias("v"),
        F.col("w").alias("v_w"),
        F.col("ew").alias("v_ew"),
        F.col("ed").alias("v_ed"),
        F.col("seg").alias("v_seg"),
    )
    hit = F.col("v").isNotNull()
    # A spliced node's child is never spliced in the same round, so only nodes that stay are re-hung.
    return b.join(up, "id", "left").select(
        "id",
        F.when(hit, F.col("v_parent")).otherwise(F.col("parent")).alias("parent"),
        F.when(hit, F.col("ew") + F.col("v_w") + F.col("v_ew")).otherwise(F.col("ew")).alias("ew"),
        F.when(hit, F.col("ed") + F.col("v_ed") + 1).otherwise(F.col("ed")).alias("ed"),
        F.when(hit, F.concat(F.col("v_seg"), F.array("v"), F.col("seg"))).otherwise(F.col("seg")).alias("seg"),
        "w",
        (F.col("rnd") + 1).alias("rnd"),
        F.coalesce("ni", F.lit(0).cast("bigint")).alias("kids"),
        F.when(F.col("leaf"), F.lit("raked")).when(F.col("cut"), F.lit("spliced")).otherwise(F.lit("alive")).alias("state"),
        F.when(F.col("cut"), F.col("kid")).alias("kid"),
        F.when(F.col("cut"), F.col("kid_ew")).alias("kid_ew"),
    )


#: Columns of a node between rounds, and what tells that a node may still be raked or spliced.
_NODE = ["id", "parent", "ew", "ed", "seg", "w", "rnd", "kids"]
_OPEN = "parent is not null and parent <> id"


def _placed(v: DataFrame, parents: DataFrame, keep: list) -> DataFrame:
    """Root, depth and path of removed nodes from those of the node each hung under."""
    p = parents.select(
        F.col("id").alias("parent"),
        F.col("root").alias("p_root"),
        F.col("depth").alias("p_depth"),
        F.col("path").alias("p_path"),
        F.col("loop").alias("p_loop"),
    )
    return v.join(p, "parent").select(
        "id",
        F.col("p_root").alias("root"),
        F.when(F.col("p_loop").isNull(), F.col("p_depth") + F.col("ed") + 1).alias("depth"),
        F.when(F.col("p_loop").isNull(), F.concat("p_path", "seg", F.array("id"))).alias("path"),
        F.col("p_loop").alias("loop"),
        *keep,
    )


def hierarchy(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Full hierarchy of ``nodes`` (id STRING, parent STRING).

    Returns one row per distinct non-null id: id, root_id, depth INT, n_descendants BIGINT, path, in_loop BOOLEAN, steps
    ARRAY<STRING> (the path's ids, which may hold "/" themselves; null where there is no path). A parent that is null or
    has no row makes a root (depth 0). On and below a loop: root_id is the smallest id of the loop, depth -1, path empty;
    n_descendants counts the distinct other nodes reachable downwards, for a node of the loop thus the whole component.
    Repeated ids count once, with their smallest non-null parent that has a row. Other columns are
    ignored. An empty input gives an empty result.
    """
    scratch = Scratch(spark, "hierarchy")
    raw = nodes.select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent")).filter("id is not null")
    raw = scratch.keep(raw.distinct(), "edges")
    ids = raw.select("id").distinct()
    known = raw.filter("parent is not null").join(ids.select(F.col("id").alias("parent")), "parent", "left_semi")
    first = scratch.keep(known.groupBy("id").agg(F.min("parent").alias("parent")), "first")
    kids = first.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    zero = F.lit(0).cast("bigint")
    n_open = {"open": F.count(F.when(F.expr(_OPEN), 1))}
    current, seen = scratch.counted(
        ids.join(first, "id", "left").join(kids, "id", "left").select(
            "id", "parent", zero.alias("ew"), zero.alias("ed"), F.array().cast("array<string>").alias("seg"),
            F.lit(1).cast("bigint").alias("w"), F.lit(0).alias("rnd"), F.coalesce("kids", zero).alias("kids"),
        ),
        "alive", **n_open,
    )
    for t in (raw, first):
        scratch.drop(t)
    rounds: list[DataFrame] = []
    n_open = {"open": F.count(F.when(F.expr(f"state = 'alive' and {_OPEN}"), 1))}
    start = current
    while seen["open"]:
        done, seen = scratch.counted(_contract(current), "round", **n_open)
        rounds.append(done)
        current = done.filter("state = 'alive'").select(*_NODE)

    looped = F.col("parent").isNotNull()
    core = current.select(
        "id",
        F.when(~looped, F.col("id")).alias("root"),
        F.when(~looped, F.lit(0).cast("bigint")).alias("depth"),
        F.when(~looped, F.array("id")).alias("path"),
        F.when(looped, F.col("id")).alias("loop"),
        (F.col("w") + F.col("ew")).alias("size"),
        looped.alias("on_loop"),
    )
    resolved = scratch.keep(core, "placed")
    scratch.drop(start)
    while rounds:
        done = rounds.pop()
        kid = resolved.select(F.col("id").alias("kid"), F.col("size").alias("k_size"), F.col("on_loop").alias("k_on"))
        cut = done.filter("state = 'spliced'").join(kid, "kid")
        spliced = _placed(
            cut,
            resolved,
            [
                F.when(F.col("k_on"), F.col("k_size")).otherwise(F.col("w") + F.col("kid_ew") + F.col("k_size")).alias("size"),
                F.col("k_on").alias("on_loop"),
            ],
        )
        both = resolved.unionByName(spliced)
        leaves = _placed(done.filter("state = 'raked'"), both, [F.col("w").alias("size"), F.lit(False).alias("on_loop")])
        # Rewritten as a whole: sizes grow from round to round, so all rewriting costs little more than the last.
        previous, resolved = resolved, scratch.keep(both.unionByName(leaves), "placed")
        for t in (done, previous):
            scratch.drop(t)

    # The name of a loop is its smallest member; rows outside loops do not take part in this join.
    names = resolved.filter("on_loop").groupBy("loop").agg(F.min("id").alias("name"))
    in_tree = resolved.filter("loop is null").withColumn("name", F.lit(None).cast("string"))
    below = resolved.filter("loop is not null").join(names, "loop")
    return in_tree.unionByName(below).select(
        F.col("id"),
        F.coalesce("root", "name").alias("root_id"),
        F.coalesce(F.col("depth"), F.lit(-1)).cast("int").alias("depth"),
        (F.col("size") - 1).alias("n_descendants"),
        F.coalesce(F.array_join("path", "/"), F.lit("")).alias("path"),
        F.col("on_loop").alias("in_loop"),
        F.col("path").alias("steps"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """All (ancestor_id, id, distance) pairs below each node of a tree, from the paths. Loops have no paths: see loop_descendants."""
    steps = tree.filter("depth > 0").select("id", "depth", F.posexplode("steps").alias("pos", "ancestor_id"))
    return steps.filter("pos < depth").select("ancestor_id", "id", (F.col("depth") - F.col("pos")).alias("distance"))


def loop_descendants(spark: SparkSession, tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """All (ancestor_id, id, distance) pairs on and below loops: with ``descendants`` as many as n_descendants counts.

    ``tree`` is the hierarchy of ``nodes`` (id, parent). A loop is cut at its smallest member: the rest is a tree, whose
    paths give the pairs along it. Every member also reaches all others and what hangs from them, around the loop; the
    distance is that of the only way. Nodes in no loop's component take no part.
    """
    scratch = Scratch(spark, "loops")
    looped = scratch.keep(tree.filter("depth = -1").select("id", "root_id", "in_loop"), "looped")
    raw = nodes.select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent")).filter("id is not null")
    known = looped.select(F.col("id").alias("parent"))
    # The parent of a looped node is looped; of several the smallest with a row counts, which may be no looped one's.
    rows = raw.filter("parent is not null").join(tree.select(F.col("id").alias("parent")), "parent", "left_semi").groupBy("id").agg(F.min("parent").alias("parent"))
    up = rows.join(known, "parent", "left_semi").join(looped, "id")
    opened = up.select("id", F.when(F.col("id") != F.col("root_id"), F.col("parent")).alias("parent"))
    t = scratch.keep(hierarchy(spark, opened).select("id", "root_id", "depth", "steps").join(looped.select("id", "in_loop"), "id"), "opened")

    # Members lie on the way from the smallest one to the last, at depths 0, 1, ...; a node hangs from its last member.
    members = t.filter("in_loop").select(F.col("root_id"), F.col("id").alias("ancestor_id"), F.col("depth").alias("a_depth"))
    length = members.groupBy("root_id").agg(F.count("*").alias("n"))
    steps = t.select("id", "root_id", "depth", "in_loop", F.posexplode("steps").alias("pos", "step"))
    entry = (
        steps.join(members.select("root_id", F.col("ancestor_id").alias("step"), "a_depth"), ["root_id", "step"])
        .groupBy("id", "root_id", "depth")
        .agg(F.max("a_depth").alias("e_depth"))
        .join(length, "root_id")
    )
    around = (
        entry.join(members, "root_id")
        .filter("id <> ancestor_id")
        .select(
            "ancestor_id",
            "id",
            # From the ancestor around to the entry member, then down.
            (F.pmod(F.col("e_depth") - F.col("a_depth"), F.col("n")) + F.col("depth") - F.col("e_depth")).cast("int").alias("distance"),
        )
    )
    lower = steps.filter("pos < depth").join(members.select("root_id", F.col("ancestor_id").alias("step")), ["root_id", "step"], "left_anti")
    lower = lower.select(F.col("step").alias("ancestor_id"), "id", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))
    return around.unionByName(lower)
