"""Fixpoints over reference graphs: transitive inputs, depth and validity of derived records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.session import Scratch

MAX_DEPTH = 64
#: Steps are only composed if that makes at most this many pairs for each edge; beyond it the stride stays as it is.
MOST_GROWTH = 4


def _twice(scratch: Scratch, steps: DataFrame, limit: int) -> DataFrame | None:
    """The pairs two of ``steps`` (id, input) apart; None if there might be more than ``limit`` of them.

    How many the join would make is counted first, as the sum of ways in times ways out of each middle, so that a record
    with many inputs that many others derive from is never multiplied out."""
    into = steps.groupBy(F.col("id").alias("via")).agg(F.count("*").alias("a"))
    out = steps.groupBy(F.col("input").alias("via")).agg(F.count("*").alias("b"))
    n = into.join(out, "via").agg(F.sum(F.col("a").cast("decimal(38,0)") * F.col("b"))).first()[0]
    if n is not None and n > limit:
        return None
    head = steps.select("id", F.col("input").alias("via"))
    return scratch.keep(head.join(steps.withColumnRenamed("id", "via"), "via").select("id", "input").distinct(), "steps")


def reached(spark: SparkSession, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): the ``seeds`` (id) and all that lead to one over ``edges`` (id, input), at any distance.

    A fixpoint of semi-joins whose stride doubles: after a round over the pairs exactly L edges apart, all within twice L
    are known, and a round that finds none ends it. The rounds grow with the logarithm of the longest way; loops end by
    themselves. Where composing the pairs would multiply them, the stride stays. Null ids take no part."""
    scratch = Scratch(spark, "reached")
    steps, n = scratch.counted(edges.select("id", "input").dropna().distinct(), "edges")
    limit = MOST_GROWTH * n["n"]
    seen = scratch.keep(seeds.select("id").dropna().distinct(), "seen")
    doubling = True
    while n["n"]:
        new = steps.join(seen.withColumnRenamed("id", "input"), "input", "left_semi").select("id").distinct()
        found, n = scratch.counted(new.join(seen, "id", "left_anti"), "found")
        if not n["n"]:
            break
        previous, seen = seen, scratch.keep(seen.unionByName(found), "seen")
        further = _twice(scratch, steps, limit) if doubling else None
        doubling = further is not None
        for t in (previous, found, steps if doubling else None):
            scratch.drop(t)
        steps = further if doubling else steps
    return seen


def with_walk(spark: SparkSession, edges: DataFrame, length: int) -> DataFrame:
    """(id): where a walk of ``length`` (1 or more) of the ``edges`` (id, input) starts; on and before a loop there is one of any length."""
    scratch = Scratch(spark, "walks")
    steps, n = scratch.counted(edges.select("id", "input").dropna().distinct(), "edges")
    limit = MOST_GROWTH * n["n"]
    ends = None

    def start(steps, ends):
        walk = steps if ends is None else steps.join(ends.withColumnRenamed("id", "input"), "input", "left_semi")
        return scratch.keep(walk.select("id").distinct(), "starts")

    while length:
        if length % 2:
            ends = start(steps, ends)
        length //= 2
        further = _twice(scratch, steps, limit) if length else None
        if further is None:
            for _ in range(2 * length):
                ends = start(steps, ends)
            break
        scratch.drop(steps)
        steps = further
    return ends


def transitive_inputs(spark: SparkSession, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All (id, input, distance) pairs of ``edges`` (id, input), with the least distance, up to ``max_depth`` if given.

    Distances double from round to round: a pair further apart than 2^k goes through one at exactly 2^k on a
    shortest way, so only those pairs are extended, until no pair is so far apart. Loops end by themselves; a node on a loop is its own input."""
    scratch = Scratch(spark, "inputs")
    pairs = scratch.keep(edges.select("id", "input").dropna().distinct().withColumn("distance", F.lit(1)), "pairs")
    reach = 1
    while max_depth is None or reach < max_depth:
        head = pairs.filter(F.col("distance") == reach).select("id", F.col("input").alias("via"))
        tail = pairs.select(F.col("id").alias("via"), "input", (F.col("distance") + reach).alias("distance"))
        longer = head.join(tail if max_depth is None else tail.filter(F.col("distance") <= max_depth), "via").select("id", "input", "distance")
        both = pairs.unionByName(longer).groupBy("id", "input").agg(F.min("distance").alias("distance"))
        previous, pairs = pairs, scratch.keep(both, "pairs")
        scratch.drop(previous)
        reach *= 2
        if not pairs.filter(F.col("distance") == reach).limit(1).count():
            break
    return pairs


def sound_records(spark: SparkSession, nodes: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``nodes`` (id, base BOOLEAN) with sound: the node's own check holds and all its inputs are sound.

    ``edges``: id, input. An input without a node is unsound, and so are nodes on or above a loop or deeper than
    ``max_depth``: those from which a longer walk starts. Whatever derives from an unsound node is unsound too."""
    scratch = Scratch(spark, "sound")
    nodes = scratch.keep(nodes.filter("id is not null").groupBy("id").agg(F.min(F.coalesce("base", F.lit(False))).alias("base")), "nodes")
    edges = scratch.keep(edges.select("id", "input").dropna().distinct(), "edges")
    gone = edges.join(nodes.select(F.col("id").alias("input")), "input", "left_anti").select("id")
    bad = nodes.filter("not base").select("id").unionByName(gone).unionByName(with_walk(spark, edges, max_depth + 1))
    worse = reached(spark, edges, bad).withColumn("_bad", F.lit(True))
    return nodes.join(worse, "id", "left").select("id", F.col("_bad").isNull().alias("sound"))
