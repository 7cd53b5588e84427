"""Mixing sources to target weights, by weighted fair queueing (problem 9).

Each document, in its source's shuffled order, gets the virtual finish time
(tokens of the source up to and with it) / (target share); a further copy of a source starts where the one
before ends. Taken in the order of finish times, the sources stay at their shares at every point; the mix is
what finishes before the total budget is used up. A source whose copies are used up drops out, the others go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelark.session import Scratch

#: Documents of one part of a source's shuffled order, on average, when the largest source holds all rows.
PART_DOCS = 50_000


def _cut_time(caps: dict[str, float], shares: dict[str, float], budget: float) -> float:
    """Virtual time at which a fluid mix of the sources has used ``budget`` tokens (infinite if it never does)."""
    ends = sorted((caps[s] / shares[s], s) for s in caps)
    used, rate, t = 0.0, sum(shares[s] for s in caps), 0.0
    for end, s in ends:
        if used + rate * (end - t) >= budget:
            return t + (budget - used) / rate if rate > 0 else float("inf")
        used += rate * (end - t)
        t, rate = end, rate - shares[s]
    return float("inf")


def mix(
    spark: SparkSession, sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 29
) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    ``sized``: doc_id BIGINT, source, n_tokens BIGINT. ``targets``: source (unique), target_share DOUBLE > 0,
    max_repeats INT; a parameter table. ``budget``: total tokens, by default those of all documents of the named
    sources. Documents of other or null sources and documents without tokens take no part.

    Mix: doc_id, source, copy_no INT (from 0), n_tokens, virtual_finish, in the order of virtual_finish.
    Report: per target source its share, documents and tokens, tokens and documents used, actual_share. A source
    without documents is reported with 0.
    """
    scratch = Scratch(spark, "mix")
    t = targets.select("source", "target_share", "max_repeats").filter("source is not null and target_share > 0 and max_repeats > 0")
    d = sized.filter("n_tokens > 0 and doc_id is not null").join(t, "source").select(
        "source", "doc_id", "n_tokens", "target_share", "max_repeats", F.xxhash64("doc_id", F.lit(seed)).alias("h")
    )
    d = scratch.keep(d, "sized")
    per_source = {r["source"]: r for r in d.groupBy("source").agg(
        F.sum("n_tokens").alias("total"), F.max("n_tokens").alias("most"), F.count("*").alias("n"),
        F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"),
    ).collect()}  # one row per row of the parameter table
    total = {s: r["total"] for s, r in per_source.items()}
    shares = {s: r["share"] for s, r in per_source.items()}
    caps = {s: r["total"] * r["repeats"] for s, r in per_source.items()}
    if budget is None:
        budget = sum(total.values())
    slack = sum(r["most"] for r in per_source.values())
    # At a virtual time v a source has used at most its fluid amount, and less than one document below it.
    low, high = _cut_time(caps, shares, budget), _cut_time(caps, shares, budget + slack + 1)

    bits = max(0, (max([1, *(r["n"] for r in per_source.values())]) // PART_DOCS).bit_length())
    d = d.withColumn("part", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("bigint"))
    sums = d.groupBy("source", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("source", "part").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("run", F.sum("n_tokens").over(inside)).join(sums, ["source", "part"])
    whole = F.create_map(*[x for s, n in total.items() for x in (F.lit(s), F.lit(n))])[F.col("source")] if total else F.lit(0)
    done = d.withColumn("cum", F.col("offset") + F.col("run")).withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)))
    done = done.withColumn("virtual_finish", (F.col("copy_no") * whole + F.col("cum")) / F.col("target_share"))
    cols = ["doc_id", "source", "copy_no", "n_tokens", "virtual_finish"]
    done = scratch.keep(done.filter(F.col("virtual_finish") <= F.lit(float(high))).select(*cols), "finish")
    sure = done.filter(F.col("virtual_finish") <= F.lit(float(low)))
    used = sure.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    # Between the two times lie no more tokens than a few of the longest documents of each source.
    order = W.orderBy("virtual_finish", "source", "doc_id", "copy_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = done.filter(F.col("virtual_finish") > F.lit(float(low))).withColumn("cum", F.sum("n_tokens").over(order))
    edge = edge.filter(F.col("cum") <= budget - used).select(*cols)
    mixed = scratch.keep(sure.unionByName(edge), "mix")
    return mixed.orderBy("virtual_finish", "source", "doc_id", "copy_no"), _report(t, d, mixed)


def _report(targets: DataFrame, docs: DataFrame, mixed: DataFrame) -> DataFrame:
    have = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    used = mixed.groupBy("source").agg(F.count("*").alias("used_docs"), F.sum("n_tokens").alias("used_tokens"), F.max("copy_no").alias("last"))
    all_used = F.sum("used_tokens").over(W.partitionBy(F.lit(1)))  # over one row a target
    zero = F.lit(0).cast("bigint")
    return (
        targets.join(have, "source", "left")
        .join(used, "source", "left")
        .select(
            "source", "target_share", "max_repeats", F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("n_tokens", zero).alias("n_tokens"),
            F.coalesce("used_docs", zero).alias("used_docs"), F.coalesce("used_tokens", zero).alias("used_tokens"),
            F.coalesce(F.col("last") + 1, F.lit(0)).alias("copies_begun"),
            F.coalesce(F.col("used_tokens") / all_used, F.lit(0.0)).alias("actual_share"),
        )
    )
