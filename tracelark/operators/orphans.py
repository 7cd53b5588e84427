"""References to records that are missing, deleted or late, and what hangs from them.

The cascade starts from the direct orphans and walks down the foreign-key graph with
semi-joins until no further record is reached: a record that refers to an orphaned record
is indirectly orphaned. Its stride doubles from round to round (``lineage.reached``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.operators.lineage import reached
from tracelark.session import Scratch


def target_status(targets: DataFrame, deletions: DataFrame) -> DataFrame:
    """One row per (target_table, id): first_ts of its rows (null without a row), exists, first del_ts."""
    rows = targets.select("target_table", "id", "ts", F.lit(None).cast("timestamp").alias("del_ts"), F.lit(1).alias("row"))
    gone = deletions.select("target_table", "id", F.lit(None).cast("timestamp").alias("ts"), "del_ts", F.lit(0).alias("row"))
    return (
        rows.unionByName(gone)
        .filter("target_table is not null and id is not null")
        .groupBy("target_table", "id")
        .agg(F.min("ts").alias("first_ts"), F.min("del_ts").alias("del_ts"), (F.max("row") == 1).alias("there"))
    )


def judge(refs: DataFrame, status: DataFrame) -> DataFrame:
    """``refs`` with reason: deleted, missing, late or null where the reference resolves.

    The join is left to the adaptive planner: a reference used by a third of all rows is split as a
    skewed partition, a small status table is broadcast only after its size has been measured.
    """
    s = status.withColumnRenamed("id", "ref_value")
    deleted = F.col("del_ts") <= F.col("ref_ts")
    missing = ~F.coalesce("there", F.lit(False))
    late = F.col("first_ts") > F.col("ref_ts")
    return (
        refs.join(s, ["target_table", "ref_value"], "left")
        .withColumn("reason", F.when(deleted, "deleted").when(missing, "missing").when(late, "late"))
        .drop("first_ts", "del_ts", "there")
    )


def orphan_cascade(spark: SparkSession, refs: DataFrame, targets: DataFrame, deletions: DataFrame) -> DataFrame:
    """Direct and inherited orphan references.

    ``refs``: src_table, field_name, line_no, src_id, target_table, ref_value, ref_ts (other columns are
    dropped); blank references must be null and are ignored, repeats within a row count once.
    ``targets``: target_table, id, ts. ``deletions``: target_table, id, del_ts.

    Returns src_table, field_name, line_no, src_id, target_table, ref_value, ref_ts, reason, kind. kind is
    "direct" with a reason, or "inherited" with reason null for a reference that resolves to a record which
    is itself orphaned, at any distance. A missing time compares with nothing: such a reference can only
    be "missing". Empty inputs give an empty result.
    """
    scratch = Scratch(spark, "orphans")
    cols = ["src_table", "field_name", "line_no", "src_id", "target_table", "ref_value", "ref_ts"]
    refs = refs.select(*cols).filter("ref_value is not null and target_table is not null").distinct()
    # Written, so that the join below sees both sides as plain exchanges and can split a hot reference.
    status = scratch.keep(target_status(targets, deletions), "status")
    judged = scratch.keep(judge(refs, status), "judged")
    scratch.drop(status)

    node = lambda t, i: F.concat_ws("\x1f", t, i)
    own = judged.select("src_table").distinct()
    links = judged.filter("reason is null and src_id is not null").join(
        F.broadcast(own.withColumnRenamed("src_table", "target_table")), "target_table", "left_semi"
    )  # as many rows as there are referring tables, named by the caller
    edges = links.select(node("src_table", "src_id").alias("id"), node("target_table", "ref_value").alias("input"))
    seeds = judged.filter("reason is not null and src_id is not null").select(node("src_table", "src_id").alias("id"))
    mark = F.split(F.col("id"), "\x1f", 2)
    mark = reached(spark, edges, seeds).select(mark[0].alias("target_table"), mark[1].alias("ref_value"))
    direct = judged.filter("reason is not null").withColumn("kind", F.lit("direct"))
    inherited = judged.filter("reason is null").join(mark, ["target_table", "ref_value"], "left_semi").withColumn("kind", F.lit("inherited"))
    return direct.unionByName(inherited).select(*cols, "reason", "kind")
