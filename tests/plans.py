"""What executed plans look like."""

from contextlib import contextmanager


@contextmanager
def no_broadcasts(spark):
    """Joins as they are when no side is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plain_sides(df):
    """Whether every sort-merge join of an executed plan reads plain exchanges, which alone are split when skewed."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("== Initial Plan ==")[-1].split("\n")
    sides = 0
    for i, x in enumerate(lines):
        if "SortMergeJoin" in x:
            depth = x.index("SortMergeJoin")
            for k in range(i + 1, len(lines)):
                at = len(lines[k]) - len(lines[k].lstrip(" :+-|*()0123456789"))
                if at <= depth:
                    break
                if at == depth + 3 and "Sort " in lines[k]:
                    assert "Exchange" in lines[k + 1], (x, lines[k + 1])
                    sides += 1
    return sides
