"""Paired contrasts with missing values, capacity roll-ups and projections, planning bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Contrasts between the four groups of a 2 x 2 design (C neither, D support, E frame, F both), fixed values.
CONTRASTS = {
    "support_direct": {"D": 1.0, "C": -1.0},
    "support_when_framed": {"F": 1.0, "E": -1.0},
    "frame_without_support": {"E": 1.0, "C": -1.0},
    "frame_with_support": {"F": 1.0, "D": -1.0},
    "support_main_effect": {"D": 0.5, "C": -0.5, "F": 0.5, "E": -0.5},
    "frame_main_effect": {"E": 0.5, "C": -0.5, "F": 0.5, "D": -0.5},
    "interaction": {"F": 1.0, "E": -1.0, "D": -1.0, "C": 1.0},
}
# Planning coefficients (low, high) of a staged token estimate, by stage and driver.
BANDS = {
    "initial": {"chars": (0.75, 1.60), "claims": (90, 260), "sources": (250, 800), "fixed": (1200, 3200), "v1": (300, 900)},
    "v2": {"v2": (2600, 8000), "live": (1500, 5000)},
    "v3": {"v3": (7000, 22000), "cards": (250, 900)},
}


def group_means(long: DataFrame) -> DataFrame:
    """Per (field, grp) of ``long`` (case_id, grp, field, value): mean, n_observed, n_missing, total (null if none)."""
    return long.groupBy("field", "grp").agg(
        F.avg("value").alias("mean"),
        F.count("value").alias("n_observed"),
        (F.count("*") - F.count("value")).alias("n_missing"),
        F.sum("value").alias("total"),
    )


def contrasts(long: DataFrame) -> DataFrame:
    """Per (field, effect): the mean over cases of the case's weighted contrast, with the cases it is complete in.

    A case counts for an effect only if it has a value in every group the effect weighs; n_missing counts the
    others. Negative zero comes out as zero."""
    wide = long.groupBy("field", "case_id").pivot("grp", ["C", "D", "E", "F"]).agg(F.first("value", ignorenulls=True))
    effects = [
        F.struct(F.lit(name).alias("effect"), sum((F.col(g) * w for g, w in weights.items()), F.lit(0.0)).alias("value"))
        for name, weights in CONTRASTS.items()
    ]
    e = wide.select("field", F.explode(F.array(*effects)).alias("e")).select("field", "e.effect", "e.value")
    return e.groupBy("field", "effect").agg(
        (F.avg("value") + F.lit(0.0)).alias("estimate"), F.count("value").alias("n_complete"), (F.count("*") - F.count("value")).alias("n_missing")
    )


def varying_within(df: DataFrame, case: str, values: list[str]) -> DataFrame:
    """Cases in which a value that must be the same in all rows is not: case, column, n_values."""
    v = df.select(case, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in values])).alias("v"))
    d = v.select(case, "v.name", "v.value").filter("value is not null").distinct()
    return d.groupBy(case, "name").agg(F.count("*").alias("n_values")).filter("n_values > 1")


def storage_rollup(df: DataFrame, group: str, size: str, groups: DataFrame) -> DataFrame:
    """Count, sum and largest size per group of the dimension ``groups`` (group), groups without rows as zeros."""
    s = df.groupBy(group).agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"), F.max(size).alias("largest"))
    zero = F.lit(0).cast("bigint")
    return groups.select(group).join(s, group, "left").select(group, *[F.coalesce(c, zero).alias(c) for c in ("n_files", "n_bytes", "largest")])


def scaled(value: Column, target: int, sample: int) -> Column:
    """value * target / sample, rounded up, in integers."""
    n = value.cast("bigint") * target + (sample - 1)
    return ((n - F.pmod(n, F.lit(sample))) / sample).cast("bigint")


def budget_state(used: Column, soft: int, hard: int) -> Column:
    return F.when(used > hard, "blocked").when(used > soft, "warning").otherwise("within")


def token_bands(**drivers: Column) -> Column:
    """Low and high planning estimate of each stage and their sum, as a struct of whole numbers.

    Drivers: chars, claims, sources, v1, v2, v3, live, cards. Every product is rounded up by itself."""
    known = drivers | {"fixed": F.lit(1)}
    out, total = [], {}
    for stage, parts in BANDS.items():
        for k, name in enumerate(("low", "high")):
            whole = [F.ceil(known[d].cast("double") * F.lit(float(rate[k]))).cast("bigint") for d, rate in parts.items()]
            band = sum(whole[1:], whole[0])
            total[name] = total[name] + band if name in total else band
            out.append(band.alias(f"{stage}_{name}"))
    return F.struct(*out, *[c.alias(f"total_{name}") for name, c in total.items()])
