"""Rules and reports: a rule is a condition with a code; a report is an aggregation over violations.

All rules of a table are one projection over one scan; their violations come out of one explode. Reports hold
codes, severities and counts, never content.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    code: str
    broken: Column
    severity: str = "error"


def violations(df: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """(*keys, code, severity), one row per broken rule of a row; a null condition is not broken."""
    hit = [F.when(r.broken, F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"))) for r in rules]
    return df.select(*keys, F.explode(F.array_compact(F.array(*hit))).alias("v")).select(*keys, "v.code", "v.severity")


def first_failure(rules: list[Rule]) -> Column:
    """Code of the first broken rule in order, null if all hold: for checks that stop at the first failure."""
    out = F.when(rules[0].broken, rules[0].code)
    for r in rules[1:]:
        out = out.when(r.broken, r.code)
    return out


def first_failing_row(df: DataFrame, rules: list[Rule], position: str) -> DataFrame:
    """The code of the first row, in order of ``position``, that breaks a rule: one row, null if none does."""
    f = df.select(position, first_failure(rules).alias("code")).filter("code is not null")
    return f.agg(F.min_by("code", position).alias("code"), F.min(position).alias(position))


def histogram(v: DataFrame, distinct: tuple[str, ...] = ()) -> DataFrame:
    """(code, severity, n): every violation counts, or with ``distinct`` every different combination of those columns."""
    if distinct:
        v = v.select(*distinct, "code", "severity").distinct()
    return v.groupBy("code", "severity").agg(F.count("*").alias("n"))


def status(v: DataFrame) -> DataFrame:
    """One row: errors, warnings, and failed, passed_with_warnings or passed."""
    s = v.agg(
        F.count(F.when(F.col("severity") == "error", 1)).alias("n_errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("n_warnings")
    )
    return s.withColumn(
        "status", F.when(F.col("n_errors") > 0, "failed").when(F.col("n_warnings") > 0, "passed_with_warnings").otherwise("passed")
    )


def first_disorder(steps: dict[str, Column]) -> Column:
    """The first pair of neighbouring steps, "a>b", that is not strictly in order of time; steps without a time are skipped."""
    names = list(steps)
    out = F.lit(None).cast("string")
    for j in range(len(names) - 1, 0, -1):
        earlier = F.coalesce(*[steps[n] for n in reversed(names[:j])])
        name = F.coalesce(*[F.when(steps[n].isNotNull(), n) for n in reversed(names[:j])])
        out = F.when(earlier >= steps[names[j]], F.concat(name, F.lit(">" + names[j]))).otherwise(out)
    return out


def safe_error(message: Column, instead: str) -> Column:
    """A message that is a code by its form (capitals, digits, underscore, semicolon, dash), else ``instead``: nothing of
    a record can get out through an error."""
    return F.when(message.rlike(r"\A[A-Z0-9_;-]+\z"), message).otherwise(instead)


def report_order(findings: DataFrame, *keys: str) -> DataFrame:
    """Distinct findings in the order of a report: nulls (whole files, whole records) first."""
    return findings.distinct().orderBy(*[F.asc_nulls_first(k) for k in keys])
