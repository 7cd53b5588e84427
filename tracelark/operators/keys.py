"""Keys: duplicate groups, conflicts, first occurrences, dangling references, agreement of counts and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelark.session import Scratch


def duplicate_members(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of every group of two or more equal keys, with group_size and first (the group's smallest ``order``).

    Group sizes are counted with partial sums, so no group has to fit in a task, and written: the join back then
    has a plain exchange on either side, whose hot partitions the adaptive planner splits. Rows with a null key
    belong to no group."""
    df = df.dropna(subset=key)
    g = df.groupBy(*key).agg(F.count("*").alias("group_size"), F.min(order).alias("first")).filter("group_size > 1")
    return df.join(Scratch(df.sparkSession, "groups").keep(g), key)


def later_copies(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows whose key an earlier row has, i.e. all but the first of each group."""
    return duplicate_members(df, key, order).filter(F.col(order) > F.col("first"))


def conflicts(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one distinct value, and how many."""
    pairs = df.dropna(subset=[*key, value]).select(*key, value).distinct()
    return pairs.groupBy(*key).agg(F.count("*").alias("n_values")).filter("n_values > 1")


def dangling(df: DataFrame, ref: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target row; null references are no references.

    The targets' distinct keys are written, so that a reference that many rows share is split (see ``duplicate_members``)."""
    known = Scratch(df.sparkSession, "targets").keep(target.select(F.col(key).alias(ref)).dropna().distinct())
    return df.filter(F.col(ref).isNotNull()).join(known, ref, "left_anti")


def agreement(declared: DataFrame, actual: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Keys whose declared count differs from the actual one; undeclared keys are skipped."""
    a = actual.select(key, F.col(n).alias("actual"))
    d = declared.filter(F.col(n).isNotNull()).select(key, F.col(n).alias("declared"))
    return d.join(a, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).filter("declared <> actual")


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same elements, regardless of order and repeats."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def merge_versions(existing: DataFrame, batch: DataFrame, key: str, labels: str) -> DataFrame:
    """Idempotent union by key: known rows stay and gather the batch's labels, unknown ones are added.

    ``labels`` is an array column, kept sorted and distinct."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    cols = [c for c in existing.columns if c not in (key, labels)]
    merged = both.groupBy(key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(labels)))).alias(labels),
        *[F.min_by(c, "_new").alias(c) for c in cols],
    )
    return merged.select(*existing.columns)


def doubly_weighted(members: DataFrame, cluster: str, digest: str, score: str) -> DataFrame:
    """Clusters in which the same content counts more than once with a positive score, and how many contents do.

    Members without score or content do not count."""
    d = members.filter((F.col(score) > 0) & F.col(digest).isNotNull()).groupBy(cluster, digest).agg(F.count("*").alias("_n"))
    return d.filter("_n > 1").groupBy(cluster).agg(F.count("*").alias("n_contents"))


#: Positions of one window of ``with_before``; a part of any size is cut into such spans.
SPAN = 1_000_000


def with_before(df: DataFrame, position: str, value: str, part: list[str], span: int = SPAN) -> DataFrame:
    """``df`` with before: the value of the row before, by integer position within a part; null for the first.

    Rows are windowed by part and span of positions, so a part with a third of all rows is no single task. What
    the first row of a span follows is the last row of the nearest span before it, from a table of one row a span."""
    d = df.withColumn("_span", F.floor(F.col(position) / span))
    ends = d.groupBy(*part, "_span").agg(F.max_by(value, position).alias("_end"))
    ends = ends.withColumn("_carry", F.lag("_end").over(W.partitionBy(*part).orderBy("_span"))).drop("_end")
    w = W.partitionBy(*part, "_span").orderBy(position)
    d = d.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    same = [d[c].eqNullSafe(ends[c]) for c in part] + [d["_span"] == ends["_span"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    j = d.join(ends, on, "left").select(*[d[c] for c in df.columns], F.when(d["_first"], ends["_carry"]).otherwise(d["_lag"]).alias("before"))
    return j


def out_of_order(df: DataFrame, position: str, value: str, part: list[str]) -> DataFrame:
    """Rows whose value is smaller than that of the row before, by position within a part."""
    return with_before(df, position, value, part).filter(F.col(value) < F.col("before"))


def gaps(df: DataFrame, position: str, part: list[str]) -> DataFrame:
    """Places where consecutive numbers of a part leave some out: part, last number before, next number, how many."""
    return (
        with_before(df.select(*part, position), position, position, part)
        .filter(F.col(position) - F.col("before") > 1)
        .select(*part, "before", position, (F.col(position) - F.col("before") - 1).alias("n_missing"))
    )


def ordinals(df: DataFrame, position: str, span: int = SPAN) -> DataFrame:
    """``df`` with ordinal: the rank of its row by integer position, from 1, over all rows; positions must be unique.

    Rows are numbered within spans of positions, and spans by the counts of those before them, a table of one row a span."""
    d = df.withColumn("_span", F.floor(F.col(position) / span))
    counts = d.groupBy("_span").agg(F.count("*").alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    begins = counts.select("_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    d = d.withColumn("_k", F.row_number().over(W.partitionBy("_span").orderBy(position)))
    return d.join(begins, "_span").select(*df.columns, (F.col("_begin") + F.col("_k")).alias("ordinal"))


def snapshot_links(rows: DataFrame, discovery: DataFrame, key: str, entity: str, labels: str) -> DataFrame:
    """(key, code): rows whose ``entity`` no snapshot has (NOT_IN_DISCOVERY), that link to no known snapshot or to an
    unknown one (SNAPSHOT_LINK_MISSING), or whose known linked snapshots all lack the entity (DISCOVERY_LINK_MISMATCH).

    ``labels`` is an array column of snapshot ids; ``discovery``: snapshot_id, ``entity``. Both sides are reduced before
    they meet; the snapshots themselves are few and known by name."""
    scratch = Scratch(rows.sparkSession, "snapshots")
    have = scratch.keep(discovery.select("snapshot_id", entity).dropna().distinct())
    known = have.select("snapshot_id").distinct().withColumn("_known", F.lit(True))
    anywhere = scratch.keep(have.select(entity).distinct().withColumn("_any", F.lit(True)))
    links = rows.select(key, entity, F.explode_outer(F.array_distinct(labels)).alias("snapshot_id"))
    j = links.join(known, "snapshot_id", "left").join(have.withColumn("_has", F.lit(True)), ["snapshot_id", entity], "left")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    g = j.groupBy(key, entity).agg(
        F.bool_or(true("_known")).alias("_some"), F.bool_or(F.col("snapshot_id").isNotNull() & ~true("_known")).alias("_unknown"), F.bool_or(true("_has")).alias("_hit")
    )
    g = g.join(anywhere, entity, "left")
    linked = F.col("_some") & ~F.col("_unknown")
    codes = F.array(
        F.when(F.col("_any").isNull(), "NOT_IN_DISCOVERY"), F.when(~linked, "SNAPSHOT_LINK_MISSING"), F.when(linked & ~F.col("_hit"), "DISCOVERY_LINK_MISMATCH")
    )
    return g.select(key, F.explode(F.array_compact(codes)).alias("code"))


def locator_links(refs: DataFrame, chunks: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, code, n): locators (``refs``: key, loc struct) whose chunk_id no chunk has (LOCATOR_MISSING) or whose chunk
    differs in any of ``fields`` (LOCATOR_MISMATCH). ``chunks``: loc struct with chunk_id unique; null equals null."""
    c = Scratch(refs.sparkSession, "chunks").keep(chunks.select(F.col("loc.chunk_id").alias("chunk_id"), F.col("loc").alias("want")).filter("chunk_id is not null"))
    j = refs.select(key, "loc", F.col("loc.chunk_id").alias("chunk_id")).join(c, "chunk_id", "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"loc.{f}").eqNullSafe(F.col(f"want.{f}"))
    code = F.when(F.col("want").isNull(), "LOCATOR_MISSING").when(~same, "LOCATOR_MISMATCH")
    return j.select(key, code.alias("code")).filter("code is not null").groupBy(key, "code").agg(F.count("*").alias("n"))


def provenance_gaps(rows: DataFrame, key: str, fields: dict[str, str], targets: DataFrame) -> DataFrame:
    """(key, field, n_missing): how many references of each field (array or text column) no target of its kind has.

    ``fields``: column name to kind; ``targets``: kind, ref. All fields are one scan and one join with the union of all
    targets; references are counted per row only where they are missing."""
    have = Scratch(rows.sparkSession, "targets").keep(targets.select("kind", "ref").dropna().distinct())
    as_array = lambda c: F.col(c) if dict(rows.dtypes)[c].startswith("array") else F.array(c)
    each = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.coalesce(as_array(c), F.array().cast("array<string>")) for c in fields]))
    kinds = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])
    r = rows.select(key, F.explode(each).alias("field", "refs")).select(key, "field", F.explode("refs").alias("ref")).filter("ref is not null")
    missing = r.withColumn("kind", kinds[F.col("field")]).join(have, ["kind", "ref"], "left_anti")
    return missing.groupBy(key, "field").agg(F.count("*").alias("n_missing"))


def list_order(c: Column) -> Column:
    """What breaks a sorted list without repeats: REPEATED, UNSORTED or null."""
    return F.when(F.size(F.array_distinct(c)) < F.size(c), "REPEATED").when(F.array_sort(c) != c, "UNSORTED")


def capped_top(df: DataFrame, group: str, order: list[Column], per_group: int, total: int) -> DataFrame:
    """Greedy top rows: in ``order``, at most ``per_group`` of a group and ``total`` in all.

    Equivalent to two ranks. The first keeps only per_group rows of a group in each map task before the shuffle
    (window group limit), the second works on what is left of all groups, also limited before it is gathered."""
    a = df.withColumn("rank_in_group", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rank_in_group") <= per_group)
    return a.orderBy(*order).limit(total)
