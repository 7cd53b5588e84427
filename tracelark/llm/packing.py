"""Filling fixed-capacity containers, by first-fit decreasing with a tournament tree (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelark.session import Scratch

CAPACITY = 2048
#: Documents of one randomised group, on average. The waste of a group is about one container.
GROUP_DOCS = 20_000


class FirstFit:
    """Containers in a tournament tree: every inner node holds the largest room below it, so that the first
    container with enough room is found in logarithmic time."""

    def __init__(self, capacity: int, most: int):
        self.capacity = capacity
        self.leaves = 1
        while self.leaves < max(1, most):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        at = i - self.leaves
        room[i] -= size
        i //= 2
        while i:
            best = room[2 * i] if room[2 * i] >= room[2 * i + 1] else room[2 * i + 1]
            if room[i] == best:
                break
            room[i] = best
            i //= 2
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item; sizes must be in decreasing order and at most ``capacity``."""
    tree = FirstFit(capacity, len(sizes))
    return [tree.place(s) for s in sizes]


def containers(sizes: DataFrame, n_docs: int, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = 17) -> DataFrame:
    """Assignment of documents to containers.

    ``sizes``: doc_id BIGINT, n_tokens BIGINT; ``n_docs`` is their number, from which follows the number of
    groups. Returns doc_id, part_no INT, token_start BIGINT, n_tokens BIGINT, group_id BIGINT, container_id
    STRING. A document above the capacity is divided: its full parts take a container each, where they are read, and only
    the rest is an item like others; so a group holds one item a document, however long. Every document comes out, also an
    empty one (size 0); a null size counts as 0. Groups are drawn by a hash of doc_id, so none depends on any attribute of
    the documents; a repeated doc_id is packed once for each row.
    """
    groups = max(1, -(-n_docs // group_docs))
    size = F.coalesce("n_tokens", F.lit(0)).cast("bigint")
    group = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups))
    d = sizes.select("doc_id", size.alias("n"), F.floor(size / capacity).cast("int").alias("whole"), group.alias("group_id"))
    d = Scratch(sizes.sparkSession, "sizes").keep(d)  # read twice below, counted once
    # The number of the row tells rows of one doc_id apart.
    full = d.withColumn("row", F.monotonically_increasing_id()).filter("whole > 0")
    full = full.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part_no"), "group_id", "row").select(
        "doc_id", "part_no", (F.col("part_no").cast("bigint") * capacity).alias("token_start"), F.lit(capacity).cast("bigint").alias("n_tokens"),
        "group_id", F.concat_ws("-", F.lit("full"), "row", "part_no").alias("container_id"),
    )
    rest = F.col("n") - F.col("whole") * capacity
    items = d.filter((rest > 0) | (F.col("whole") == 0)).select(
        "doc_id", F.col("whole").alias("part_no"), (F.col("whole").cast("bigint") * capacity).alias("token_start"), rest.cast("bigint").alias("n_tokens"), "group_id"
    )

    def pack(g):
        g = g.sort_values(["n_tokens", "doc_id", "part_no"], ascending=[False, True, True], kind="stable")
        at = first_fit_decreasing(g["n_tokens"].tolist(), capacity)
        g["container_id"] = [f"{x}-{b}" for x, b in zip(g["group_id"], at)]
        return g[["doc_id", "part_no", "token_start", "n_tokens", "group_id", "container_id"]]

    packed = items.groupBy("group_id").applyInPandas(
        pack, "doc_id bigint, part_no int, token_start bigint, n_tokens bigint, group_id bigint, container_id string"
    )
    return packed.unionByName(full)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per group: items, containers, tokens and the share of the containers' room that is used."""
    c = packed.groupBy("group_id", "container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return c.groupBy("group_id").agg(
        F.sum("items").alias("n_items"),
        F.count("*").alias("n_containers"),
        F.sum("used").alias("n_tokens"),
        (F.sum("used") / (F.count("*") * capacity)).alias("fill"),
    )
