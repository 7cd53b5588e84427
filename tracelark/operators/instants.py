"""Mixed timestamp texts to UTC instants through a dictionary of distinct values.

A raw text, together with the zone and date order that its source lends it, is parsed once. The
dictionary is a table that grows by what a batch brings new, so later batches parse only unseen
texts; rows get their instants back by a join on the dictionary key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.functions.timestamps import known_zone, prepared, with_instant
from tracelark.session import Scratch

KEY = ["raw", "zone", "date_order"]
#: Generation of the notations; a dictionary of another generation is not read.
NOTATIONS = 2
#: Session setting that names a folder for a dictionary that lasts.
PATH_SETTING = "spark.tracelark.instants.dir"


class InstantDictionary:
    """Persistent dictionary (raw, zone, date_order, k1, k2, utc_micros) below ``path``, one folder a batch.

    Texts are keyed by two independent 64-bit hashes over raw text, zone and order, nulls included. A batch's folder
    counts once it is complete. Writers that run at the same time may both add a key, with the same instant; whoever
    reads reduces by key."""

    SCHEMA = "raw string, zone string, date_order string, k1 bigint, k2 bigint, utc_micros bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/b-*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(s.getPath().getParent().toString() for s in found or [])

    def read(self) -> DataFrame:
        """All entries, each key once."""
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], self.SCHEMA)
        entries = self.spark.read.schema(self.SCHEMA).parquet(*batches)
        return entries.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in [*KEY, "utc_micros"]]).select(*KEY, "k1", "k2", "utc_micros")

    def update(self, keyed: DataFrame) -> DataFrame:
        """Adds the unseen keys of ``keyed`` (raw, zone, date_order, k1, k2); returns (k1, k2, utc_micros) of all its keys, as a written table.

        A repeated batch adds nothing."""
        scratch = Scratch(self.spark, "instants")
        keys = scratch.keep(keyed.groupBy("k1", "k2").agg(*[F.min(c).alias(c) for c in KEY]), "keys")
        known = scratch.keep(keys.select("k1", "k2").join(self.read().select("k1", "k2", "utc_micros"), ["k1", "k2"]), "known")
        fresh = keys.join(known.select("k1", "k2"), ["k1", "k2"], "left_anti").withColumn("text", prepared(F.col("raw")))
        parsed = with_instant(fresh, "text", F.col("zone"), F.col("date_order"), "utc_micros").select(*KEY, "k1", "k2", "utc_micros")
        batch = f"{self.path}/b-{uuid.uuid4().hex}"
        parsed.write.parquet(batch)
        scratch.drop(keys)
        return known.unionByName(self.spark.read.schema(self.SCHEMA).parquet(batch).select("k1", "k2", "utc_micros"))


def keyed_values(values: DataFrame) -> DataFrame:
    """``values`` (raw, zone, date_order, ...) with hash key; unknown zones and orders count as absent."""
    v = values.withColumn("zone", F.when(known_zone(F.col("zone")), F.col("zone"))).withColumn(
        "date_order", F.when(F.col("date_order").isin("DMY", "MDY"), F.col("date_order"))
    )
    parts = [F.coalesce(F.col(c), F.lit("")) for c in KEY]
    return v.withColumn("k1", F.xxhash64(F.lit(1), *parts)).withColumn("k2", F.xxhash64(F.lit(2), *parts))


def own_dictionary(spark: SparkSession) -> str:
    """A folder for a dictionary: the one that the setting PATH_SETTING names, with the generation of the notations, else a
    new one among the scratch tables. Only with the setting do later calls find what earlier ones have parsed."""
    named = spark.conf.get(PATH_SETTING, None)
    return f"{named.rstrip('/')}/{NOTATIONS}" if named else f"{Scratch(spark, 'dictionary').root}/instants"


def normalise_instants(spark: SparkSession, values: DataFrame, path: str | None = None) -> DataFrame:
    """``values`` (field_name, line_no, raw, zone, date_order) with utc_micros, only rows that name an instant.

    Null, blank and unreadable texts, impossible dates and local times of an unknown zone name none. Repeated
rows stay repeated. ``path`` is the dictionary's folder, which every call with it extends: a text is parsed by the batch
    that brings it first. Without it the call has a dictionary of its own, which goes with its scratch tables.
    """
    keyed = keyed_values(values.filter("raw is not null"))
    named = InstantDictionary(spark, path or own_dictionary(spark)).update(keyed)
    # Both sides are plain exchanges, so the partition of a text that many rows hold is split.
    return keyed.join(named.filter("utc_micros is not null"), ["k1", "k2"]).select("field_name", "line_no", "utc_micros")
