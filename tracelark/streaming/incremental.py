"""Incremental ingest: files that arrive are merged into a versioned table, batch by batch, exactly once.

The reference semantics are those of a batch merge; Structured Streaming only supplies the list of new files and
the batch numbers. Each batch writes its own generation of the table and then moves a pointer file, so that a batch
which is repeated after a failure rewrites the same generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelark.operators.keys import merge_versions


class VersionedTable:
    """Generations of a table below ``path``; reading gives the last complete one."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, p: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        path, fs = self._fs(self.path)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[2:]) for n in names if n.startswith("g-") and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[0]))

    def read(self, before: int | None = None) -> DataFrame:
        g = [x for x in self.generations() if before is None or x < before]
        if not g:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/g-{g[-1]:09d}")

    def write(self, df: DataFrame, generation: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/g-{generation:09d}")


def merging(table: VersionedTable, key: str, labels: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch by key (see ``merge_versions``)."""

    def merge(batch: DataFrame, number: int) -> None:
        table.write(merge_versions(table.read(before=number), batch.select(*table.read(before=number).columns), key, labels), number)

    return merge


def ingest(spark: SparkSession, source: str, schema: str, table: VersionedTable, checkpoint: str, prepare, key: str, labels: str, files_per_batch: int = 1000):
    """Merges all files of ``source`` that have not been merged yet, then ends.

    ``prepare`` maps the stream of raw rows (``schema``) to rows of the table."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    q = (
        prepare(stream)
        .writeStream.foreachBatch(merging(table, key, labels))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return table.read()
