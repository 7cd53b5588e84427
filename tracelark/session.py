"""Session settings and the shared scratch area that cuts lineage.

Long iterative plans are cut by writing a table into the folder the cluster names in
``spark.checkpoint.dir``. A written table survives the loss of any executor, gives the
optimizer real sizes, and can be dropped as soon as the next round has been written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tracelark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword names use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


#: Folders made where a session names none, by application.
_own: dict[str, str] = {}
#: Roots of the scratch tables of the open scopes, innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. One is made only where the setting is absent and driver and executors are one machine
    (tests, a laptop); on a cluster its absence is an error, since no folder of a single machine would do."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tracelark-")
            atexit.register(_remove, spark, _own[app])
        at = _own[app]
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables of what runs inside when it ends, so that a long session keeps none of them.

    Frames returned inside must be written or collected inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for root in _scopes.pop():
            _remove(spark, root)


class Scratch:
    """Tables of one run below the shared folder.

    ``keep`` writes a frame and reads it back; ``drop`` removes a table that a later
    round has replaced. Whatever remains goes with the enclosing ``scope``, else when the driver
    ends, since the frame returned to the caller still reads it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tracelark/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        if _scopes:
            _scopes[-1].append(self.root)
        else:
            atexit.register(_remove, spark, self.root)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def counted(self, df: DataFrame, name: str = "t", **measures: Column) -> tuple[DataFrame, dict[str, int]]:
        """``keep`` with aggregates of the rows written, observed by the same job: n, and one for each of ``measures``."""
        seen = Observation()
        out = self.keep(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()]), name)
        return out, seen.get

    def drop(self, df: DataFrame | None) -> None:
        if df is not None and (p := self._paths.pop(id(df), None)):
            _remove(self.spark, p)
