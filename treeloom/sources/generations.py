"""Tables of one generation, written to the folder that all executors share and read from there.

A graph is asked many questions between two builds; written once, each question starts from a plain scan, and a lost
executor costs no rebuild.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: dict[tuple, str] = {}
#: For each table that once() is making in this thread, the paths of what is written on the way.
_MAKING = threading.local()

#: How much larger rows are in a join's hash table than in the columns of a written file: ids there are mostly runs.
IN_MEMORY = 64
_FACTOR = "spark.sql.sources.fileCompressionFactor"
#: What a join may broadcast on the sizes that its shuffles had. Both sides are shuffled by then, so little is won, and the
#: driver makes a hash table some times larger than the rows.
_SHUFFLED, MOST_SHUFFLED = "spark.sql.adaptive.autoBroadcastJoinThreshold", "1m"
_PLANNED, _DEFAULT = "spark.sql.autoBroadcastJoinThreshold", "10485760b"
#: Shuffled rows go when the job that asked for them ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables of one generation are read far less often than they lie on disk.
CODEC = "zstd"


def _honest(spark: SparkSession) -> None:
    """Sizes of files are guessed as they are in memory, else millions of ids pass for a table to broadcast by the driver.

    A threshold that the session has set itself stays.
    """
    if float(spark.conf.get(_FACTOR, "1.0")) < IN_MEMORY:
        spark.conf.set(_FACTOR, f"{IN_MEMORY}.0")
    if spark.conf.get(_CLEANUP, None) is None:
        spark.conf.set(_CLEANUP, "true")
    if spark.conf.get(_SHUFFLED, None) is None and spark.conf.get(_PLANNED) == _DEFAULT:
        spark.conf.set(_SHUFFLED, MOST_SHUFFLED)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset and all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="treeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, where a table of few row groups would leave most of them idle; a large one stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


#: Rows of a few columns that the driver can hand to all executors, whatever the size of the input.
FEW = 50_000


def few(df: DataFrame) -> DataFrame:
    """df, written, and marked for a broadcast where it has few rows: what it meets is then not shuffled."""
    rows = written(df)
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _write(df: DataFrame) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    _honest(spark)
    df.write.option("compression", CODEC).parquet(path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own: later plans neither repeat nor contain what made it. Made on the way to a table of once(),
    it goes as soon as that is there."""
    path = _write(df)
    if making := getattr(_MAKING, "paths", None):
        making[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make() as a table; what was written on the way goes. make: gives the rows and keeps none of its tables."""
    making = _MAKING.paths = getattr(_MAKING, "paths", [])
    making.append([])
    try:
        df = make()
        path = _write(df)
    finally:
        for gone in making.pop():
            _drop(SparkSession.active(), gone)
    if making:
        making[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a key, made on first use by this application. make: gives the rows and keeps none of its tables."""
    key = (spark.sparkContext.applicationId, *key)
    _honest(spark)
    if key not in _WRITTEN:
        making = _MAKING.paths = getattr(_MAKING, "paths", [])
        making.append([])
        try:
            _WRITTEN[key] = _write(make())
        finally:
            for path in making.pop():
                _drop(spark, path)
    return spark.read.parquet(_WRITTEN[key])


def drop(spark: SparkSession, key: tuple) -> None:
    """Forget a table of once() that nothing reads any more; who asks again makes it again."""
    path = _WRITTEN.pop((spark.sparkContext.applicationId, *key), None)
    if path is not None:
        _drop(spark, path)
