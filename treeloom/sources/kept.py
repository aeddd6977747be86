"""Built graphs kept on disk: one for a root's working tree, which goes stale, and one for each base commit, which does not.

A graph is written beside the one that is served, and then published by renaming a small file, so that a reader sees the
old graph or the new one. A build that fails leaves the old one in place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import cache_dir, kept_path

Tables = dict[str, DataFrame]


def fingerprint(spark: SparkSession, root: str) -> str:
    """What the files of a root that count look like: how many, how large, how new. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    below = F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?", "")
    rel = F.substring(below, F.lit(len(root.split("://", 1)[-1].rstrip("/")) + 2), F.length(below))
    kept = files.filter(kept_path(rel, ("target", "node_modules")))
    each = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    found = kept.agg(F.count("*").alias("n"), F.sum(each).alias("sum"), F.max("modificationTime").alias("newest")).first()
    return f"{found.n}:{found['sum']}:{found.newest}"


class _Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> str | None:
        if not self.system.exists(self.at(f"{self.path}/{name}")):
            return None
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}").collect())

    def publish(self, name: str, text: str) -> None:
        """Put a file in place whole, whatever stood there: written under another name, then renamed over it."""
        draft = f"{self.path}/_{uuid.uuid4().hex}"
        out = self.system.create(self.at(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(self.at(draft), self.at(f"{self.path}/{name}"), options)

    def drop(self, name: str) -> None:
        self.system.delete(self.at(f"{self.path}/{name}"), True)


def kept(spark: SparkSession, base: str, root: str, build: Callable[[], Tables], commit: str | None = None) -> Tables:
    """The tables of a root (or of its base commit), built only where none are kept or the root has changed since."""
    folder = _Folder(spark, cache_dir(base, root, commit))
    look = None if commit else fingerprint(spark, root)
    known = folder.read("current")
    about = json.loads(known) if known else None
    if about is None or about["look"] != look:
        fresh = {"look": look, "at": uuid.uuid4().hex, "tables": []}
        for name, table in build().items():
            table.write.parquet(f"{folder.path}/{fresh['at']}/{name}")
            fresh["tables"].append([name, table.schema.json()])
        folder.publish("current", json.dumps(fresh))
        # a reader of the last generation may still be at it; the one before goes
        if about is not None and about.get("before"):
            folder.drop(about["before"])
        about = fresh | {"before": about["at"] if about else None}
        folder.publish("current", json.dumps(about))
    from pyspark.sql.types import StructType

    return {name: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{folder.path}/{about['at']}/{name}") for name, schema in about["tables"]}
