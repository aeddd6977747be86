"""Source trees as tables: files, their languages, manifests, freshness, and what may be served of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ("target", "node_modules", "__pycache__")
#: Larger files are not served.
MAX_SOURCE_BYTES = 2 << 20
#: Extension to language, and manifest to indexer in order of precedence.
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "sql": "sql"}
MANIFESTS = (("Cargo.toml", "rust-analyzer"), ("go.mod", "scip-go"), ("tsconfig.json", "scip-typescript"), ("package.json", "scip-typescript"))


class SourceError(Exception):
    """A file that cannot be served; `status` says why, as in HTTP."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def kept_path(path: Column, skipped: tuple[str, ...] = SKIPPED) -> Column:
    """No part of a relative path starts with a dot or is a build folder."""
    return ~F.exists(F.split(path, "/"), lambda p: p.startswith(".") | p.isin(*skipped))


def inside(path: Column) -> Column:
    """A relative path of plain parts."""
    return (path != "") & ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda p: p.isin("..", ".", ""))


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.create_map([F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext], F.lit("plain"))


def tree_order(path: Column) -> Column:
    """Sort key of a walk that lists directories before files, each by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.struct((i == F.size(parts) - 1).alias("is_file"), p.alias("name")))


def directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, size, modified, valid) of the files under a root, paths relative to it; what is not UTF-8 is not valid
    and has an empty text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.split("://", 1)[-1].rstrip("/") + "/")
    whole = F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?", "")
    rel = F.when(F.contains(whole, base), F.substring(whole, F.locate(root.split("://", 1)[-1].rstrip("/") + "/", whole) + F.length(base), F.length(whole))).otherwise(F.element_at(F.split("path", "/"), -1))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select(rel.alias("path"), F.coalesce(text, F.lit("")).alias("text"), text.isNotNull().alias("valid"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter(kept_path(F.col("path")))


def indexer_for(manifests: DataFrame) -> DataFrame:
    """(indexer): of the manifests (name) at a root, the first in precedence; none: no row."""
    order = F.create_map([F.lit(x) for i, (m, _) in enumerate(MANIFESTS) for x in (m, i)])
    tool = F.create_map([F.lit(x) for m, t in MANIFESTS for x in (m, t)])
    return manifests.select(tool[F.col("name")].alias("indexer"), order[F.col("name")].alias("at")).filter("at is not null").agg(F.min_by("indexer", "at").alias("indexer")).filter("indexer is not null")


def is_fresh(files: DataFrame, index_time: Column) -> DataFrame:
    """(fresh): is an index at least as new as the newest file that counts?"""
    kept = files.filter(kept_path(F.col("path"), ("target", "node_modules")))
    return kept.agg(F.coalesce(F.max("modified") <= index_time, F.lit(True)).alias("fresh"))


def cache_dir(base: str, root: str, commit: str | None = None) -> str:
    """Where an index of a root is kept: its own folder, and one for each base commit."""
    import hashlib

    key = hashlib.sha256(root.encode()).hexdigest()[:16]
    return f"{base.rstrip('/')}/{key}/{'base-' + commit if commit else 'working'}"


def read_source(files: DataFrame, path: str) -> str:
    """The text of one file, or a SourceError: outside the root, missing, too large, or not text."""
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in path.split("/")):
        raise SourceError(403, "outside the root")
    valid = F.col("valid") if "valid" in files.columns else F.col("text").isNotNull()
    row = files.filter(F.col("path") == path).select("text", "size", valid.alias("valid")).first()
    if row is None:
        raise SourceError(404, "no such file")
    if row["size"] is not None and row["size"] > MAX_SOURCE_BYTES:
        raise SourceError(413, "too large")
    if row["text"] is None or not row["valid"]:
        raise SourceError(415, "not text")
    return row["text"]
