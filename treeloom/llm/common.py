"""What the operators of this subpackage share: shared-folder checkpoints and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that one step of a Python worker holds; a single longer text is a step of its own.
STEP_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where that is unset and all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="treeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What a query within shuffles goes when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(FREES_SHUFFLES, "false")
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREES_SHUFFLES, before)


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, whoever is lost later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables that materialize() gave, once nothing that is still to be computed reads them."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Key of a row within a stage, whatever its doc_id.
ROW = "_row"


def sealed(docs: DataFrame, known: Sequence[str] = ("doc_id", "text", "n_chars")) -> DataFrame:
    """docs with a key of each row's own, and with all columns but the known ones renamed, so that no name clashes.

    A table read from files has such keys: the file and the row's number in it. Any other is written, with numbers.
    """
    names = [c if c in known else f"c{i}" for i, c in enumerate(docs.columns)]
    if "_metadata" not in docs.columns and docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and docs.inputFiles():
        key = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return docs.select("*", key).toDF(*names, ROW)
    plain = docs.toDF(*names)
    return materialize(plain.withColumn(ROW, F.struct(F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("at"))))


def unsealed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, named as they were, of rows that sealed() gave."""
    return rows.select(*rows.columns[: len(docs.columns)]).toDF(*docs.columns)


def order_of(row: str) -> list[Column]:
    """By which rows come first: by doc_id, those without one last, then by their key."""
    return [F.isnull("doc_id").alias("without"), F.col("doc_id"), F.col(row)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose column holds about limit bytes each, so that memory follows the limit, not the batch."""
    values = batch.column(column)
    is_list = pa.types.is_list(values.type)
    sizes = pa.compute.multiply(pa.compute.list_value_length(values), 8) if is_list else pa.compute.binary_length(values)
    start, held = 0, 0
    for at, n in enumerate(pa.compute.fill_null(sizes, 0).to_pylist()):
        if at > start and held + n > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def fields(df: DataFrame, keep: Sequence[str], more: str) -> StructType:
    """The named columns of df, then those of a DDL string."""
    return StructType([df.schema[n] for n in keep] + StructType.fromDDL(more).fields)


def column_of(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, np.ndarray) and values.ndim == 2:
        flat = pa.array(values.ravel(), type=kind.value_type)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], type=pa.int32()), flat, type=kind)
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and what one stage took would count against the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ragged(flat: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """A list column: row i holds flat[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, Iterable]], schema: str | StructType, column: str = "text") -> DataFrame:
    """df.mapInArrow(), a step of bounded size at a time; fn returns the columns of schema."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, column):
                out = fn(part)
                yield pa.RecordBatch.from_arrays([column_of(out[f.name], f.type) for f in arrow], schema=arrow)
            give_back()

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, by: str, keys: Sequence[str], most: int) -> DataFrame:
    """Per value of `by` the `most` distinct rows of `keys` with the smallest hash: the same in every run, at any size.

    Distinct hashes are counted first; only rows under the hash that about 4 * most of a value lie under are then made
    distinct and ranked, so that what is shuffled and ranked does not grow with the table, nor with repeated rows. `by`
    has few values (classes, languages).
    """
    hashed = F.xxhash64(*keys)
    shares = {r[0]: min(1.0, (4.0 * most + 64) / max(1, r[1])) for r in df.groupBy(by).agg(F.approx_count_distinct(hashed)).collect() if r[0] is not None}
    share = F.create_map([F.lit(x) for pair in shares.items() for x in pair])[F.col(by)] if shares else F.lit(0.0)
    under = F.pmod(hashed, F.lit(1 << 30)) < share * float(1 << 30)
    at = Window.partitionBy(by).orderBy(hashed, *keys)
    once = df.filter(under).dropDuplicates([by, *keys])
    return once.withColumn("_rank", F.row_number().over(at)).filter(F.col("_rank") <= most).drop("_rank")
