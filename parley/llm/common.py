"""What the training-data operators share: shared storage, Arrow helpers, bucketed blobs."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import shared_dir, small_batches  # noqa: F401 - the operators take the latter from here


#: What may be broadcast, as it is estimated: a hash table of that many bytes takes several times as much of the driver's memory while it is made.
BROADCAST_BYTES = 16 << 20


def unused(df: DataFrame, name: str) -> str:
    """The name, or with underscores before it until no column of the DataFrame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: lineage is cut, and a lost executor costs nothing.

    With `by`, a string column, the rows are laid out in one folder for each of its values.
    The file's life is that of the application: it is deleted when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._parley_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what `materialise` wrote."""
    path = getattr(df, "_parley_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], copies: str, how: str, broadcast_bytes: int, width: int = 100) -> DataFrame:
    """Rows with their class by equal `keys`; column `copies` of a class tells how many rows have it.

    Classes are broadcast if they fit `broadcast_bytes` at `width` bytes each. Beyond
    that the largest are, of which there are fewer than 50,000, as their copies add
    up to no more than the rows, and only the rest is joined by a shuffle, so no task
    gets all rows of a hot class.
    """
    n, total = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum(copies), F.lit(0))).first()
    if n * width <= broadcast_bytes:
        return rows.join(F.broadcast(classes), keys, how)
    bound = total // 50_000
    first = rows.join(F.broadcast(classes.where(F.col(copies) > bound)), keys, "left")
    found = F.col(copies).isNotNull()
    rest = first.where(~found).select(rows.columns)
    return first.where(found).unionByName(rest.join(classes.where(F.col(copies) <= bound), keys, how))


def empty(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


def blobs(bucket: np.ndarray, parts: int, record: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Structured records split by bucket: the non-empty buckets and their packed bytes."""
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(parts + 1))
    record = record[order]
    used = np.flatnonzero(np.diff(edge))
    return used.tolist(), [record[edge[b] : edge[b + 1]].tobytes() for b in used]


def input_bytes(df: DataFrame) -> int:
    """How much a DataFrame holds, for choosing how finely to split work: Catalyst's estimate, at most what its sources hold; measured where a source has no statistics."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sources = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if sources < 1 << 60:
        return min(int(plan.stats().sizeInBytes()), sources)
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0])


def parts_for(df: DataFrame, per_part: int, least: int = 1) -> int:
    """How many buckets give about `per_part` bytes of input each; at least the session's shuffle partitions."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // per_part))


def lower_ascii(c):
    """Lowers ASCII letters only, as the text kernel does."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
