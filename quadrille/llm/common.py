"""What the operators share: tables, the shared folder, Arrow batches and labelled samples."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python; long texts make smaller batches.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Small Arrow batches, where the session sets none itself (the setting is read when a query runs, so it stays); Python
    workers on this machine find this library wherever the driver was started."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    own = spark.conf.getAll
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if key not in own:
            spark.conf.set(key, str(value))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.
    Only a local master (tests), whose executors are this process, may do without: it gets a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        told = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = told.get() if told.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/quadrille-shared"
    return f"{base.rstrip('/')}/quadrille/{name}-{uuid.uuid4().hex}"


_left: dict[str, tuple] = {}  # paths that are deleted when the driver ends, if nothing has deleted them before


def delete_later(spark: SparkSession, path: str) -> None:
    if not _left:
        atexit.register(delete_left)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    _left[path] = (where, spark._jsc.hadoopConfiguration())


def delete_left() -> None:
    while _left:
        _, (where, conf) = _left.popitem()
        with contextlib.suppress(Exception):  # the JVM may have ended before
            where.getFileSystem(conf).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    delete_later(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that stored() wrote and nothing reads any more."""
    where, conf = _left.pop(df.stored_at)
    where.getFileSystem(conf).delete(where, True)


def map_rows(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """mapInArrow over small batches; work returns a column of values for each field of schema."""
    small_batches(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            made = work(batch)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 3; 1 marks the held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y, text): at most `most` labelled rows, whatever the order and number of rows: those of the ids that come first in
    order of a hash of the id. Ids with a null or contradicting label are left out; an id counts once, with the text (not
    null) whose hash is least."""
    one = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).alias("y2")).where("y = y2")
    )
    ids = F.broadcast(one.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # two numbers a row
    rows = docs.where("text is not null").select("doc_id", "text").join(ids, "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
