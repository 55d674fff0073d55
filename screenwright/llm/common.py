"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) mod FOLDS is HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession, prefix: str) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; a temporary one only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and (not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master):
        raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
    return named or tempfile.mkdtemp(prefix=prefix)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared(df.sparkSession, "screenwright-llm-"))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables of one run, below the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _shared(spark, "screenwright-llm-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4()}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``scratch`` once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a row belongs to the fold that is never learned from; false for a null id."""
    own = F.crc32(doc_id.cast("string").cast("binary")) % folds
    return F.coalesce(own == fold, F.lit(False))


def learnable(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether labels of this row may be learned; false for a null id."""
    return doc_id.isNotNull() & ~held_out(doc_id, folds, fold)


_held: dict[Hashable, object] = {}


def held(key: Hashable, build: Callable[[], object]):
    """What ``build`` makes, kept in this Python worker for its next tasks until they ask for something else.

    Spark's workers serve one stage after the other, so what each of them kept for itself would add up.
    """
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def let_go() -> None:
    """Drop what earlier stages have left in this Python worker; for stages that keep nothing."""
    _held.clear()
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the values of a string column stay near ``max_bytes`` per slice; a row is never cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        start = total = 0
        for i, size in enumerate(sizes.to_pylist()):
            if i > start and (total + size > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings; null is the empty text."""
    return [value or "" for value in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
