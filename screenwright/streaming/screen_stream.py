"""Screening of a stream of raw texts with the same steps as the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from screenwright.operators.classifier import TfidfModel
from screenwright.operators.expect import document_checks, with_violation
from screenwright.plans.screen import ScreenSettings, result_columns, screen_raw

RAW_SCHEMA = "doc_id string, text string, source_type string, source_uri string"


def read_raw_stream(
    spark: SparkSession, path: str, file_format: str = "parquet", files_per_batch: int = 1000, schema: str = RAW_SCHEMA
) -> DataFrame:
    """Files of raw texts as they arrive, a bounded number of files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(path)


def read_json_stream(
    spark: SparkSession, path: str, files_per_batch: int = 1000, schema: str = RAW_SCHEMA, broken: str = "broken_line"
) -> DataFrame:
    """JSON lines as they arrive. A line that is no object of this shape is kept as it stands in column ``broken``."""
    reader = spark.readStream.schema(f"{schema}, {broken} string").option("maxFilesPerTrigger", files_per_batch)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).json(path)


def screen_stream(
    raw: DataFrame, settings: ScreenSettings = ScreenSettings(), model: TfidfModel | None = None
) -> DataFrame:
    """Result rows of a stream. All steps are row by row: no state, no watermark."""
    return result_columns(screen_raw(raw, settings, model=model))


def _start(stream: DataFrame, write_batch, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _write_results(results: DataFrame, decisions: str, spans: str, number: int) -> None:
    kept = results.persist()
    try:
        kept.drop("spans").write.mode("overwrite").parquet(f"{decisions}/batch={number}")
        kept.select("input_id", F.inline("spans")).write.mode("overwrite").parquet(f"{spans}/batch={number}")
    finally:
        kept.unpersist()


def write_stream(
    results: DataFrame, decisions: str, spans: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append decisions and spans to two parquet tables.

    Each batch is cut by its number into a folder of its own, so a batch that is
    repeated after a failure replaces what it wrote before.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        _write_results(batch, decisions, spans, number)

    return _start(results, write_batch, checkpoint, available_now)


def screen_batch(
    batch: DataFrame,
    number: int,
    decisions: str,
    spans: str,
    rejected: str,
    settings: ScreenSettings = ScreenSettings(),
    model: TfidfModel | None = None,
    broken: str = "broken_line",
) -> None:
    """Write one batch of raw rows to three tables: decisions, spans, and rows that cannot be screened.

    Rejected rows keep all their columns and get the reason in ``violation``: a broken line, a null text, an empty
    id or an unknown source type. Every row of the batch goes to ``decisions`` or to ``rejected``. The folder of a
    batch is replaced if its number comes again, so a repeated batch leaves the tables as they were.
    """
    checks = document_checks(source_type="source_type")
    if broken in batch.columns:
        checks = {"line is broken": F.col(broken).isNotNull(), **checks}
    marked = with_violation(batch, checks).persist()
    try:
        marked.where("violation is not null").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        valid = marked.where("violation is null").drop("violation", broken)
        _write_results(screen_stream(valid, settings, model), decisions, spans, number)
    finally:
        marked.unpersist()


def screen_to_tables(
    raw: DataFrame,
    decisions: str,
    spans: str,
    rejected: str,
    checkpoint: str,
    settings: ScreenSettings = ScreenSettings(),
    model: TfidfModel | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Screen a stream of raw rows into three tables, batch by batch."""

    def write_batch(batch: DataFrame, number: int) -> None:
        screen_batch(batch, number, decisions, spans, rejected, settings, model)

    return _start(raw, write_batch, checkpoint, available_now)
