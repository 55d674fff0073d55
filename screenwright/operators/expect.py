"""Checks of rows against the invariants of each record type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwright.constants import SOURCE_TYPES
from screenwright.functions.core import is_blank


def _blank(name: str) -> Column:
    return F.col(name).isNull() | is_blank(F.col(name).cast("string"))


def document_checks(doc_id: str = "doc_id", text: str = "text", source_type: str | None = None) -> dict[str, Column]:
    checks = {"document id is empty": _blank(doc_id), "text is null": F.col(text).isNull()}
    if source_type:
        checks["source type is unknown"] = ~F.coalesce(F.col(source_type), F.lit("unknown")).isin(*SOURCE_TYPES)
    return checks


def chunk_checks() -> dict[str, Column]:
    return {
        "chunk id is empty": _blank("chunk_id"),
        "document id is empty": _blank("doc_id"),
        "text is null": F.col("text").isNull(),
        "start is negative": F.col("start_char") < 0,
        "end is before start": F.col("end_char") < F.col("start_char"),
    }


def span_checks() -> dict[str, Column]:
    return {"start is negative": F.col("start") < 0, "end is before start": F.col("end") < F.col("start")}


def category_score_checks() -> dict[str, Column]:
    return {"evidence count is negative": F.col("evidence_count") < 0}


def prediction_checks() -> dict[str, Column]:
    return {"model name is empty": _blank("model_name")}


def with_violation(df: DataFrame, checks: dict[str, Column], into: str = "violation", strict: bool = False) -> DataFrame:
    """Add the first violated check, or null. In strict mode a violation fails the job."""
    first = F.coalesce(*(F.when(broken, F.lit(text)) for text, broken in checks.items()))
    marked = df.withColumn(into, first)
    if strict:
        marked = marked.withColumn(into, F.when(F.col(into).isNotNull(), F.raise_error(F.col(into))))
    return marked


def split_valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with the reason. Both read the input lazily."""
    marked = with_violation(df, checks)
    return marked.filter("violation is null").drop("violation"), marked.filter("violation is not null")
