"""Writing results. Every sink is a folder that the executors fill in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenwright.operators.evaluation import predicted_label


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines; nulls are written, other than ASCII characters stay as they are."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def with_sorted_keys(value: Column, kind: T.DataType) -> Column:
    """A value whose fields and map keys are in sorted order at every depth; nulls stay nulls."""
    if isinstance(kind, T.StructType):
        fields = [with_sorted_keys(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: with_sorted_keys(item, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], with_sorted_keys(e["value"], kind.valueType))))
    return value


def sorted_json(df: DataFrame) -> DataFrame:
    """Rows with their keys in sorted order at every depth, as JSON writes them."""
    return df.select(*(with_sorted_keys(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)))


def write_json_row(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A single row, such as a summary or metrics, with the keys of all its levels in sorted order."""
    sorted_json(df).coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def write_predictions(
    scored: DataFrame, path: str, threshold: float, key: str = "id", probability: str = "probability", mode: str = "overwrite"
) -> str:
    """Predictions as CSV, without the texts."""
    prediction_rows(scored, threshold, key, probability).write.mode(mode).option("header", "true").csv(path)
    return path


def prediction_rows(scored: DataFrame, threshold: float, key: str = "id", probability: str = "probability") -> DataFrame:
    return scored.select(
        F.col(key).cast("string").alias("id"),
        F.col("label").cast("int").alias("label"),
        F.col(probability).alias("suspicious_probability"),
        predicted_label(F.col(probability), threshold).alias("prediction"),
        F.lit(float(threshold)).alias("threshold"),
    )
