"""Reading inputs, with clear errors for missing files and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenwright.operators.dataset import require_columns

PREPARED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("source_dataset", T.StringType()),
    ]
)


def _found(path: str, read) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"Required input not found: {path}") from error
        raise


def read_parquet(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    return require_columns(_found(path, spark.read.parquet), required, path)


def read_jsonl(spark: SparkSession, path: str, required: tuple[str, ...] = ("id", "text", "label")) -> DataFrame:
    """Prepared texts as JSON lines.

    All lines are asked for their columns. A line that is no object of this shape
    fails the job, as does a label that is not a whole number.
    """
    lines = _found(path, spark.read.text)
    names = lines.select(F.explode(F.json_object_keys("value")).alias("name")).distinct().collect()
    missing = sorted(set(required) - {row["name"] for row in names})
    if missing:
        raise ValueError(f"{path} is missing required columns: {missing}")
    whole = {f.name: f.dataType.simpleString() for f in PREPARED.fields}
    numbers = {name for name, kind in whole.items() if kind in ("int", "bigint")}
    schema = ", ".join(f"{name} {'double' if name in numbers else kind}" for name, kind in whole.items())
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)

    def integral(name: str) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"{name} is not a whole number: "), F.col(name).cast("string")))
        return F.when(F.col(name) != F.floor(name), bad).otherwise(F.col(name)).cast(whole[name]).alias(name)

    return rows.select(*(integral(name) if name in numbers else name for name in whole))


def read_raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """Raw untrusted texts as parquet: id, text, source type, address and metadata."""
    return read_parquet(spark, path, ("doc_id", "text"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, ("term", "idf", "coefficient"))


def read_text_lines(spark: SparkSession, path: str) -> list[str]:
    """All lines of a small text, such as the list of a model's versions."""
    return [row[0] for row in _found(path, spark.read.text).collect()]


def read_splits(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """The JSON lines of all splits below one folder, with their name in ``split``."""
    parts = [read_jsonl(spark, f"{path}/{name}").withColumn("split", F.lit(name)) for name in splits]
    return reduce(DataFrame.unionByName, parts)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share rows out over the cores if the input has fewer partitions than cores.

    Large inputs have more partitions than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
