"""Prepare a labelled dataset: raw train and test tables to three splits and a summary."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from screenwright.operators.dataset import (
    NARROW,
    distinct_rows,
    kept_counts,
    labelled_texts,
    number_rows,
    row_id,
    split_train_validation,
    validation_quota,
    with_identity,
)
from screenwright.operators.lineage import Workspace
from screenwright.sources.readers import read_parquet
from screenwright.sources.writers import write_json_row, write_jsonl


@dataclass(frozen=True)
class Prepared:
    """The three splits in one table (column ``split``) and the one-row summary.

    Both read tables of ``space``, so close it once they have been used.
    """

    rows: DataFrame
    summary: DataFrame
    space: Workspace

    def split(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("split") == name).select("id", "text", "label", "source_dataset")


def prepare(
    train: DataFrame,
    test: DataFrame,
    text: str = "text",
    label: str = "label",
    order: str = "row_id",
    dataset_name: str = "labelled_texts",
    val_size: float = 0.20,
    seed: int = 42,
    null_text: str = "empty",
    output_dir: str = "",
    rows_per_range: int | None = None,
    space: Workspace | None = None,
) -> Prepared:
    """Clean and deduplicate both tables, then split validation rows off the training rows.

    Duplicates are removed within each table only. ``order`` is a unique numeric column that gives the
    source order. Clean texts are stored once. Everything is decided on narrow rows of digests and numbers;
    the texts are moved a single time, to join the decisions. Rows are counted while they are grouped.
    """
    space = space or Workspace(train.sparkSession, "prepare")
    named = {"train": train, "test": test}
    parts = [labelled_texts(df, text, label, order, f"raw_{name}", null_text).withColumn("part", F.lit(name)) for name, df in named.items()]
    texts = space.store(with_identity(parts[0].unionByName(parts[1]), seed))
    seen = Observation("kept")
    groups = distinct_rows(texts.select("part", *NARROW), "part").observe(seen, *kept_counts())
    kept = space.store(groups.where("not empty").drop("empty", "copies"))
    counts = {name: count or 0 for name, count in seen.get.items()}
    found = {part: {x: counts[f"{part}_{x}"] for x in (0, 1) if counts[f"{part}_{x}"]} for part in named}

    drawn = split_train_validation(kept.where("part = 'train'"), found["train"], space, val_size, rows_per_range)
    tested = number_rows(kept.where("part = 'test'"), ["position"], sum(found["test"].values()), space, rows_per_range=rows_per_range)
    tested = tested.withColumn("id", row_id(F.lit("raw_test"), F.col("number"))).withColumn("split", F.lit("test"))
    columns = ["row", "split", "id", "label"]
    decided = drawn.select(*columns).unionByName(tested.select(*columns))
    rows = texts.select("row", "text").join(decided, "row").select("split", "id", "text", "label", F.lit(dataset_name).alias("source_dataset"))

    quota = validation_quota(found["train"], val_size)
    rest = {x: n - quota[x] for x, n in found["train"].items()}
    removed = {name: counts[name] for name in ("removed_empty_rows", "removed_duplicate_rows")}
    return Prepared(rows, prepared_summary(train.sparkSession, {"train": rest, "val": quota, "test": found["test"]}, removed, output_dir), space)


def prepared_summary(
    spark: SparkSession, labels: Mapping[str, Mapping[int, int]], removed: Mapping[str, int], output_dir: str
) -> DataFrame:
    """Row counts, label counts and removed rows in one row, from numbers that are known by then."""

    def by_label(counts: Mapping[int, int]):
        present = [F.lit(part) for x, n in sorted(counts.items()) if n for part in (str(x), n)]
        return F.create_map(*present).cast("map<string,bigint>") if present else F.expr("cast(map() as map<string,bigint>)")

    columns = []
    for split, counts in labels.items():
        columns += [F.lit(sum(counts.values())).cast("long").alias(f"{split}_rows"), by_label(counts).alias(f"{split}_label_counts")]
    columns += [F.lit(n).cast("long").alias(name) for name, n in removed.items()]
    return spark.range(1).select(*columns, F.lit(output_dir).alias("output_dir"))


def write_prepared(prepared: Prepared, path: str) -> str:
    """The three splits as JSON lines and the summary as JSON. The join with the texts is done once for all."""
    done = Prepared(prepared.space.store(prepared.rows), prepared.summary, prepared.space)
    for split in ("train", "val", "test"):
        write_jsonl(done.split(split), f"{path}/{split}")
    write_json_row(prepared.summary, f"{path}/summary")
    return path


def prepare_files(spark: SparkSession, train: str, test: str, output_dir: str, **options) -> DataFrame:
    """From two parquet files to JSON lines per split and a summary; returns the summary as it was written."""
    with Workspace(spark, "prepare") as space:
        made = prepare(read_parquet(spark, train), read_parquet(spark, test), output_dir=output_dir, space=space, **options)
        write_prepared(made, output_dir)
        return made.summary
