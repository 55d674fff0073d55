"""Preparation of labelled texts: cleaning, deduplication, numbering and splitting."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenwright.functions.normalize import normalized_text
from screenwright.operators.lineage import Workspace
from screenwright.operators.normalize import compose_unicode

ROWS_PER_RANGE = 1_000_000


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}. Available columns: {df.columns}")
    return df


def binary_label(value: Column) -> Column:
    """The label as 0 or 1; fractions are cut off, anything else fails the job."""
    label = value.cast("int")
    shown = F.coalesce(value.cast("string"), F.lit("null"))
    wrong = F.raise_error(F.concat(F.lit("Expected binary label 0 or 1, got "), shown, F.lit(".")))
    return F.when(label.isin(0, 1), label).otherwise(wrong.cast("int"))


def labelled_texts(
    df: DataFrame,
    text: str = "text",
    label: str = "label",
    order: str = "row_id",
    name: str = "dataset",
    null_text: str = "empty",
) -> DataFrame:
    """Normalised ``text``, checked ``label`` and the source order ``position``.

    ``null_text='literal'`` turns a null into the word None as string
    conversion would; by default it counts as empty.
    """
    if null_text not in ("empty", "literal"):
        raise ValueError("null_text must be 'empty' or 'literal'.")
    require_columns(df, [text, label, order], name)
    filler = F.lit("None" if null_text == "literal" else "")
    picked = df.select(
        F.coalesce(F.col(text).cast("string"), filler).alias("text"),
        binary_label(F.col(label)).alias("label"),
        F.col(order).alias("position"),
    )
    return compose_unicode(picked, "text").withColumn("text", normalized_text(F.col("text")))


def with_identity(labelled: DataFrame, seed: int = 42) -> DataFrame:
    """Add what stands for a row where its text need not be moved: a number of its own and digests of its content.

    ``identity`` tells texts and labels apart, ``draw`` is the row's pseudo-random place. The numbers
    hold once the table is stored.
    """
    return labelled.withColumns(
        {
            "row": F.monotonically_increasing_id(),
            "identity": F.unhex(F.sha2(F.concat(F.col("label").cast("string"), F.lit(":"), F.col("text")), 256)),
            "draw": draw_key(F.col("text"), F.col("label"), seed),
            "empty": F.col("text") == "",
        }
    )


NARROW = ("label", "position", "row", "identity", "draw", "empty")


def distinct_rows(rows: DataFrame, *within: str) -> DataFrame:
    """One row per text and label, without the text: the row of the first position, and the number of copies.

    A plain aggregate instead of a window: copies are merged before the shuffle, so a text that
    fills a third of the table is no hot partition. Empty texts keep their row here, their copies
    are the removed rows.
    """
    first = F.min(F.struct("position", "row"))
    groups = rows.groupBy(*within, "label", "identity", "draw", "empty").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    return groups.select(*within, "label", "identity", "draw", "empty", "first.position", "first.row", "copies")


def distinct_texts(labelled: DataFrame, space: Workspace) -> DataFrame:
    """One row ``text, label, position, copies`` per text and label; texts are moved once, to join their group."""
    rows = space.store(with_identity(labelled))
    groups = distinct_rows(rows.select(*NARROW)).select("row", "label", "position", "copies")
    return rows.select("row", "text").join(groups, "row").select("text", "label", "position", "copies")


def kept_counts() -> list[Column]:
    """Aggregates over ``distinct_rows`` of train and test rows, in one pass with whatever else is done to them."""
    kept = ~F.col("empty")
    per_label = {f"{part}_{label}": kept & (F.col("part") == part) & (F.col("label") == label) for part in ("train", "test") for label in (0, 1)}
    return [
        *(F.count_if(condition).alias(name) for name, condition in per_label.items()),
        F.sum(F.when(F.col("empty"), F.col("copies")).otherwise(0)).alias("removed_empty_rows"),
        F.sum(F.when(kept, F.col("copies") - 1).otherwise(0)).alias("removed_duplicate_rows"),
    ]


def without_empty(groups: DataFrame) -> DataFrame:
    return groups.filter(F.col("text") != "").drop("copies")


def number_rows(
    df: DataFrame, order: Sequence[str], rows: int, space: Workspace, into: str = "number", rows_per_range: int | None = None
) -> DataFrame:
    """Dense numbers from 0 along ``order`` without sorting all rows in one task.

    Rows are dealt out by ranges of ``order``, as many as ``rows`` (their number) asks for, and sorted
    inside. A row's number is its place in its range plus the rows of the ranges before; the table of
    ranges has one row for each. No range grows with the data. ``df`` should be narrow: it is moved whole.
    """
    ranges = rows // (rows_per_range or ROWS_PER_RANGE) + 1
    ordered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the upper bits of these numbers are the partition, the lower ones the place in it
    placed = space.store(ordered.withColumn("__at", F.monotonically_increasing_id()))
    which, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(which.alias("__range"))
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    )
    numbered = placed.withColumn("__range", which).join(F.broadcast(offsets), "__range")
    return numbered.withColumn(into, F.col("__before") + at).drop("__range", "__at", "__before")


def sequential_ids(
    df: DataFrame, prefix: str, space: Workspace, position: str = "position", rows_per_range: int | None = None
) -> DataFrame:
    """Add ``id`` = prefix and the row's number in source order."""
    numbered = number_rows(df, [position], df.count(), space, rows_per_range=rows_per_range)
    return numbered.withColumn("id", row_id(F.lit(prefix), F.col("number"))).drop("number")


def row_id(prefix: Column, number: Column) -> Column:
    return F.concat(prefix, F.lit("_"), F.format_string("%05d", number))


def draw_key(text: Column, label: Column, seed: int) -> Column:
    """Pseudo-random, repeatable place of a row: a digest of its content and the seed."""
    return F.md5(F.concat(text, F.lit(":"), label.cast("string"), F.lit(f":{seed}")))


def validation_quota(label_counts: Mapping[int, int], val_size: float = 0.20) -> dict[int, int]:
    """Validation rows per label: shares of the training part by largest remainder."""
    if len(label_counts) == 0 or min(label_counts.values()) < 2:
        raise ValueError("Every label needs at least two rows for a stratified split.")
    total = sum(label_counts.values())
    training = total - math.ceil(val_size * total)
    if min(training, total - training) < len(label_counts):
        raise ValueError("Both parts need at least one row per label.")
    exact = {label: count * training / total for label, count in label_counts.items()}
    share = {label: math.floor(value) for label, value in exact.items()}
    by_remainder = sorted(exact, key=lambda label: (share[label] - exact[label], label))
    for label in by_remainder[: training - sum(share.values())]:
        share[label] += 1
    return {label: label_counts[label] - share[label] for label in label_counts}


def split_train_validation(
    df: DataFrame, counts: Mapping[int, int], space: Workspace, val_size: float = 0.20, rows_per_range: int | None = None
) -> DataFrame:
    """Mark each row of ``label, identity, draw`` as ``train`` or ``val``, stratified by label.

    ``counts`` has the rows per label. Per label the rows with the lowest digests go to validation until
    its quota is full. New ids number each part in digest order, a repeatable shuffle.
    """
    quota = validation_quota(counts, val_size)
    labels = sorted(counts)
    before = {label: sum(counts[x] for x in labels if x < label) for label in labels}
    total, held = sum(counts.values()), sum(quota.values())

    def by_label(values: Mapping[int, int]) -> Column:
        return F.element_at(F.create_map(*(F.lit(part) for pair in values.items() for part in pair)), F.col("label"))

    placed = number_rows(df, ["label", "draw", "identity"], total, space, "__place", rows_per_range)
    validated = F.col("__place") - by_label(before) < by_label(quota)
    marked = placed.withColumn("split", F.when(validated, "val").otherwise("train")).drop("__place")
    numbered = number_rows(marked, ["split", "draw", "identity"], total, space, "number", rows_per_range)
    own = F.col("number") - F.when(F.col("split") == "val", total - held).otherwise(0)  # train comes first
    return numbered.withColumn("id", row_id(F.col("split"), own)).drop("number")
