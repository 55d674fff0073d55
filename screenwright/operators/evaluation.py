"""Binary classification metrics, threshold sweeps and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwright.constants import THRESHOLDS
from screenwright.operators.dataset import binary_label

COUNTS = ("true_positive", "true_negative", "false_positive", "false_negative")
SUMMARY = (
    "accuracy",
    "precision",
    "recall",
    "f1",
    "false_positive_rate",
    "false_negative_rate",
    "balanced_accuracy",
)


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, 0.0 for a zero denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def check_threshold(threshold: float) -> float:
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be between 0.0 and 1.0. Got {threshold}.")
    return float(threshold)


def predicted_label(probability: Column, threshold: float = 0.5) -> Column:
    """1 where the probability reaches the threshold; NaN never does, null fails the job."""
    reached = (probability >= F.lit(check_threshold(threshold))) & ~F.isnan(probability)
    missing = F.raise_error(F.lit("A probability is null.")).cast("int")
    return F.when(probability.isNull(), missing).when(reached, 1).otherwise(0)


def confusion_counts(df: DataFrame, actual: str = "label", predicted: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """The four counts, over all rows or per group; labels other than 0 and 1 fail the job."""
    pairs = df.select(*by, binary_label(F.col(actual)).alias("y"), binary_label(F.col(predicted)).alias("p"))

    def count(y: int, p: int) -> Column:
        return F.count(F.when((F.col("y") == y) & (F.col("p") == p), 1))

    cells = dict(zip(COUNTS, (count(1, 1), count(0, 0), count(0, 1), count(1, 0)), strict=True))
    return pairs.groupBy(*by).agg(*(cell.alias(name) for name, cell in cells.items()))


def with_metrics(counts: DataFrame) -> DataFrame:
    """Add all ratios to rows of the four counts."""
    tp, tn, fp, fn = (F.col(name) for name in COUNTS)
    total = tp + tn + fp + fn
    ratios = counts.withColumns(
        {
            "support": total,
            "accuracy": safe_divide(tp + tn, total),
            "precision": safe_divide(tp, tp + fp),
            "recall": safe_divide(tp, tp + fn),
            "specificity": safe_divide(tn, tn + fp),
            "false_positive_rate": safe_divide(fp, fp + tn),
            "false_negative_rate": safe_divide(fn, fn + tp),
            "positive_rate": safe_divide(tp + fn, total),
            "predicted_positive_rate": safe_divide(tp + fp, total),
        }
    )
    precision, recall = F.col("precision"), F.col("recall")
    return ratios.withColumns(
        {
            "f1": safe_divide(F.lit(2.0) * precision * recall, precision + recall),
            "balanced_accuracy": (recall + F.col("specificity")) / 2,
        }
    )


def binary_metrics(df: DataFrame, actual: str = "label", predicted: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """One row of metrics, or one per group. No rows at all is an error."""
    counts = confusion_counts(df, actual, predicted, by)
    if by:
        return with_metrics(counts)
    empty = F.raise_error(F.lit("There are no rows to evaluate.")).cast("bigint")
    return with_metrics(counts.withColumn(COUNTS[0], F.when(sum(map(F.col, COUNTS)) == 0, empty).otherwise(F.col(COUNTS[0]))))


def threshold_sweep(
    df: DataFrame,
    actual: str = "label",
    probability: str = "probability",
    thresholds: Sequence[float] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Metrics at each threshold, in the caller's order (column ``position``).

    One pass: rows are counted per label and number of thresholds reached. Only
    that small table is then spread over the thresholds.
    """
    asked = [check_threshold(t) for t in (thresholds or THRESHOLDS)]
    steps = sorted(set(asked))
    p = F.col(probability)
    reached = F.when(F.isnan(p), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= p)))
    binned = (
        df.select(*by, binary_label(F.col(actual)).alias("y"), reached.alias("reached"))
        .groupBy(*by, "y", "reached")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    grid = F.array(
        *(
            F.struct(
                F.lit(position).alias("position"), F.lit(t).alias("threshold"), F.lit(steps.index(t) + 1).alias("rank")
            )
            for position, t in enumerate(asked)
        )
    )
    spread = binned.select(*by, "y", "reached", "rows", F.inline(grid))
    positive = F.col("reached") >= F.col("rank")

    def count(y: int, predicted: Column) -> Column:
        return F.coalesce(F.sum(F.when((F.col("y") == y) & predicted, F.col("rows"))), F.lit(0))

    cells = dict(
        zip(COUNTS, (count(1, positive), count(0, ~positive), count(0, positive), count(1, ~positive)), strict=True)
    )
    counts = spread.groupBy(*by, "position", "threshold").agg(*(cell.alias(name) for name, cell in cells.items()))
    return with_metrics(counts)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the best F1, then recall, then false positive rate, then position."""
    return sweep.orderBy(
        F.desc("f1"), F.desc("recall"), F.asc("false_positive_rate"), F.asc("position")
    ).limit(1)


def summary_columns() -> list[Column]:
    """The reported metrics, rounded to four decimals, and the support."""
    return [*(F.round(name, 4).alias(name) for name in SUMMARY), F.col("support")]


def metrics_summary(metrics: DataFrame, *keep: str) -> DataFrame:
    return metrics.select(*keep, *summary_columns())
