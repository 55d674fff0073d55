"""Train and evaluate the classifier on prepared splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenwright.operators.classifier import TfidfModel, fit
from screenwright.operators.evaluation import (
    best_threshold,
    binary_metrics,
    check_threshold,
    predicted_label,
    summary_columns,
    threshold_sweep,
)
from screenwright.operators.lineage import cut_lineage
from screenwright.operators.tfidf import TfidfSettings
from screenwright.sources.readers import read_splits
from screenwright.sources.writers import write_json_row, write_predictions

NOTES = (
    "A risky text that is let through is the costlier error.",
    "A harmless text that is stopped makes the filter a nuisance.",
    "The threshold comes from the validation rows; the test rows only report it.",
)


@dataclass(frozen=True)
class Training:
    """Model, scored rows of all splits, threshold sweep and metrics."""

    model: TfidfModel
    scored: DataFrame
    sweep: DataFrame
    best: float
    metrics: DataFrame

    def payload(self, default: float) -> DataFrame:
        return metrics_payload(self.model.settings.model_name, default, self.best, self.metrics, self.sweep)


def train(
    rows: DataFrame, settings: TfidfSettings = TfidfSettings(), threshold: float = 0.5, key: str = "id"
) -> Training:
    """Fit on split ``train``, choose the threshold on ``val``, report on all.

    ``rows`` has ``split, id, text, label``; ids are unique over all splits.
    Every text is scored once; all metrics come from the kept probabilities.
    """
    check_threshold(threshold)
    return assess(fit(rows.filter("split = 'train'"), key, settings=settings), rows, threshold, key)


def assess(model: TfidfModel, rows: DataFrame, threshold: float = 0.5, key: str = "id") -> Training:
    """Score all splits by a model, choose the threshold on ``val``, report on all."""
    check_threshold(threshold)
    scored = cut_lineage(model.predict_probabilities(rows, key, carry=("split", "label")))
    sweep = threshold_sweep(scored.filter("split = 'val'"))
    chosen = best_threshold(sweep).first()
    if chosen is None:
        raise ValueError("There are no validation rows.")
    best = float(chosen["threshold"])
    return Training(model, scored, sweep, best, split_metrics(scored, threshold, best))


def split_metrics(scored: DataFrame, default: float, best: float) -> DataFrame:
    """Metrics per split at the default threshold, and at the best one except for ``train``."""

    def at(threshold: float, kind: str, rows: DataFrame) -> DataFrame:
        predicted = rows.withColumn("prediction", predicted_label(F.col("probability"), threshold))
        metrics = binary_metrics(predicted, by=["split"])
        return metrics.withColumns({"kind": F.lit(kind), "threshold": F.lit(threshold)})

    held_out = scored.filter("split <> 'train'")
    return at(default, "default", scored).unionByName(at(best, "best", held_out))


def metrics_payload(name: str, default: float, best: float, metrics: DataFrame, sweep: DataFrame) -> DataFrame:
    """The metrics report as one nested row."""
    summary = F.struct(*summary_columns())
    names = {"train": "train", "val": "validation", "test": "test"}

    def section(kind: str, splits: tuple[str, ...]):
        found = {
            s: F.first(F.when((F.col("kind") == kind) & (F.col("split") == s), summary), ignorenulls=True) for s in splits
        }
        return F.struct(*(value.alias(names[s]) for s, value in found.items()))

    per_split = metrics.agg(
        section("default", ("train", "val", "test")).alias("default_threshold_metrics"),
        section("best", ("val", "test")).alias("best_threshold_metrics"),
    )
    points = F.sort_array(F.collect_list(F.struct("position", "threshold", summary.alias("metrics"))))
    swept = sweep.agg(
        F.transform(points, lambda p: F.struct(p["threshold"].alias("threshold"), p["metrics"].alias("metrics"))).alias(
            "validation_threshold_sweep"
        )
    )
    # Both sides are global aggregates of exactly one row.
    one = F.lit(1).alias("__one")
    return per_split.select("*", one).join(swept.select("*", one), "__one").select(
        F.lit(name).alias("model_name"),
        F.lit(default).alias("default_threshold"),
        F.lit(best).alias("best_validation_threshold"),
        "default_threshold_metrics",
        "best_threshold_metrics",
        "validation_threshold_sweep",
        F.array(*map(F.lit, NOTES)).alias("notes"),
    )


def feature_report(model: TfidfModel, n: int = 30) -> DataFrame:
    """Top features of both sides as one nested row."""
    sign = F.when(F.col("side") == "suspicious", -F.col("coefficient")).otherwise(F.col("coefficient"))
    ranked = model.top_features(n).select("side", F.struct(sign, "term").alias("rank"), "term", "coefficient")

    def side(name: str):
        ordered = F.sort_array(F.filter(entries_all, lambda e: e["side"] == name))
        return F.transform(ordered, lambda e: F.struct(e["term"].alias("term"), e["coefficient"].alias("weight")))

    entries_all = F.collect_list(F.struct("rank", "side", "term", "coefficient"))
    return ranked.agg(side("suspicious").alias("suspicious"), side("benign").alias("benign"))


def write_training(training: Training, path: str, default: float = 0.5) -> str:
    """Model, metrics, top features and test predictions below one folder."""
    training.model.save(f"{path}/model")
    write_json_row(training.payload(default), f"{path}/metrics")
    write_json_row(feature_report(training.model), f"{path}/top_features")
    write_predictions(training.scored.filter("split = 'test'"), f"{path}/test_predictions", training.best)
    return path


def train_files(
    spark: SparkSession, prepared: str, output_dir: str, settings: TfidfSettings = TfidfSettings(), threshold: float = 0.5
) -> Training:
    """From the JSON lines of three splits to model, metrics, top features and test predictions."""
    training = train(read_splits(spark, prepared), settings, threshold)
    write_training(training, output_dir, threshold)
    return training
