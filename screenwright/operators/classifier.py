"""TF-IDF logistic regression: fit, predict, evaluate, explain, save and load."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenwright.functions.core import clamp, let
from screenwright.functions.scoring import label_name
from screenwright.operators.dataset import binary_label
from screenwright.operators.evaluation import binary_metrics, predicted_label
from screenwright.operators.lineage import cut_lineage
from screenwright.operators.tfidf import (
    TfidfSettings,
    document_frequency,
    folded_text,
    known_terms,
    known_weights,
    terms_of,
    tfidf_rows,
    vocabulary,
)


@F.arrow_udf(VectorUDT())
def _sparse(size: pa.Array, indices: pa.Array, values: pa.Array) -> pa.Array:
    sparse = pa.array([0] * len(size), pa.int8())
    return pa.StructArray.from_arrays([sparse, size.cast(pa.int32()), indices, values], names=["type", "size", "indices", "values"])


@dataclass(frozen=True)
class TfidfModel:
    """A fitted classifier: one row per term with idf and coefficient, the bias, and the steps of the solver."""

    settings: TfidfSettings
    terms: DataFrame
    bias: float
    iterations: int | None = None

    def predict_probabilities(
        self, df: DataFrame, key: str, text: str = "text", carry: tuple[str, ...] = (), into: str = "probability"
    ) -> DataFrame:
        """``key``, carried columns and the probability of class 1.

        No vectors are built, no terms spelled out and nothing is shuffled: the score is a sum inside
        the row, so rows with equal or null keys stay apart.
        """
        known = known_weights(F.col(text), self.terms, "coefficient", self.settings)
        start = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("square"))
        sums = F.aggregate(
            known,
            start,
            lambda total, e: F.struct(
                (total["score"] + e["weight"] * e["coefficient"]).alias("score"),
                (total["square"] + e["weight"] * e["weight"]).alias("square"),
            ),
        )

        def probability(total: Column) -> Column:
            margin = F.coalesce(F.try_divide(total["score"], F.sqrt(total["square"])), F.lit(0.0)) + F.lit(self.bias)
            return F.struct((F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias(into))

        folded = folded_text(df.select(key, *carry, text), text, self.settings.lowercase)
        # behind a generator, so that a filter on the probability does not repeat the sum
        return folded.select(key, *carry, F.inline(F.array(let(sums, probability))))

    def predict(
        self, df: DataFrame, key: str, text: str = "text", carry: tuple[str, ...] = (), threshold: float = 0.5
    ) -> DataFrame:
        """Structured predictions: label, label name, both probabilities and the model's name."""
        scored = self.predict_probabilities(df, key, text, carry)
        p = clamp(F.col("probability"))
        label = predicted_label(F.col("probability"), threshold)
        return scored.select(
            key,
            *carry,
            label.alias("prediction"),
            label_name(label).alias("label_name"),
            p.alias("suspicious_probability"),
            clamp(F.lit(1.0) - p).alias("benign_probability"),
            F.lit(self.settings.model_name).alias("model_name"),
            F.lit(None).cast("string").alias("model_version"),
        )

    def evaluate(
        self, df: DataFrame, key: str, text: str = "text", label: str = "label", threshold: float = 0.5
    ) -> DataFrame:
        """Binary metrics of the predictions against the labels."""
        scored = self.predict_probabilities(df, key, text, (label,))
        return binary_metrics(
            scored.withColumn("prediction", predicted_label(F.col("probability"), threshold)), label, "prediction"
        )

    def top_features(self, n: int = 20) -> DataFrame:
        """The terms with the largest and the smallest coefficients, ``n`` each."""
        if n < 1:
            raise ValueError("n must be at least 1.")
        picked = self.terms.select("term", "coefficient")
        top = picked.orderBy(F.desc("coefficient"), F.asc("term")).limit(n).withColumn("side", F.lit("suspicious"))
        low = picked.orderBy(F.asc("coefficient"), F.asc("term")).limit(n).withColumn("side", F.lit("benign"))
        return top.unionByName(low).select("side", "term", "coefficient")

    def gradient(self, df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
        """Per term, and for the bias (null term), the gradient of the training loss at this model.

        All entries are near zero where the solver has found the optimum for ``df``.
        """
        rows = terms_of(df.select(binary_label(F.col(label)).alias("label"), text), text, self.settings)
        weights = class_weights({r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}, self.settings)
        known = known_terms(F.col("terms"), self.terms, ("coefficient",), self.settings)

        def pulls(entries: Column) -> Column:
            norm = F.sqrt(F.aggregate(entries, F.lit(0.0), lambda total, e: total + e["weight"] * e["weight"]))
            score = F.aggregate(entries, F.lit(0.0), lambda total, e: total + e["weight"] * e["coefficient"])
            margin = F.coalesce(F.try_divide(score, norm), F.lit(0.0)) + F.lit(self.bias)
            weight = F.when(F.col("label") == 1, weights[1]).otherwise(weights[0])
            residual = weight * (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)) - F.col("label"))
            bias = F.struct(F.lit(None).cast("string").alias("term"), residual.alias("pull"))
            scale = F.struct(residual.alias("r"), norm.alias("n"))
            of_terms = let(
                scale,
                lambda s: F.transform(entries, lambda e: F.struct(e["term"].alias("term"), (s["r"] * e["weight"] / s["n"]).alias("pull"))),
            )
            return F.concat(of_terms, F.array(bias))

        pulled = rows.select("label", F.inline(let(known, pulls))).groupBy("term").agg(F.sum("pull").alias("pull"))
        own = self.terms.select("term", "coefficient")
        with_own = pulled.join(F.broadcast(own.where("term is not null")), "term", "left")
        return with_own.select("term", (F.col("pull") + F.coalesce("coefficient", F.lit(self.bias))).alias("gradient"))

    def certificate(self, df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
        """One row on how near this model is to the optimum for ``df``, whatever the solver says of itself.

        The dual point that belongs to the model's own probabilities bounds the optimum from below. With a
        squared penalty its distance to the loss, the duality gap, is half the squared norm of the gradient.
        ``gap`` is that bound, ``loss`` the training loss, ``loss_at_zero`` that of a model without weights,
        ``weight`` the summed sample weights and ``terms`` the number of weights, the bias apart.
        """
        counts = {r["label"]: r["count"] for r in df.groupBy(binary_label(F.col(label)).alias("label")).count().collect()}
        weights = class_weights(counts, self.settings)
        of_row = F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("__label"))
        rows = df.select(binary_label(F.col(label)).alias("__label"), text)
        scored = self.predict_probabilities(rows, "__label", text)
        chance = F.when(F.col("__label") == 1, F.col("probability")).otherwise(1 - F.col("probability"))
        loss = scored.agg(F.count(F.lit(1)).alias("rows"), F.sum(of_row).alias("weight"), F.sum(-of_row * F.log(chance)).alias("of_rows"))
        own = self.terms.agg(F.count(F.lit(1)).alias("terms"), F.sum(F.col("coefficient") * F.col("coefficient")).alias("square"))
        slope = self.gradient(df, text, label).agg((F.sum(F.col("gradient") * F.col("gradient")) / 2).alias("gap"))
        # All three are global aggregates of exactly one row.
        one = F.lit(1).alias("__one")
        joined = loss.select("*", one).join(own.select("*", one), "__one").join(slope.select("*", one), "__one")
        return joined.select(
            "rows",
            "terms",
            "weight",
            (F.log(F.lit(2.0)) * F.col("weight")).alias("loss_at_zero"),
            (F.col("of_rows") + (F.col("square") + F.lit(self.bias * self.bias)) / 2).alias("loss"),
            "gap",
            F.lit(self.iterations).cast("int").alias("iterations"),
        )

    def save(self, path: str) -> str:
        """Add the model below ``path`` as its newest version.

        The terms go to a folder of their own; the line that names it is appended last. Until then, and
        if anything fails before, ``load`` gives the version before, so a model can be saved where it was loaded.
        """
        spark = self.terms.sparkSession
        number = max((described["number"] for described in _versions(spark, path)), default=0) + 1
        folder = f"versions/{number:06d}-{uuid.uuid4().hex[:8]}"
        self.terms.write.parquet(f"{path}/{folder}")
        described = json.dumps({"number": number, "terms": folder, "settings": asdict(self.settings), "bias": self.bias, "iterations": self.iterations})
        spark.range(1).select(F.lit(described).alias("value")).coalesce(1).write.mode("append").text(f"{path}/model")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfModel:
        """The newest version below ``path``."""
        from screenwright.sources.readers import read_terms

        found = _versions(spark, path)
        if not found:
            raise FileNotFoundError(f"Required input not found: {path}/model")
        newest = max(found, key=lambda described: (described["number"], described["terms"]))
        terms = read_terms(spark, f"{path}/{newest['terms']}")
        return cls(TfidfSettings(**newest["settings"]), terms, float(newest["bias"]), newest.get("iterations"))


def _versions(spark: SparkSession, path: str) -> list[dict]:
    """Descriptions of all saved versions, one line each."""
    from screenwright.sources.readers import read_text_lines

    try:
        lines = [json.loads(line) for line in read_text_lines(spark, f"{path}/model")]
    except FileNotFoundError:
        return []
    for described in lines:
        if not isinstance(described, dict) or not isinstance(described.get("settings"), dict) or not {"bias", "number", "terms"} <= described.keys():
            raise TypeError("Invalid model artifact: settings, bias or version missing.")
    return lines


def class_weights(counts: dict[int, int], settings: TfidfSettings) -> dict[int, float]:
    """Sample weight per class: inverse to its share, or 1 for all."""
    balanced = settings.class_weight == "balanced"
    return {c: sum(counts.values()) / (2.0 * n) if balanced else 1.0 for c, n in counts.items()}


def fit(
    df: DataFrame, key: str, text: str = "text", label: str = "label", settings: TfidfSettings = TfidfSettings()
) -> TfidfModel:
    """Learn vocabulary and coefficients from labelled texts.

    The loss is that of a linear solver with C = 1 that penalises the bias too:
    a constant feature carries the bias, and the strength is one over the total
    sample weight. The learner ignores features that never vary, so rows of
    class 0 are mirrored: (-x, 1) has the loss of (x, 0) and the constant varies.
    """
    chosen = df.select(
        key,
        binary_label(F.col(label)).alias("label"),
        F.coalesce(F.col(text), F.raise_error(F.lit("texts must not be null"))).alias("text"),
    )
    terms = cut_lineage(terms_of(chosen, "text", settings))
    counts = {row["label"]: row["count"] for row in terms.groupBy("label").count().collect()}
    total = sum(counts.values())
    if total == 0:
        raise ValueError("There are no texts to learn from.")
    if 1 not in counts:
        raise ValueError("The training texts do not contain class label 1.")
    if len(counts) < 2:
        raise ValueError("The training texts must contain both classes.")

    vocab = cut_lineage(vocabulary(document_frequency(terms), total, settings))
    size = vocab.count()
    if size == 0:
        raise ValueError("No terms remain after pruning. Try a lower min_df or a higher max_df.")

    weights = class_weights(counts, settings)
    # Written once, so that no solver step ever goes back to the join.
    weighted = cut_lineage(tfidf_rows(terms, vocab, key, ("label",), settings).drop("vocabulary_terms"))
    mirror = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    features = weighted.select(
        F.lit(1.0).alias("target"),
        F.when(F.col("label") == 1, weights[1]).otherwise(weights[0]).alias("sample_weight"),
        _sparse(
            F.lit(size + 1),
            F.concat("indices", F.array(F.lit(size))),
            F.transform(F.concat("values", F.array(F.lit(1.0))), lambda value: value * mirror),
        ).alias("features"),
    )
    learner = LogisticRegression(
        labelCol="target",
        weightCol="sample_weight",
        regParam=1.0 / sum(weights[c] * n for c, n in counts.items()),
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=False,
        maxIter=settings.max_iter,
        tol=settings.tol,
    )
    solved = learner.fit(features)
    solution = solved.coefficients.toArray()
    spark = df.sparkSession
    # One number per vocabulary term, at most max_features of them.
    learned = spark.createDataFrame(
        pa.table({"index": pa.array(range(size), pa.int32()), "coefficient": pa.array(solution[:size])})
    )
    fitted = vocab.join(F.broadcast(learned), "index").select("term", "df", "idf", "index", "coefficient")
    return TfidfModel(settings, fitted, float(solution[size]), solved.summary.totalIterations)
