"""Policy decisions and safe context as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwright.functions.context import ContextSettings, safe_context
from screenwright.functions.scoring import Policy, policy_result


def decide(
    df: DataFrame,
    score: str = "scan.risk_score",
    category_scores: str | None = "scan.category_scores",
    model_probability: str | None = None,
    policy: Policy = Policy(),
    into: str = "policy",
) -> DataFrame:
    """Add struct ``into`` with decision, level, score, flags and message."""
    count = F.size(category_scores) if category_scores else F.lit(0)
    model = F.col(model_probability) if model_probability else None
    return df.withColumn(into, policy_result(F.col(score), count, policy, model))


def with_safe_context(
    df: DataFrame,
    text: str = "text",
    spans: str = "scan.spans",
    decision: str = "policy.decision",
    score: str = "policy.risk_score",
    settings: ContextSettings = ContextSettings(),
    into: str = "context",
) -> DataFrame:
    """Add struct ``into`` with safe context, sanitised text and removed spans."""
    built = safe_context(F.col(text), F.col(spans), F.col(decision), F.col(score), settings)
    return df.withColumn(into, built)
