"""Category scores, risk scores, bands, decisions and messages."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenwright.constants import (
    BANDS,
    CATEGORY_NAMES,
    CATEGORY_WEIGHTS,
    DECISIONS,
    EVIDENCE_BONUS,
    EVIDENCE_BONUS_LIMIT,
    LABEL_NAMES,
    LEVEL_OF_BAND,
    MODEL_WEIGHT,
    UNKNOWN_CATEGORY_WEIGHT,
)
from screenwright.functions.core import clamp, let, strip, two_decimals

CATEGORY_SCORES = "array<struct<category:string,score:double,evidence_count:int>>"


@dataclass(frozen=True)
class Band:
    """Inclusive score range with its decision and level."""

    name: str
    min_score: float
    max_score: float
    decision: str
    level: str | None = None

    def __post_init__(self) -> None:
        if self.decision not in DECISIONS:
            raise ValueError(f"Unknown policy decision: {self.decision}")
        if self.level is None:
            object.__setattr__(self, "level", level_of_band(self.name))


def level_of_band(name: str) -> str:
    key = name.strip().lower()
    if key not in LEVEL_OF_BAND:
        raise ValueError(f"Unknown policy band name: {name}")
    return LEVEL_OF_BAND[key]


@dataclass(frozen=True)
class Policy:
    """Bands and category weights.

    ``gap_policy`` says what becomes of a score between two bands: ``last``
    takes the last band, ``floor`` the band below the score.
    """

    bands: tuple[Band, ...] = tuple(Band(*band) for band in BANDS)
    category_weights: Mapping[str, float] = field(default_factory=lambda: dict(CATEGORY_WEIGHTS))
    gap_policy: str = "last"

    def __post_init__(self) -> None:
        if not self.bands:
            raise ValueError("A policy needs at least one band.")
        if self.gap_policy not in ("last", "floor"):
            raise ValueError("gap_policy must be 'last' or 'floor'.")
        object.__setattr__(self, "bands", tuple(sorted(self.bands, key=lambda band: band.min_score)))

    @classmethod
    def from_settings(cls, settings: Mapping, gap_policy: str = "last") -> Policy:
        """Build from ``{"risk_levels": {name: {...}}, "categories": {name: {"weight": w}}}``."""
        bands = tuple(
            Band(name, float(b["min_score"]), float(b["max_score"]), b["decision"])
            for name, b in settings["risk_levels"].items()
        )
        weights = {name: float(c["weight"]) for name, c in settings.get("categories", {}).items()}
        return cls(bands, weights, gap_policy)


def category_scores(spans: Column) -> Column:
    """Best span score plus a bonus for repeated evidence, per category in name order."""

    def scored(category: Column) -> Column:
        of_category = F.filter(spans, lambda s: s["category"] == category)
        return let(
            F.transform(of_category, lambda s: s["score"]),
            lambda scores: F.struct(
                category.alias("category"),
                category_score(F.array_max(scores), F.size(scores)).alias("score"),
                F.size(scores).alias("evidence_count"),
            ),
        )

    categories = F.sort_array(F.array_distinct(F.transform(spans, lambda s: s["category"])))
    return F.transform(categories, scored).cast(CATEGORY_SCORES)


def category_score(best: Column, evidence: Column) -> Column:
    bonus = F.least(F.lit(EVIDENCE_BONUS_LIMIT), F.lit(EVIDENCE_BONUS) * (evidence - 1))
    return clamp(best + bonus)


def weight_of(category: Column, weights: Mapping[str, float]) -> Column:
    if not weights:
        return F.lit(UNKNOWN_CATEGORY_WEIGHT)
    known = F.create_map(*(F.lit(part) for pair in weights.items() for part in (pair[0], float(pair[1]))))
    return F.greatest(F.lit(0.0), F.coalesce(F.try_element_at(known, category), F.lit(UNKNOWN_CATEGORY_WEIGHT)))


def weighted_category_score(scores: Column, weights: Mapping[str, float] = CATEGORY_WEIGHTS) -> Column:
    """Weighted mean of the category scores, added up in array order."""
    total = F.aggregate(
        scores,
        F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("weight")),
        lambda acc, c: let(
            weight_of(c["category"], weights),
            lambda w: F.struct((acc["score"] + clamp(c["score"]) * w).alias("score"), (acc["weight"] + w).alias("weight")),
        ),
    )
    return let(
        total, lambda t: F.when(t["weight"] == 0.0, F.lit(0.0)).otherwise(clamp(F.try_divide(t["score"], t["weight"])))
    )


def risk_score(
    scores: Column,
    weights: Mapping[str, float] = CATEGORY_WEIGHTS,
    model_score: Column | None = None,
    model_weight: float = MODEL_WEIGHT,
) -> Column:
    """Category risk, blended with a model score where there is one."""
    category_part = weighted_category_score(scores, weights)
    if model_score is None:
        return category_part
    share = min(1.0, max(0.0, float(model_weight)))

    def blended(category: Column) -> Column:
        mix = clamp(model_score) * F.lit(share) + category * F.lit(1.0 - share)
        return F.when(model_score.isNull(), category).otherwise(clamp(mix))

    return let(category_part, blended)


def _by_band(score: Column, policy: Policy, value) -> Column:
    def chosen(s: Column) -> Column:
        result = None
        for band in policy.bands:
            inside = s.between(F.lit(float(band.min_score)), F.lit(float(band.max_score)))
            result = F.when(inside, F.lit(value(band))) if result is None else result.when(inside, F.lit(value(band)))
        if policy.gap_policy == "floor":
            for band in reversed(policy.bands):
                result = result.when(s >= F.lit(float(band.min_score)), F.lit(value(band)))
        return result.otherwise(F.lit(value(policy.bands[-1])))

    return F.when(score.isNotNull(), let(clamp(score), chosen))


def band_name(score: Column, policy: Policy = Policy()) -> Column:
    return _by_band(score, policy, lambda band: band.name)


def risk_level(score: Column, policy: Policy = Policy()) -> Column:
    return _by_band(score, policy, lambda band: band.level)


def decision(score: Column, policy: Policy = Policy()) -> Column:
    return _by_band(score, policy, lambda band: band.decision)


def policy_message(
    decided: Column, score: Column, category_count: Column, model_probability: Column | None = None
) -> Column:
    """Short explanation of a decision."""
    shown = two_decimals(score)
    count = category_count.cast("string")
    model = F.lit("")
    if model_probability is not None:
        model = F.when(
            model_probability.isNotNull(),
            F.concat(F.lit(" Model suspicious probability: "), two_decimals(clamp(model_probability)), F.lit(".")),
        ).otherwise("")
    return (
        F.when(decided == "ALLOW", F.concat(F.lit("Content allowed. Risk score "), shown, F.lit(" is within the low-risk range.")))
        .when(
            decided == "ALLOW_WITH_WARNING",
            F.concat(
                F.lit("Content allowed with warning. Risk score "), shown,
                F.lit(" shows moderate risk across "), count, F.lit(" categories."),
            ),
        )
        .when(
            decided == "SANITIZE",
            F.concat(
                F.lit("Content should be sanitized. Risk score "), shown,
                F.lit(" shows high risk across "), count, F.lit(" categories."),
            ),
        )
        .when(
            decided == "BLOCK",
            F.concat(F.lit("Content should be blocked. Risk score "), shown, F.lit(" is in the critical range."), model),
        )
    )


def policy_result(
    score: Column, category_count: Column, policy: Policy = Policy(), model_probability: Column | None = None
) -> Column:
    """Struct of decision, level, score, flags and message."""

    def decided(s: Column) -> Column:
        return let(
            decision(s, policy),
            lambda d: F.struct(
                d.alias("decision"),
                risk_level(s, policy).alias("risk_level"),
                s.alias("risk_score"),
                (d == "SANITIZE").alias("should_sanitize"),
                (d == "BLOCK").alias("should_block"),
                policy_message(d, s, category_count, model_probability).alias("message"),
            ),
        )

    return F.when(score.isNotNull(), let(clamp(score), decided))


def detected_categories(spans: Column, scores: Column) -> Column:
    """Sorted distinct categories of spans and category scores."""
    of_spans = F.transform(spans, lambda s: s["category"])
    of_scores = F.transform(scores, lambda c: c["category"])
    return F.sort_array(F.array_distinct(F.concat(of_spans, of_scores)))


def _lookup(key: Column, names: Mapping, what: str) -> Column:
    known = F.create_map(*(F.lit(part) for pair in names.items() for part in pair))
    unknown = F.raise_error(F.concat(F.lit(f"Unknown {what}: "), F.coalesce(key.cast("string"), F.lit("null"))))
    found = F.try_element_at(known, key)
    return F.when(found.isNotNull(), found).otherwise(unknown)


def label_name(label: Column) -> Column:
    return _lookup(label.cast("int"), LABEL_NAMES, "injection label")


def label_of_name(name: Column) -> Column:
    return _lookup(F.lower(strip(name)), {v: k for k, v in LABEL_NAMES.items()}, "injection label name")


def category_display_name(category: Column) -> Column:
    return _lookup(category, CATEGORY_NAMES, "risk category")
