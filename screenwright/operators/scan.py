"""Rule scans of texts and chunks, and the roll-up of chunk scans to documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwright.constants import CATEGORY_WEIGHTS, Rule
from screenwright.functions.core import let
from screenwright.functions.rules import check_rules, find_spans, offset_spans
from screenwright.functions.scoring import category_score, category_scores, detected_categories, risk_score


def scan_result(spans, weights: Mapping[str, float] | None = None):
    """Struct of spans, category scores, risk score, span count and categories."""
    weights = dict(weights or CATEGORY_WEIGHTS)
    return let(
        spans,
        lambda found: let(
            category_scores(found),
            lambda scores: F.struct(
                found.alias("spans"),
                scores.alias("category_scores"),
                risk_score(scores, weights).alias("risk_score"),
                F.size(found).alias("flagged_span_count"),
                detected_categories(found, scores).alias("detected_categories"),
            ),
        ),
    )


def scan(
    df: DataFrame,
    text: str = "text",
    into: str = "scan",
    rules: Sequence[Rule] | None = None,
    weights: Mapping[str, float] | None = None,
    detector: str = "rule_scanner",
) -> DataFrame:
    """Add struct ``into`` with the scan of a text column; null text gives null."""
    result = scan_result(find_spans(F.col(text), rules, detector), weights)
    return df.withColumn(into, F.when(F.col(text).isNotNull(), result))


def scan_chunks(
    chunks: DataFrame,
    into: str = "scan",
    rules: Sequence[Rule] | None = None,
    weights: Mapping[str, float] | None = None,
    detector: str = "rule_scanner",
    exact_offsets: bool = False,
) -> DataFrame:
    """Scan chunk texts and give spans in document offsets.

    Chunk texts are trimmed but ``start_char`` is not, so by default spans lie
    early by the trimmed characters; ``exact_offsets`` adds column ``leading``.
    """
    offset = F.col("start_char")
    if exact_offsets:
        offset = offset + F.col("leading")
    spans = let(find_spans(F.col("text"), rules, detector), lambda found: offset_spans(found, offset))
    return chunks.withColumn(into, F.when(F.col("text").isNotNull(), scan_result(spans, weights)))


def spans_long(df: DataFrame, key: str, spans: str = "scan.spans") -> DataFrame:
    """One row per span.

    The plain generator would make the optimizer repeat the whole scan in a
    filter for non-empty arrays; the outer one does not.
    """
    return df.select(key, F.inline_outer(spans)).filter(F.col("start").isNotNull())


def _ranked_rules(rules: Sequence[Rule] | None, detector: str) -> list[Rule]:
    """The rule pack by falling score; of equal scores the first rule leads."""
    pack = check_rules(rules)
    repeated = {r.name for r in pack if sum(x.name == r.name for x in pack) > 1}
    if repeated:
        raise ValueError(f"Rules in long form are told by name, which several share: {sorted(repeated)}.")
    return sorted(pack, key=lambda rule: -min(1.0, max(0.0, float(rule.score))))


def distinct_spans(
    spans: DataFrame, key: str, rules: Sequence[Rule] | None = None, detector: str = "rule_scanner"
) -> DataFrame:
    """Best scoring span per (key, start, end, category); the first rule of the pack wins ties.

    A span stands for its rule's rank, a small number, so the best one is a plain minimum and hash
    aggregation does. Copies are merged before the shuffle, and one document with very many spans is spread
    over all tasks. Score, name and reason are looked up in the pack afterwards. Spans of a key that lie at the
    same place have the same text.
    """
    ranked = _ranked_rules(rules, detector)
    places = F.create_map(*(F.lit(x) for place, rule in enumerate(ranked) for x in (f"{detector}:{rule.name}", place)))
    unknown = F.raise_error(F.concat(F.lit("Span of a rule outside the pack: "), F.col("detector_name"))).cast("int")
    place = F.coalesce(F.try_element_at(places, F.col("detector_name")), unknown)
    table = F.array(
        *(
            F.struct(F.lit(min(1.0, max(0.0, float(r.score)))).alias("score"), F.lit(f"{detector}:{r.name}").alias("detector_name"), F.lit(r.reason).alias("reason"))
            for r in ranked
        )
    )
    best = spans.groupBy(key, "start", "end", "category", "text").agg(F.min(place).alias("place"))
    found = best.select(key, "start", "end", "category", "text", F.element_at(table, F.col("place") + 1).alias("best"))
    return found.select(key, "start", "end", "category", "text", "best.*")


def roll_up(
    spans: DataFrame,
    key: str,
    weights: Mapping[str, float] | None = None,
    documents: DataFrame | None = None,
) -> DataFrame:
    """Category scores and risk score per document from spans in long form.

    Spans at one place count once, with the best score. They are counted per category first; only the few category rows of a
    document are ever brought together. With ``documents`` each of them has a row, whose
    empty share goes into the same aggregate; one without spans has no category and risk 0.
    """
    per_category = (
        spans.groupBy(key, "start", "end", "category")
        .agg(F.max("score").alias("score"))
        .groupBy(key, "category")
        .agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("evidence_count"))
        .select(key, "category", category_score(F.col("best"), F.col("evidence_count")).alias("score"), "evidence_count")
    )
    if documents is not None:
        nothing = [F.lit(None).cast(per_category.schema[name].dataType).alias(name) for name in ("category", "score")]
        per_category = per_category.unionByName(documents.select(key, *nothing, F.lit(0).cast("long").alias("evidence_count")))
    entry = F.struct("category", "score", F.col("evidence_count").cast("int").alias("evidence_count"))
    grouped = per_category.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("category").isNotNull(), entry))).alias("category_scores"),
        F.sum("evidence_count").alias("flagged_span_count"),
    )
    return grouped.withColumn("risk_score", risk_score(F.col("category_scores"), dict(weights or CATEGORY_WEIGHTS)))
