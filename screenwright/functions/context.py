"""Sanitised text and fenced context by column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenwright.constants import CONTEXT_HEADER, REMOVAL_MARKER, TRUNCATION_SUFFIX
from screenwright.functions.core import let, note, noted, paged, rstrip, two_decimals
from screenwright.functions.rules import NO_SPANS

REMOVED = "array<struct<start:int,end:int,category:string,score:double,reason:string>>"


@dataclass(frozen=True)
class ContextSettings:
    """How safe context is built; the wording can be replaced."""

    enabled: bool = True
    include_risk_summary: bool = True
    include_removed_count: bool = True
    max_chars: int = 12000
    mark_removed: bool = True
    marker: str = REMOVAL_MARKER
    suffix: str = TRUNCATION_SUFFIX
    header: Sequence[str] = CONTEXT_HEADER

    def __post_init__(self) -> None:
        if self.max_chars < 500:
            raise ValueError("max_chars must be at least 500.")
        if not self.marker.strip():
            raise ValueError("The marker cannot be empty.")

    @classmethod
    def from_settings(cls, settings: Mapping) -> ContextSettings:
        """Build from ``{"safe_context": {...}, "sanitization": {...}}``."""
        context, removal = settings.get("safe_context", {}), settings.get("sanitization", {})
        given = {
            "enabled": context.get("enabled"),
            "include_risk_summary": context.get("include_risk_summary"),
            "include_removed_count": context.get("include_removed_span_count"),
            "max_chars": context.get("max_safe_context_chars"),
            "mark_removed": removal.get("replace_removed_spans_with_marker"),
            "marker": removal.get("marker"),
        }
        return cls(**{name: value for name, value in given.items() if value is not None})


def normalize_spans(spans: Column, text: Column) -> Column:
    """Clip spans to the text, drop empty ones, sort and merge them."""

    def clipped(part, length: Column) -> Column:
        def fit(s: Column, i: Column) -> Column:
            start = F.least(s["start"], length)
            end = F.greatest(start, F.least(s["end"], length))
            return F.struct(start.alias("start"), end.alias("end"), s["category"].alias("category"), i.alias("at"))

        def cut(k: Column) -> Column:
            span = F.element_at(spans, k["at"] + 1)
            inside = part(k["start"], k["end"])
            return span.withField("start", k["start"]).withField("end", k["end"]).withField("text", inside)

        kept = F.filter(F.transform(spans, fit), lambda k: k["start"] < k["end"])
        return F.transform(F.sort_array(kept), cut)

    fitted = let(F.length(text), lambda length: paged(text, lambda part: clipped(part, length)))
    return merge_spans(F.when(F.size(spans) > 0, fitted).otherwise(F.array().cast(NO_SPANS)))


def merge_spans(ordered: Column) -> Column:
    """Merge sorted spans that overlap or touch.

    The later span's attributes win unless its score is lower; the text stays
    that of the first.
    """

    def joined(last: Column, span: Column) -> Column:
        best = F.when(span["score"] >= last["score"], span).otherwise(last)
        return let(
            best,
            lambda b: F.struct(
                last["start"].alias("start"),
                F.greatest(last["end"], span["end"]).alias("end"),
                last["text"].alias("text"),
                b["category"].alias("category"),
                b["score"].alias("score"),
                b["reason"].alias("reason"),
                b["detector_name"].alias("detector_name"),
            ),
        )

    def scan(state: Column, span: Column) -> Column:
        apart = (state["at"] == 0) | (span["start"] > state["end"])
        return F.struct(
            (state["at"] + 1).alias("at"),
            F.when(apart, span["end"]).otherwise(F.greatest(state["end"], span["end"])).alias("end"),
            F.when(apart, note(state["heads"], state["at"] + 1)).otherwise(state["heads"]).alias("heads"),
        )

    def groups(spans: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit("").alias("heads"))
        heads = noted(F.aggregate(spans, begin, scan)["heads"], "at")

        def merged(starts: Column) -> Column:
            def group(head: Column, k: Column) -> Column:
                beyond = F.coalesce(F.try_element_at(starts, k + 2)["at"], F.size(spans) + 1)
                others = F.slice(spans, head["at"] + 1, beyond - head["at"] - 1)
                return F.aggregate(others, F.element_at(spans, head["at"]), joined)

            return F.transform(starts, group)

        return let(heads, merged)

    return let(ordered, groups).cast(NO_SPANS)


def sanitize(text: Column, spans: Column, marker: str = REMOVAL_MARKER, mark_removed: bool = True) -> Column:
    """Struct of the text without its spans and the list of removed spans."""
    mark = marker if mark_removed else ""

    def cut(merged: Column) -> Column:
        def rebuilt(part) -> Column:
            def before(s: Column, i: Column) -> Column:
                previous = F.when(i == 0, F.lit(0)).otherwise(F.element_at(merged, F.greatest(i, F.lit(1)))["end"])
                return F.concat(part(previous, s["start"]), F.lit(mark))

            tail = part(F.element_at(merged, -1)["end"], F.length(text))
            return F.concat(F.array_join(F.transform(merged, before), ""), tail)

        removed = F.transform(
            merged, lambda s: F.struct(*(s[name].alias(name) for name in ("start", "end", "category", "score", "reason")))
        )
        return F.struct(
            F.when(F.size(merged) > 0, paged(text, rebuilt)).otherwise(text).alias("sanitized_text"),
            removed.cast(REMOVED).alias("removed_spans"),
        )

    return let(normalize_spans(spans, text), cut)


def wrap(
    sanitized: Column,
    decision: Column,
    score: Column,
    removed_count: Column,
    settings: ContextSettings = ContextSettings(),
) -> Column:
    """Header lines and a fence around untrusted text."""
    lines = [F.lit("\n".join(settings.header))]
    if settings.include_risk_summary:
        lines += [
            F.concat(F.lit("Policy decision: "), decision),
            F.concat(F.lit("Risk score: "), two_decimals(score)),
        ]
    if settings.include_removed_count:
        lines.append(F.concat(F.lit("Removed spans: "), removed_count.cast("string")))
    return F.concat(
        F.concat_ws("\n", *lines),
        F.lit("\n\n--- BEGIN UNTRUSTED CONTENT ---\n"),
        sanitized,
        F.lit("\n--- END UNTRUSTED CONTENT ---"),
    )


def truncate(text: Column, max_chars: int, suffix: str = TRUNCATION_SUFFIX) -> Column:
    """Struct of the text cut to ``max_chars`` with a suffix, and whether it was cut."""
    if max_chars < 1:
        raise ValueError("max_chars must be at least 1.")
    kept = rstrip(F.substring(text, 1, max(0, max_chars - len(suffix))))
    long = F.length(text) > max_chars
    return F.struct(
        F.when(long, F.concat(kept, F.lit(suffix))).otherwise(text).alias("text"), long.alias("was_truncated")
    )


def safe_context(
    text: Column, spans: Column, decision: Column, score: Column, settings: ContextSettings = ContextSettings()
) -> Column:
    """Struct with safe context, sanitised text and what was removed."""

    def result(context: Column, sanitized: Column, removed: Column, was_cut: Column) -> Column:
        return F.struct(
            context.alias("safe_context"),
            sanitized.alias("sanitized_text"),
            removed.alias("removed_spans"),
            F.size(removed).alias("removed_span_count"),
            was_cut.alias("was_truncated"),
            decision.alias("decision"),
            score.alias("risk_score"),
        )

    if not settings.enabled:
        built = let(
            truncate(text, settings.max_chars, settings.suffix),
            lambda t: result(t["text"], t["text"], F.array().cast(REMOVED), t["was_truncated"]),
        )
    else:
        built = let(
            sanitize(text, spans, settings.marker, settings.mark_removed),
            lambda s: let(
                truncate(
                    wrap(s["sanitized_text"], decision, score, F.size(s["removed_spans"]), settings),
                    settings.max_chars,
                    settings.suffix,
                ),
                lambda t: result(t["text"], s["sanitized_text"], s["removed_spans"], t["was_truncated"]),
            ),
        )
    return F.when(text.isNotNull(), built)


