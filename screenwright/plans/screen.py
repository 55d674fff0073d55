"""Whole screening plans: raw text to decision and safe context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwright.constants import MODEL_WEIGHT, Rule
from screenwright.functions.chunks import ChunkSettings, chunks_of
from screenwright.functions.context import ContextSettings
from screenwright.functions.core import let
from screenwright.functions.rules import deduplicate_spans, find_spans, offset_spans
from screenwright.functions.scoring import Policy, risk_score
from screenwright.operators.chunk import chunk_documents
from screenwright.operators.classifier import TfidfModel
from screenwright.operators.clean import create_documents
from screenwright.operators.expect import document_checks, split_valid
from screenwright.operators.policy import decide, with_safe_context
from screenwright.operators.scan import scan_chunks, scan_result


@dataclass(frozen=True)
class ScreenSettings:
    """Everything a screening run can be told."""

    chunks: ChunkSettings = field(default_factory=ChunkSettings)
    policy: Policy = field(default_factory=Policy)
    context: ContextSettings = field(default_factory=ContextSettings)
    rules: Sequence[Rule] | None = None
    detector: str = "rule_scanner"
    exact_offsets: bool = True
    model_weight: float = MODEL_WEIGHT

    @property
    def weights(self) -> Mapping[str, float]:
        return self.policy.category_weights


def screen_documents(
    documents: DataFrame, settings: ScreenSettings = ScreenSettings(), model_probability: str | None = None
) -> DataFrame:
    """Screen cleaned documents as wholes.

    Chunking, scanning, the roll-up over chunks, the decision and the safe
    context all happen inside the row: no shuffle, and the text is read once.
    The end of a text is always scanned, whatever ``chunks.keep_tail`` says.
    """
    chunking = replace(settings.chunks, keep_tail=True)

    def of_chunk(chunk):
        offset = chunk["start_char"] + chunk["leading"] if settings.exact_offsets else chunk["start_char"]
        return let(
            find_spans(chunk["text"], settings.rules, settings.detector), lambda found: offset_spans(found, offset)
        )

    spans = deduplicate_spans(F.flatten(F.transform(chunks_of(F.col("text"), chunking), of_chunk)))
    # behind a generator, so that a filter on the decision does not repeat the scan
    result = F.inline(F.array(F.struct(scan_result(spans, settings.weights).alias("scan"))))
    scanned = documents.drop("scan").select("*", result)
    score = "scan.risk_score"
    if model_probability:
        blended = risk_score(
            F.col("scan.category_scores"), settings.weights, F.col(model_probability), settings.model_weight
        )
        scanned, score = scanned.withColumn("blended_risk", blended), "blended_risk"
    decided = decide(scanned, score, "scan.category_scores", model_probability, settings.policy)
    return with_safe_context(decided, settings=settings.context)


def screen_raw(
    raw: DataFrame,
    settings: ScreenSettings = ScreenSettings(),
    text: str = "text",
    doc_id: str = "doc_id",
    source_type: str | None = "source_type",
    source_uri: str | None = "source_uri",
    metadata: str | None = None,
    model: TfidfModel | None = None,
) -> DataFrame:
    """Clean raw texts by source type, then screen them.

    With a model, each row also has ``model_prediction``, whose probability is blended
    into the risk. Scoring happens inside the row, as everything else.
    """
    documents = create_documents(raw, text, doc_id, source_type, source_uri, metadata)
    if model is None:
        return screen_documents(documents, settings)
    # behind a generator, so that the Arrow stages of cleaning and scoring stay apart
    documents = documents.select(F.inline(F.array(F.struct(*documents.columns))))
    carry = tuple(name for name in documents.columns if name != "doc_id")
    predicted = model.predict(documents.withColumn("__scored", F.col("text")), "doc_id", "__scored", carry)
    fields = [name for name in predicted.columns if name not in documents.columns]
    with_model = predicted.select(*documents.columns, F.struct(*fields).alias("model_prediction"))
    return screen_documents(with_model, settings, "model_prediction.suspicious_probability")


def split_raw(
    raw: DataFrame, text: str = "text", doc_id: str = "doc_id", source_type: str | None = "source_type"
) -> tuple[DataFrame, DataFrame]:
    """Rows that can be screened, and rejected rows with the reason in ``violation``.

    Null texts, empty ids and source types that are not known are rejected.
    """
    return split_valid(raw, document_checks(doc_id, text, source_type))


def screen_chunks(documents: DataFrame, settings: ScreenSettings = ScreenSettings()) -> DataFrame:
    """Screen every chunk on its own; also narrow."""
    chunks = chunk_documents(documents, replace(settings.chunks, keep_tail=True), leading=True)
    scanned = scan_chunks(
        chunks, "scan", settings.rules, settings.weights, settings.detector, settings.exact_offsets
    )
    return decide(scanned, policy=settings.policy)


def result_columns(screened: DataFrame) -> DataFrame:
    """Flat result rows of a document screening."""
    return screened.select(
        F.col("doc_id").alias("input_id"),
        *(name for name in ("source_type", "metadata", "model_prediction") if name in screened.columns),
        "policy.risk_score",
        "policy.risk_level",
        "policy.decision",
        "policy.should_sanitize",
        "policy.should_block",
        "policy.message",
        "scan.category_scores",
        "scan.spans",
        "scan.flagged_span_count",
        "scan.detected_categories",
        "context.sanitized_text",
        "context.safe_context",
        "context.removed_span_count",
        "context.was_truncated",
    )
