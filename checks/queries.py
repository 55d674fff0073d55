"""Queries over the test tables, one or more per operator. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from screenwright.constants import CATEGORY_NAMES, Rule
from screenwright.functions import context, mail, normalize, scoring
from screenwright.functions.chunks import ChunkSettings, estimate_chunk_count
from screenwright.operators import classifier, clean, dataset, evaluation, expect, scan, tfidf
from screenwright.operators.chunk import chunk_documents
from screenwright.operators.lineage import Workspace
from screenwright.operators.normalize import compose_unicode
from screenwright.operators.normalize import normalize as normalize_df
from screenwright.operators.policy import decide, with_safe_context
from screenwright.plans.prepare import prepare
from screenwright.plans.screen import ScreenSettings, result_columns, screen_documents, screen_raw
from screenwright.plans.train import Training, assess, feature_report, train
from screenwright.sources.writers import prediction_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
Spark = SparkSession

CUSTOM_RULES = (
    Rule("license_line", "license", r"\b(license|licensed|copyright)\b", 0.40, "Licence wording."),
    Rule("token_assignment", "secret", r"token\s*=\s*\"[^\"]+\"", 0.90, "Assigned token."),
    Rule("email_address", "personal", r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}", 0.60, "E-mail address."),
)
GATED_RULES = (
    *CUSTOM_RULES,
    Rule("http_address", "address", r"https?://(www\.)?\S+", 0.30, "Address."),
    Rule("wrapped", "style", r"(?:[Tt]he|and)\s+[a-z]+ion[ .,]", 0.20, "Style."),
    Rule("digits", "number", r"\d{3,}", 0.10, "Number."),
    Rule("never", "none", r"(zyx|wvu)+\s*=\s*abc", 0.50, "None."),
)
CUSTOM_WEIGHTS = {"license": 0.2, "secret": 0.5}
CHUNKS = ChunkSettings(300, 50, 20)


def query(function):
    QUERIES[function.__name__] = function
    return function


def r9(column) -> F.Column:
    return F.round(column, 9)


def scanned(spark: Spark, sf: str, *keep: str) -> DataFrame:
    return scan.scan(views.seeded_documents(spark, sf, *keep)).drop("text")


# --- scan, score, policy -----------------------------------------------------


@query
def decisions_by_source(spark: Spark, sf: str) -> DataFrame:
    decided = decide(scanned(spark, sf, "source"))
    return decided.groupBy("source", F.col("policy.decision").alias("decision")).agg(
        F.count(F.lit(1)).alias("documents"), F.max(r9("policy.risk_score")).alias("max_risk")
    )


@query
def scan_spans(spark: Spark, sf: str) -> DataFrame:
    spans = scan.spans_long(scanned(spark, sf), "doc_id")
    return spans.select("doc_id", "start", "end", F.col("text").alias("span_text"), "category", "score", "reason", "detector_name")


@query
def category_scores(spark: Spark, sf: str) -> DataFrame:
    rows = scanned(spark, sf).select("doc_id", F.inline_outer("scan.category_scores")).filter("category is not null")
    return rows.select("doc_id", "category", r9("score").alias("score"), "evidence_count")


@query
def risk_scores(spark: Spark, sf: str) -> DataFrame:
    s = F.col("scan.risk_score")
    return scanned(spark, sf).select(
        "doc_id",
        r9(s).alias("risk_score"),
        scoring.band_name(s).alias("band"),
        scoring.risk_level(s).alias("risk_level"),
        scoring.decision(s).alias("decision"),
        F.col("scan.flagged_span_count").alias("flagged_span_count"),
        F.array_join("scan.detected_categories", ",").alias("categories"),
    )


@query
def risk_scores_floor_gap(spark: Spark, sf: str) -> DataFrame:
    s = F.col("scan.risk_score")
    floor = scoring.Policy(gap_policy="floor")
    return scanned(spark, sf).select("doc_id", scoring.decision(s, floor).alias("decision"))


@query
def model_blend(spark: Spark, sf: str) -> DataFrame:
    model = F.when(F.col("doc_id") % 3 > 0, views.pseudo_probability())
    risk = scoring.risk_score(F.col("scan.category_scores"), model_score=F.col("model"))
    blended = scanned(spark, sf).withColumn("model", model).withColumn("risk", risk)
    return blended.select("doc_id", r9("risk").alias("risk_score"), scoring.decision(F.col("risk")).alias("decision"))


@query
def policy_messages(spark: Spark, sf: str) -> DataFrame:
    model = F.when(F.col("doc_id") % 2 == 0, views.pseudo_probability())
    decided = decide(scanned(spark, sf).withColumn("model", model), model_probability="model")
    return decided.select("doc_id", "policy.should_sanitize", "policy.should_block", "policy.message")


@query
def band_gaps(spark: Spark, sf: str) -> DataFrame:
    score = (F.col("n_chars") % 1201) / F.lit(1000.0) - F.lit(0.1)
    df = views.table(spark, sf, "documents", "doc_id", "n_chars").select("doc_id", score.alias("score"))
    decided = decide(df, "score", None)
    return decided.select(
        "doc_id",
        r9("policy.risk_score").alias("risk_score"),
        "policy.decision",
        "policy.risk_level",
        scoring.band_name(F.col("score"), scoring.Policy(gap_policy="floor")).alias("floor_band"),
    )


@query
def custom_rules(spark: Spark, sf: str) -> DataFrame:
    df = views.table(spark, sf, "documents", "doc_id", "text")
    result = scan.scan(df, rules=CUSTOM_RULES, weights=CUSTOM_WEIGHTS, detector="own")
    return result.select("doc_id", r9("scan.risk_score").alias("risk_score"), F.inline_outer("scan.spans")).select(
        "doc_id", "risk_score", "start", "end", "category", "detector_name"
    )


@query
def gated_rules(spark: Spark, sf: str) -> DataFrame:
    """Own patterns that run only where a string occurs that each of their matches must hold."""
    df = scan.scan(views.table(spark, sf, "documents", "doc_id", "text"), rules=GATED_RULES, detector="own")
    spans = scan.spans_long(df, "doc_id")
    return spans.select("doc_id", "start", "end", "category", "detector_name")


@query
def scan_pages_raw(spark: Spark, sf: str) -> DataFrame:
    """Rule scan of uncleaned pages."""
    df = views.table(spark, sf, "pages", "page_id", F.col("html").alias("text"), key="page_id")
    result = scan.scan(df).select("page_id", "scan.flagged_span_count", r9("scan.risk_score").alias("risk_score"))
    return result


@query
def category_names(spark: Spark, sf: str) -> DataFrame:
    spans = scan.spans_long(scanned(spark, sf), "doc_id")
    counts = spans.groupBy("category").agg(F.count(F.lit(1)).alias("spans"))
    return counts.withColumn("display_name", scoring.category_display_name(F.col("category")))


@query
def label_names(spark: Spark, sf: str) -> DataFrame:
    df = views.table(spark, sf, "labels", "doc_id", F.col("toxic").alias("label"), key="doc_id")
    named = df.withColumn("name", scoring.label_name(F.col("label")))
    back = scoring.label_of_name(F.concat(F.lit(" "), F.upper("name")))
    return named.groupBy("label", "name", back.alias("label_again")).agg(F.count(F.lit(1)).alias("rows"))


# --- normalise and clean -----------------------------------------------------


@query
def normalize_noisy(spark: Spark, sf: str) -> DataFrame:
    return normalize_df(views.noisy_documents(spark, sf)).select("doc_id", "norm.*").withColumnRenamed("text", "clean")


@query
def normalize_steps(spark: Spark, sf: str) -> DataFrame:
    text = F.col("text")
    return views.noisy_documents(spark, sf).select(
        "doc_id",
        F.md5(normalize.remove_control_chars(text)).alias("without_control"),
        F.md5(normalize.remove_zero_width_chars(text)).alias("without_zero_width"),
        F.md5(normalize.normalize_line_endings(text)).alias("line_endings"),
        F.md5(normalize.normalize_whitespace(text)).alias("whitespace"),
        F.md5(normalize.collapse_long_runs(text)).alias("runs"),
    )


@query
def nfkc(spark: Spark, sf: str) -> DataFrame:
    """Ligatures and full-width letters put into whole texts, composed back."""
    df = views.table(spark, sf, "documents", "doc_id", "text")
    wide = F.translate(F.regexp_replace("text", "fi", chr(0xFB01)), "ae", chr(0xFF41) + chr(0xFF45))
    composed = compose_unicode(df.withColumn("text", wide), "text")
    return composed.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("length"))


@query
def effectively_empty(spark: Spark, sf: str) -> DataFrame:
    df = views.table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    blanked = df.withColumn("text", F.when(F.col("role") == "user", F.lit(" \t\r\n" + chr(0x200B))).otherwise(F.col("text")))
    flagged = normalize_df(blanked).withColumn("is_empty", F.col("norm.text") == "")
    return flagged.groupBy("role", "is_empty").agg(F.count(F.lit(1)).alias("rows"))


@query
def clean_html(spark: Spark, sf: str) -> DataFrame:
    pages = views.table(spark, sf, "pages", "page_id", "html")
    return clean.clean_html(pages).select(
        "page_id", "cleaned.text", "cleaned.original_length", "cleaned.cleaned_length", "cleaned.changed", "cleaned.cleaner"
    )


@query
def html_titles(spark: Spark, sf: str) -> DataFrame:
    pages = views.table(spark, sf, "pages", "page_id", "html")
    return clean.clean_html(pages).select("page_id", "cleaned.title")


@query
def clean_nested_html(spark: Spark, sf: str) -> DataFrame:
    """Pages between elements without text that nest, end early, close themselves or never close."""
    pages = views.table(spark, sf, "pages", "page_id", "html")
    front = "<svg><title>no</title><svg>no</svg>no</svg><noscript><TEMPLATE>no</noscript>"
    behind = "<template>no<template a='</template>'>no</template><canvas>no</template>tail<svg/>more</svg><i title='<svg>'>end</i><canvas>no<p>no</svg>"
    return clean.clean_html(pages.withColumn("html", F.concat(F.lit(front), "html", F.lit(behind)))).select("page_id", "cleaned.text", "cleaned.title")


@query
def email_bodies(spark: Spark, sf: str) -> DataFrame:
    df = views.mails(spark, sf)
    return df.select("conv_id", "turn", mail.single_part_body(F.col("raw")).alias("body"))


@query
def clean_email(spark: Spark, sf: str) -> DataFrame:
    cleaned = clean.clean_email(views.mails(spark, sf), "raw")
    return cleaned.select("conv_id", "turn", "cleaned.text", "cleaned.original_length", "cleaned.cleaned_length")


@query
def clean_email_multipart(spark: Spark, sf: str) -> DataFrame:
    cleaned = clean.clean_email(views.mails(spark, sf, multipart=True), "raw")
    return cleaned.select("conv_id", "turn", "cleaned.text", "cleaned.cleaned_length")


@query
def create_documents(spark: Spark, sf: str) -> DataFrame:
    """Pages, messages and plain texts through one cleaning step."""
    uri = F.lit(None).cast("string")
    pages = views.table(spark, sf, "pages", "page_id", "html", "url").select(
        F.concat(F.lit("p"), "page_id").alias("doc_id"), F.col("html").alias("text"), F.lit("webpage").alias("source_type"),
        F.col("url").alias("source_uri"), F.create_map(F.lit("cleaner"), F.lit("given")).alias("metadata"),
    )
    messages = views.mails(spark, sf).select(
        F.concat_ws("_", F.lit("m"), "conv_id", "turn").alias("doc_id"), F.col("raw").alias("text"),
        F.lit("email").alias("source_type"), uri.alias("source_uri"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    plain = views.noisy_documents(spark, sf).select(
        F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", uri.alias("source_type"), uri.alias("source_uri"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    documents = clean.create_documents(pages.unionByName(messages).unionByName(plain), metadata="metadata")
    return documents.select(
        "doc_id", "source_type", "source_uri", F.md5("text").alias("digest"), F.col("metadata")["cleaner"].alias("cleaner"),
        F.col("metadata")["title"].alias("title"), "original_length", "cleaned_length",
    )


@query
def reject_invalid(spark: Spark, sf: str) -> DataFrame:
    df = views.table(spark, sf, "documents", "doc_id", "text", "source", "n_chars")
    broken = df.select(
        F.when(F.col("n_chars") % 7 == 0, " \t").otherwise(F.col("doc_id").cast("string")).alias("doc_id"),
        F.when(F.col("n_chars") % 5 > 0, F.col("text")).alias("text"),
        F.when(F.col("n_chars") % 3 == 0, F.col("source")).otherwise("email").alias("source_type"),
    )
    marked = expect.with_violation(broken, expect.document_checks(source_type="source_type"))
    return marked.groupBy("violation").agg(F.count(F.lit(1)).alias("rows"))


@query
def valid_spans(spark: Spark, sf: str) -> DataFrame:
    """Spans of the seeded documents, some of them moved out of their text: which are kept and why the others are not."""
    spans = scan.spans_long(scanned(spark, sf), "doc_id")
    moved = spans.withColumn("start", F.when(F.col("doc_id") % 4 == 1, F.col("start") - 10_000_000).otherwise(F.col("start")))
    moved = moved.withColumn("end", F.when(F.col("doc_id") % 4 == 2, F.col("start") - 1).otherwise(F.col("end")))
    valid, rejected = expect.split_valid(moved, expect.span_checks())
    rows = F.count(F.lit(1)).alias("rows")
    return valid.groupBy("category", F.lit(None).cast("string").alias("violation")).agg(rows).unionByName(
        rejected.groupBy("category", "violation").agg(rows)
    )


@query
def invalid_records(spark: Spark, sf: str) -> DataFrame:
    """Chunks, category scores and predictions with values that their checks must refuse, by reason."""
    df = views.table(spark, sf, "documents", "doc_id", "text", "source", "n_chars")
    blank = F.when(F.col("n_chars") % 7 == 0, " \t").when(F.col("n_chars") % 11 == 0, None).otherwise(F.col("source"))
    records = {
        "chunk": (
            df.select(
                blank.alias("chunk_id"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id").cast("string")).alias("doc_id"),
                F.when(F.col("n_chars") % 3 > 0, F.col("text")).alias("text"), (F.col("doc_id") % 10 - 2).alias("start_char"),
                (F.col("n_chars") % 13).alias("end_char"),
            ),
            expect.chunk_checks(),
        ),
        "category score": (df.select((F.col("n_chars") % 5 - 1).alias("evidence_count")), expect.category_score_checks()),
        "prediction": (df.select(blank.alias("model_name")), expect.prediction_checks()),
    }
    counted = [
        expect.with_violation(rows, checks).groupBy(F.lit(kind).alias("kind"), "violation").agg(F.count(F.lit(1)).alias("rows"))
        for kind, (rows, checks) in records.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


# --- chunks ------------------------------------------------------------------


@query
def chunks(spark: Spark, sf: str) -> DataFrame:
    df = views.table(spark, sf, "documents", "doc_id", "text")
    return chunk_documents(df).select("chunk_id", "doc_id", "chunk_index", "start_char", "end_char", "text")


@query
def chunks_small(spark: Spark, sf: str) -> DataFrame:
    return chunk_documents(views.seeded_documents(spark, sf), CHUNKS).select("chunk_id", "start_char", "end_char", "text")


@query
def chunks_plain(spark: Spark, sf: str) -> DataFrame:
    """No boundaries and no overlap: the short tail of a text is dropped, or kept on request."""
    df = views.table(spark, sf, "documents", "doc_id", "text")
    dropped = chunk_documents(df, ChunkSettings(500, 0, 100, False))
    kept = chunk_documents(df, ChunkSettings(500, 0, 100, False, keep_tail=True))
    columns = ("doc_id", "chunk_index", "start_char", "end_char")
    return dropped.select(F.lit("dropped").alias("tail"), *columns).unionByName(kept.select(F.lit("kept").alias("tail"), *columns))


@query
def chunk_count_estimate(spark: Spark, sf: str) -> DataFrame:
    df = views.table(spark, sf, "documents", "doc_id", "text")
    return df.select("doc_id", estimate_chunk_count(F.length("text")).alias("chunks"))


@query
def chunk_scan(spark: Spark, sf: str) -> DataFrame:
    found = scan.scan_chunks(chunk_documents(views.seeded_documents(spark, sf), CHUNKS, leading=True))
    found = found.select("chunk_id", "start_char", r9("scan.risk_score").alias("risk_score"), F.inline_outer("scan.spans"))
    return found.filter("start is not null").select(
        "chunk_id", "start_char", "risk_score", "start", "end", "category", "detector_name"
    )


@query
def chunk_rollup(spark: Spark, sf: str) -> DataFrame:
    """Exact spans of all chunks, rolled up to documents by aggregates."""
    found = scan.scan_chunks(chunk_documents(views.seeded_documents(spark, sf), CHUNKS, leading=True), exact_offsets=True)
    every = views.table(spark, sf, "documents", "doc_id")
    rolled = scan.roll_up(scan.spans_long(found, "doc_id"), "doc_id", documents=every)
    return rolled.select(
        "doc_id", "flagged_span_count", r9("risk_score").alias("risk_score"),
        scoring.decision(F.col("risk_score")).alias("decision"),
    )


@query
def distinct_chunk_spans(spark: Spark, sf: str) -> DataFrame:
    """Spans of overlapping chunks in document offsets, each place once, with the first of the best rules."""
    found = scan.scan_chunks(chunk_documents(views.seeded_documents(spark, sf), CHUNKS, leading=True), exact_offsets=True)
    best = scan.distinct_spans(scan.spans_long(found, "doc_id"), "doc_id")
    return best.select("doc_id", "start", "end", "category", "text", "score", "detector_name", "reason")


@query
def screened_documents(spark: Spark, sf: str) -> DataFrame:
    """The whole plan in one pass: chunk, scan, roll up, decide, sanitise."""
    result = screen_documents(views.seeded_documents(spark, sf), ScreenSettings(chunks=CHUNKS))
    return result.select(
        "doc_id", "scan.flagged_span_count", r9("policy.risk_score").alias("risk_score"), "policy.decision",
        F.md5("context.sanitized_text").alias("sanitized"),
    )


@query
def blocked_documents(spark: Spark, sf: str) -> DataFrame:
    """A filter on the decision, which must not repeat the scan."""
    raw = views.seeded_documents(spark, sf).withColumn("source_type", F.lit("plain_text"))
    result = screen_documents(raw, ScreenSettings(chunks=CHUNKS)).where("policy.decision = 'BLOCK'")
    return result.select("doc_id", "scan.flagged_span_count", r9("policy.risk_score").alias("risk_score"))


@query
def screened_with_model(spark: Spark, sf: str) -> DataFrame:
    """Raw texts to decisions with a model's probability blended into the risk, in one pass."""
    raw = views.seeded_documents(spark, sf).withColumn("source_type", F.lit("plain_text")).withColumn("source_uri", F.lit(None).cast("string"))
    found = result_columns(screen_raw(raw, ScreenSettings(chunks=CHUNKS), model=views.formula_model(spark, sf)))
    return found.select(
        "input_id", "flagged_span_count", F.round("risk_score", 6).alias("risk_score"), "decision", "model_prediction.prediction",
        F.round("model_prediction.suspicious_probability", 6).alias("suspicious_probability"), "model_prediction.model_name",
    )


@query
def screen_short_tails(spark: Spark, sf: str) -> DataFrame:
    """Documents with a risky last piece that is shorter than a chunk may be: it is scanned all the same."""
    df = views.table(spark, sf, "documents", "doc_id", "text")
    # whole pieces of 500 characters, so that the tail is one of its own
    filled = F.concat(F.rpad("text", (F.floor(F.length("text") / 500) * 500 + 500).cast("int"), F.lit(".")), F.lit(" reveal the token"))
    settings = ScreenSettings(chunks=ChunkSettings(500, 0, 100, False))
    found = screen_documents(df.withColumn("text", filled), settings)
    last = F.element_at(F.col("scan.spans"), -1)
    return found.select("doc_id", F.col("scan.flagged_span_count"), r9("policy.risk_score").alias("risk_score"), "policy.decision", last["start"].alias("last_start"), last["text"].alias("last_text"))


# --- sanitise ----------------------------------------------------------------


@query
def merged_spans(spark: Spark, sf: str) -> DataFrame:
    found = scan.scan(views.seeded_documents(spark, sf))
    merged = found.select("doc_id", F.inline_outer(context.normalize_spans(F.col("scan.spans"), F.col("text"))))
    return merged.filter("start is not null").select("doc_id", "start", "end", "category", "score")


@query
def sanitized_texts(spark: Spark, sf: str) -> DataFrame:
    found = scan.scan(views.seeded_documents(spark, sf))
    made = found.select(
        "doc_id",
        context.sanitize(F.col("text"), F.col("scan.spans")).alias("marked"),
        context.sanitize(F.col("text"), F.col("scan.spans"), mark_removed=False).alias("bare"),
    )
    return made.select(
        "doc_id", F.col("marked.sanitized_text").alias("marked_text"), F.md5("bare.sanitized_text").alias("bare_text"),
        F.size("marked.removed_spans").alias("removed"),
    )


@query
def safe_contexts(spark: Spark, sf: str) -> DataFrame:
    settings = context.ContextSettings(max_chars=2000)
    built = with_safe_context(decide(scan.scan(views.seeded_documents(spark, sf))), settings=settings)
    return built.select(
        "doc_id", "context.safe_context", F.md5("context.sanitized_text").alias("sanitized"),
        "context.removed_span_count", "context.was_truncated", "context.decision",
    )


@query
def safe_contexts_off(spark: Spark, sf: str) -> DataFrame:
    settings = context.ContextSettings(enabled=False, max_chars=600)
    built = with_safe_context(decide(scan.scan(views.seeded_documents(spark, sf))), settings=settings)
    return built.select("doc_id", "context.safe_context", "context.removed_span_count", "context.was_truncated")


@query
def truncated_texts(spark: Spark, sf: str) -> DataFrame:
    df = views.table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return df.select("conv_id", "turn", F.inline(F.array(context.truncate(F.col("text"), 100))))


# --- dataset preparation -----------------------------------------------------


def _labelled(spark: Spark, sf: str) -> DataFrame:
    return views.labelled_documents(spark, sf)


def _prepared(spark: Spark, sf: str, rows_per_range: int | None = None):
    test = views.table(spark, sf, "conversations", "conv_id", "turn", "role", "text").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", (F.col("role") == "user").cast("int").alias("label")
    )
    train_rows = _labelled(spark, sf).select("doc_id", "text", "label")
    return prepare(train_rows, test, order="doc_id", dataset_name="labelled_documents", output_dir="out", rows_per_range=rows_per_range)


@query
def prepared_distinct(spark: Spark, sf: str) -> DataFrame:
    groups = dataset.distinct_texts(dataset.labelled_texts(_labelled(spark, sf), order="doc_id"), Workspace(spark))
    return groups.select(F.md5("text").alias("digest"), "label", "position", "copies")


def _with_ids(spark: Spark, sf: str, rows_per_range: int | None = None) -> DataFrame:
    space = Workspace(spark)
    kept = dataset.without_empty(dataset.distinct_texts(dataset.labelled_texts(_labelled(spark, sf), order="doc_id"), space))
    narrow = kept.select("position", "label")
    return dataset.sequential_ids(narrow, "raw_train", space, rows_per_range=rows_per_range).select("id", "position", "label")


@query
def prepared_ids(spark: Spark, sf: str) -> DataFrame:
    return _with_ids(spark, sf)


@query
def prepared_ids_in_ranges(spark: Spark, sf: str) -> DataFrame:
    """The same numbers from ranges of a few rows each."""
    return _with_ids(spark, sf, rows_per_range=50)


@query
def prepared_rows(spark: Spark, sf: str) -> DataFrame:
    return _prepared(spark, sf).rows.select("split", "id", F.md5("text").alias("digest"), "label", "source_dataset")


@query
def prepared_rows_in_ranges(spark: Spark, sf: str) -> DataFrame:
    """The same splits and numbers from ranges of a few rows each."""
    return _prepared(spark, sf, 50).rows.select("split", "id", F.md5("text").alias("digest"), "label", "source_dataset")


@query
def prepared_summary(spark: Spark, sf: str) -> DataFrame:
    labels = {
        f"{split}_{label}": F.coalesce(F.try_element_at(F.col(f"{split}_label_counts"), F.lit(label)), F.lit(0))
        for split in ("train", "val", "test")
        for label in ("0", "1")
    }
    plain = ("train_rows", "val_rows", "test_rows", "removed_empty_rows", "removed_duplicate_rows", "output_dir")
    return _prepared(spark, sf).summary.select(*plain, *(value.alias(name) for name, value in labels.items()))


@query
def label_counts(spark: Spark, sf: str) -> DataFrame:
    rows = dataset.labelled_texts(_labelled(spark, sf), order="doc_id")
    return rows.select(dataset.binary_label(F.col("label")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


# --- classifier --------------------------------------------------------------


def _terms(spark: Spark, sf: str) -> DataFrame:
    return tfidf.terms_of(views.table(spark, sf, "documents", "doc_id", "text"))


@query
def document_frequency(spark: Spark, sf: str) -> DataFrame:
    return tfidf.document_frequency(_terms(spark, sf))


def _vocabulary(spark: Spark, sf: str) -> DataFrame:
    frequency = tfidf.document_frequency(_terms(spark, sf))
    return tfidf.vocabulary(frequency, views.table(spark, sf, "documents", "doc_id").count())


@query
def vocabulary(spark: Spark, sf: str) -> DataFrame:
    return _vocabulary(spark, sf).select("term", "df", "total_tf", r9("idf").alias("idf"), "index")


@query
def tfidf_weights(spark: Spark, sf: str) -> DataFrame:
    rows = tfidf.tfidf_rows(_terms(spark, sf), _vocabulary(spark, sf), "doc_id")
    weights = rows.select("doc_id", F.inline(F.arrays_zip("vocabulary_terms", "values")))
    return weights.select("doc_id", F.col("vocabulary_terms").alias("term"), F.round("values", 6).alias("weight"))


def _training(spark: Spark, sf: str) -> Training:
    """Everything training does after the solver, with a model from a formula."""
    return assess(views.formula_model(spark, sf), views.split_documents(spark, sf))


@query
def train_predict(spark: Spark, sf: str) -> DataFrame:
    training = _training(spark, sf)
    rows = prediction_rows(training.scored.filter("split = 'test'"), training.best)
    return rows.withColumn("suspicious_probability", F.round("suspicious_probability", 6))


@query
def structured_predictions(spark: Spark, sf: str) -> DataFrame:
    df = views.table(spark, sf, "documents", "doc_id", "text")
    predicted = views.formula_model(spark, sf).predict(df, "doc_id")
    return predicted.withColumns({n: F.round(n, 6) for n in ("suspicious_probability", "benign_probability")})


@query
def predict_repeated_keys(spark: Spark, sf: str) -> DataFrame:
    """A key that many rows share: each keeps its own probability."""
    df = views.table(spark, sf, "documents", "doc_id", "text", "lang")
    scored = views.formula_model(spark, sf).predict_probabilities(df, "lang")
    return scored.select("lang", F.round("probability", 6).alias("probability"))


@query
def model_evaluation(spark: Spark, sf: str) -> DataFrame:
    return views.formula_model(spark, sf).evaluate(views.split_documents(spark, sf), "id").select(*_rounded())


@query
def training_metrics(spark: Spark, sf: str) -> DataFrame:
    return evaluation.metrics_summary(_training(spark, sf).metrics, "kind", "split", "threshold")


@query
def training_report(spark: Spark, sf: str) -> DataFrame:
    sections = {"train": "default", "validation": "default", "test": "best"}
    return _training(spark, sf).payload(0.5).select(
        "model_name", "default_threshold", "best_validation_threshold",
        *(
            F.col(f"{kind}_threshold_metrics.{split}.{name}").alias(f"{split}_{kind}_{name}")
            for split, kind in sections.items() for name in (*evaluation.SUMMARY, "support")
        ),
        F.size("validation_threshold_sweep").alias("thresholds"),
    )


@query
def top_features(spark: Spark, sf: str) -> DataFrame:
    return views.formula_model(spark, sf).top_features(20).withColumn("coefficient", r9("coefficient"))


@query
def top_features_report(spark: Spark, sf: str) -> DataFrame:
    report = feature_report(views.formula_model(spark, sf), 30)
    sides = [report.select(F.lit(side).alias("side"), F.posexplode(side)) for side in ("suspicious", "benign")]
    return sides[0].unionByName(sides[1]).select("side", "pos", "col.term", r9("col.weight").alias("weight"))


@query
def fit_optimality(spark: Spark, sf: str) -> DataFrame:
    """How near the solver's result is to the optimum over all labelled documents, by its duality gap."""
    rows = _labelled(spark, sf)
    found = classifier.fit(rows, "doc_id").certificate(rows)
    return found.select("rows", "terms", r9("loss_at_zero").alias("loss_at_zero"), (F.col("gap") < 1e-4 * F.col("weight")).alias("near_optimum"), (F.col("loss") < F.col("loss_at_zero")).alias("learned"))


@query
def training_certificate(spark: Spark, sf: str) -> DataFrame:
    """Training as a whole: fit on one split, a threshold from another, and a bound on what is left to gain."""
    rows = views.split_documents(spark, sf)
    training = train(rows)
    found = training.model.certificate(rows.where("split = 'train'"))
    splits = training.scored.agg(*(F.count_if(F.col("split") == name).alias(f"{name}_rows") for name in ("train", "val", "test")))
    one = F.lit(1).alias("one")
    return found.select("*", one).join(splits.select("*", one), "one").select(
        "train_rows", "val_rows", "test_rows", "terms", r9("loss_at_zero").alias("loss_at_zero"),
        (F.col("iterations") < training.model.settings.max_iter).alias("ended"),
        (F.col("gap") < 1e-4 * F.col("weight")).alias("near_optimum"),
        (F.col("loss") < F.col("loss_at_zero")).alias("learned"),
    )


# --- evaluation --------------------------------------------------------------


def _predicted(spark: Spark, sf: str) -> DataFrame:
    scored = views.scored_labels(spark, sf)
    return scored.withColumn("prediction", evaluation.predicted_label(F.col("probability")))


METRICS = (
    *evaluation.COUNTS, "support", "accuracy", "precision", "recall", "specificity", "false_positive_rate",
    "false_negative_rate", "positive_rate", "predicted_positive_rate", "f1", "balanced_accuracy",
)


def _rounded() -> list:
    return [*METRICS[:5], *(r9(name).alias(name) for name in METRICS[5:])]


@query
def confusion(spark: Spark, sf: str) -> DataFrame:
    return evaluation.confusion_counts(_predicted(spark, sf))


@query
def metrics(spark: Spark, sf: str) -> DataFrame:
    return evaluation.binary_metrics(_predicted(spark, sf)).select(*_rounded())


@query
def metrics_by_lang(spark: Spark, sf: str) -> DataFrame:
    languages = views.table(spark, sf, "documents", "doc_id", "lang")
    return evaluation.binary_metrics(_predicted(spark, sf).join(languages, "doc_id"), by=["lang"]).select("lang", *_rounded())


@query
def threshold_sweep(spark: Spark, sf: str) -> DataFrame:
    return evaluation.threshold_sweep(views.scored_labels(spark, sf)).select("threshold", *_rounded())


@query
def best_threshold(spark: Spark, sf: str) -> DataFrame:
    sweep = evaluation.threshold_sweep(views.scored_labels(spark, sf))
    return evaluation.best_threshold(sweep).select("threshold", *_rounded())


@query
def metrics_summary(spark: Spark, sf: str) -> DataFrame:
    return evaluation.metrics_summary(evaluation.binary_metrics(_predicted(spark, sf)))


CATEGORIES = tuple(sorted(CATEGORY_NAMES))
