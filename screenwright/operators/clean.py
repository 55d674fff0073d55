"""Cleaning of raw texts by source type."""

from __future__ import annotations

import email
from collections.abc import Iterator
from email import policy as mail_policy

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenwright.functions import mail
from screenwright.functions.html import raw_title, visible_text
from screenwright.functions.normalize import normalized_text
from screenwright.operators.arrow import text_slices
from screenwright.operators.normalize import compose_unicode

_HELD = "__composed"
_TITLE = "__title"


@F.arrow_udf(T.StringType())
def _multipart_body(raws: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """First text/plain part as it stands in the message, else the message itself."""

    def plain_part(text: str) -> str:
        message = email.message_from_string(text, policy=mail_policy.default)
        parts = message.walk() if message.is_multipart() else [message]
        plain = (p for p in parts if not message.is_multipart() or p.get_content_type() == "text/plain")
        payloads = (p.get_payload(decode=False) for p in plain)
        return next((payload for payload in payloads if isinstance(payload, str)), text)

    for part in text_slices(raws):
        yield pa.array([None if text is None else plain_part(text) for text in part.to_pylist()], pa.string())


def extract_email_body(df: DataFrame, raw: str = "text", into: str = "body") -> DataFrame:
    """Add the body of each message.

    Messages without parts stay in expressions; only those that may have parts
    reach the MIME parser, all others send it a null.
    """
    return df.withColumn(into, _email_body(F.col(raw), F.lit(True)))


def _email_body(raw: Column, applies: Column) -> Column:
    parsed = _multipart_body(F.when(applies & mail.may_be_multipart(raw), raw))
    return F.coalesce(parsed, mail.single_part_body(raw))


def _email_lines(body: Column) -> Column:
    return mail.remove_reply_lines(mail.remove_header_lines(body))


def clean_email(df: DataFrame, raw: str = "text", into: str = "cleaned") -> DataFrame:
    return _finish(df.withColumn(_HELD, _email_lines(_email_body(F.col(raw), F.lit(True)))), raw, into, "email")


def clean_html(df: DataFrame, raw: str = "html", into: str = "cleaned") -> DataFrame:
    held = df.withColumn(_HELD, visible_text(F.col(raw))).withColumn(_TITLE, raw_title(F.col(raw)))
    return _finish(held, raw, into, "html")


def clean_plain_text(df: DataFrame, raw: str = "text", into: str = "cleaned") -> DataFrame:
    return _finish(df.withColumn(_HELD, F.col(raw)), raw, into, "plain_text")


def _finish(df: DataFrame, raw: str, into: str, cleaner: str | Column) -> DataFrame:
    """Compose, normalise and pack the held text (and title) into one struct."""
    title = _TITLE in df.columns
    composed = compose_unicode(df, _HELD, *([_TITLE] if title else []))
    fields = [
        F.col("__text").alias("text"),
        F.length(raw).alias("original_length"),
        F.length("__text").alias("cleaned_length"),
        (F.length(raw) != F.length("__text")).alias("changed"),
        (F.lit(cleaner) if isinstance(cleaner, str) else cleaner).alias("cleaner"),
    ]
    if title:
        fields.append(F.nullif(normalized_text(F.col(_TITLE)), F.lit("")).alias("title"))
    packed = composed.withColumn("__text", normalized_text(F.col(_HELD))).withColumn(
        into, F.when(F.col(raw).isNotNull(), F.struct(*fields))
    )
    return packed.drop(_HELD, _TITLE, "__text")


def clean_text(df: DataFrame, raw: str = "text", source_type: str = "source_type", into: str = "cleaned") -> DataFrame:
    """Clean each row by its source type: pages, messages, and everything else as plain text."""
    kind = F.col(source_type)
    page, message = kind == "webpage", kind == "email"
    text = F.col(raw)
    # The MIME stage is evaluated for every row, so its input is null outside messages.
    held = df.withColumn("__body", _email_body(text, F.coalesce(message, F.lit(False))))
    found = F.struct(
        F.when(page, visible_text(text)).when(message, _email_lines(F.col("__body"))).otherwise(text).alias(_HELD),
        F.when(page, raw_title(text)).alias(_TITLE),
    )
    # behind a generator, so that markup is gone through once and the Arrow stages stay apart
    held = held.select(*df.columns, F.inline(F.array(found)))
    cleaner = F.when(page, "html").when(message, "email").otherwise("plain_text")
    return _finish(held, raw, into, cleaner)


def create_documents(
    df: DataFrame,
    raw: str = "text",
    doc_id: str = "doc_id",
    source_type: str | None = "source_type",
    source_uri: str | None = "source_uri",
    metadata: str | None = None,
) -> DataFrame:
    """Cleaned documents: id, text, source type, source address and metadata.

    The caller's metadata override those of the cleaner.
    """
    kind = F.coalesce(F.col(source_type), F.lit("unknown")) if source_type else F.lit("unknown")
    uri = F.col(source_uri) if source_uri else F.lit(None).cast("string")
    given = F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>")) if metadata else None
    base = df.select(
        F.col(doc_id).cast("string").alias("doc_id"),
        F.col(raw).alias("__raw"),
        kind.alias("source_type"),
        uri.cast("string").alias("source_uri"),
        *([given.alias("__given")] if given is not None else []),
    )
    cleaned = clean_text(base, "__raw", "source_type", "cleaned")
    return documents_of(cleaned, "__given" if given is not None else None)


def documents_of(cleaned: DataFrame, metadata: str | None = None) -> DataFrame:
    """Documents from cleaned texts; the source address is kept among the metadata."""
    details = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("source_uri").alias("key"), F.col("source_uri").alias("value")),
                F.struct(F.lit("cleaner").alias("key"), F.col("cleaned.cleaner").alias("value")),
                F.struct(F.lit("title").alias("key"), F.col("cleaned.title").alias("value")),
            ),
            lambda entry: entry["value"].isNotNull(),
        )
    )
    if metadata:
        given = F.col(metadata)
        details = F.map_concat(F.map_filter(details, lambda key, _: ~F.map_contains_key(given, key)), given)
    return cleaned.select(
        "doc_id",
        F.col("cleaned.text").alias("text"),
        "source_type",
        "source_uri",
        details.alias("metadata"),
        F.col("cleaned.original_length").alias("original_length"),
        F.col("cleaned.cleaned_length").alias("cleaned_length"),
    )
