"""Screening of untrusted text for prompt-injection risk, as Spark jobs."""

from screenwright.constants import DEFAULT_RULES, Rule
from screenwright.functions.chunks import ChunkSettings
from screenwright.functions.context import ContextSettings
from screenwright.functions.scoring import Band, Policy
from screenwright.operators.tfidf import TfidfSettings
from screenwright.plans.screen import ScreenSettings, screen_chunks, screen_documents, screen_raw

__all__ = [
    "DEFAULT_RULES",
    "Band",
    "ChunkSettings",
    "ContextSettings",
    "Policy",
    "Rule",
    "ScreenSettings",
    "TfidfSettings",
    "screen_chunks",
    "screen_documents",
    "screen_raw",
]
