"""Stateless scoring of arriving text; no lateness or state semantics are defined for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import contact, text
from attestra.plans import match


def evidence_stream(texts: DataFrame) -> DataFrame:
    """``(doc_id, text, changed, emails, urls)`` of a stream or table of ``(doc_id, text)``, row by row."""
    c = texts.select("doc_id", text.clean(F.col("text")).alias("c"), F.col("text").alias("t"))
    return c.select("doc_id", text.positive(F.col("c.text")).alias("text"), F.col("c.changed").alias("changed"), contact.emails(F.col("t")).alias("emails"), contact.urls(F.col("t")).alias("urls"))


def match_stream(candidates: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Each arriving candidate against a fixed table of requirements."""
    return match.match(candidates, jobs, as_of)
