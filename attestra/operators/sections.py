"""Headings, segmentation, provenance."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from attestra.functions import vocabulary as v
from attestra.functions.text import ANY_CASE, LINE_END, lookup, strip

#: Pieces of text up to which ``containing`` broadcasts them.
BROADCAST_PIECES = 20_000
_EXACT = {word: section for section, words in reversed(v.SECTIONS.items()) for word in words} | {"haqqimda": "professional_summary"}


def _shared(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _near(a: str, b: str) -> bool:
    """Whether lengths and letters alone leave it open that two words share nine tenths."""
    least = 0.45 * (len(a) + len(b))
    return min(len(a), len(b)) >= least and (Counter(a) & Counter(b)).total() >= least


@functools.lru_cache(maxsize=100_000)
def heading(text: str | None) -> tuple[str | None, float]:
    """The section that a line is the heading of, and how surely: 1 for a listed heading, from 0.9 for one nearly spelled so."""
    t = unicodedata.normalize("NFKC", text or "").casefold().replace("i̇", "i").strip().rstrip(":：").strip()
    words = len(t.split())
    if not t or len(t) > 48 or words > 5 or re.search(r"[.!?;,]", t):
        return None, 0.0
    if t in _EXACT:
        return _EXACT[t], 1.0
    if not any(c.isalpha() for c in t):
        return None, 0.0
    best = max(((2 * _shared(t, w) / (len(t) + len(w)), s) for s, ws in v.SECTIONS.items() for w in ws if len(w.split()) == words and min(len(t), len(w)) >= 5 and _near(t, w)), default=(0.0, ""))
    return (best[1], round(best[0], 2)) if best[0] >= 0.9 else (None, 0.0)


@pandas_udf(StructType([StructField("section", StringType()), StructField("score", DoubleType())]))
def heading_of(text: pd.Series) -> pd.DataFrame:
    seen = {t: heading(t) for t in text.unique()}
    return pd.DataFrame([seen[t] for t in text], columns=["section", "score"])


def exact_heading(text: Column) -> Column:
    """The listed headings only, without Python."""
    return F.try_element_at(lookup(_EXACT), strip(F.regexp_replace(strip(F.replace(F.lower(text), F.lit("i̇"), F.lit("i"))), "[:：]+$", "")))


def segment(blocks: DataFrame) -> DataFrame:
    """Lines with their section: ``blocks`` split at line ends, with ``part`` and ``section``; headings themselves go.

    A heading holds until the next one; before the first it is `header`. A heading is a listed one, or
    one nearly so that is bold or of 12 points. What follows its colon belongs to it. Under a heading
    for education with certifications, the first line that names a credential and no degree starts the
    certifications.
    """
    parts = blocks.select("*", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_END)).alias("part", "piece")).withColumn("piece", strip(F.col("piece"))).where("piece <> ''")
    label = F.regexp_extract("piece", r"(?s)^([^:]*)", 1)
    content = strip(F.regexp_extract("piece", r"(?s)^[^:]*:(.*)$", 1))
    named = parts.withColumn("h", heading_of(label)).withColumn("is_head", F.col("h.section").isNotNull() & ((F.col("h.score") == 1) | F.coalesce("is_bold", F.lit(False)) | (F.coalesce("font_size", F.lit(0.0)) >= 12)))
    w = Window.partitionBy("doc_id").orderBy("seq", "part")
    marked = named.withColumn("section", F.coalesce(F.last(F.when(F.col("is_head"), F.col("h.section")), True).over(w), F.lit("header")))
    marked = marked.withColumn("run", F.sum(F.col("is_head").cast("int")).over(w))
    both = F.last(F.when(F.col("is_head"), (F.col("h.section") == "education") & label.rlike(ANY_CASE + "certifications")), True).over(w)
    moved = F.col("piece").rlike(ANY_CASE + v.CREDENTIAL_LINE) & ~F.col("piece").rlike(ANY_CASE + v.DEGREE_LINE) & ~F.col("is_head") & F.coalesce(both, F.lit(False))
    marked = marked.withColumn("moved", moved)
    rerouted = F.max(F.col("moved").cast("int")).over(Window.partitionBy("doc_id", "run").orderBy("seq", "part"))
    text = F.when(F.col("is_head"), content).otherwise(F.col("piece"))
    out = marked.withColumn("section", F.when(rerouted == 1, "certifications").otherwise(F.col("section"))).withColumn("text", text).where("text <> ''")
    return out.drop("piece", "h", "is_head", "run", "moved")


def is_evidence() -> Column:
    """Whether a line's section says something of the candidate: references and interests don't."""
    return ~F.col("section").isin("references", "interests")


def evidence_sections(blocks: DataFrame) -> DataFrame:
    return blocks.where(is_evidence())


def provenance(values: DataFrame, blocks: DataFrame) -> DataFrame:
    """``values(doc_id, value, given)`` with the first line that holds the value in any case: ``(.., page, source_text, confidence)``.

    A value that no line holds has no provenance and goes.
    """
    b = blocks.select("doc_id", "page", "seq", F.col("text").alias("source_text"), F.col("confidence").alias("sure"))
    hit = values.join(b, "doc_id").where(F.contains(F.lower("source_text"), F.lower("value")) & (F.col("value") != ""))
    first = F.min_by(F.struct("page", "source_text", "sure"), F.struct("page", "seq"))
    found = hit.groupBy("doc_id", "value", "given").agg(first.alias("p"))
    return found.select("doc_id", "value", F.col("p.page").alias("page"), F.col("p.source_text").alias("source_text"), F.least("given", "p.sure").alias("confidence"))


def accepted_suggestions(suggestions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Of ``suggestions(doc_id, field, value, page, quote)`` those whose quote stands on that page and holds the value: a semi-join."""
    s = suggestions.where(F.col("field").isin("full_name", "email", "professional_summary") & (strip(F.col("value")) != "") & (strip(F.col("quote")) != "") & F.contains("quote", "value"))
    s = s.where((F.col("field") != "email") | F.col("value").rlike("^" + v.EMAIL + "$"))
    b = blocks.select(F.col("doc_id").alias("b_doc"), F.col("page").alias("b_page"), F.col("text").alias("b_text"))
    return s.join(b, (F.col("doc_id") == F.col("b_doc")) & (F.col("page") == F.col("b_page")) & F.contains("b_text", "quote"), "left_semi")


def containing(texts: DataFrame, text_key: str, pieces: DataFrame, piece_key: str, text: str = "text", piece: str = "text") -> DataFrame:
    """``(<piece_key>, <text_key>)``: every text that holds a piece as it stands, in any case.

    The second to fourth word of a piece stand whole, and next to each other, in any text that holds the
    piece, so pieces of five words or more meet texts in an equi-join on these, and only such pairs are
    compared. Shorter pieces are looked for in every text, as a query set that a count bounds for the
    broadcast. Null and empty pieces are in no text; rows that repeat a key meet as often.
    """
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    p = pieces.select(F.col(piece_key).alias("p_key"), F.lower(F.col(piece)).alias("p_text")).where("p_text <> ''")
    t = texts.select(F.col(text_key).alias("t_key"), F.lower(F.col(text)).alias("t_text")).where("t_text is not null")
    p = p.withColumn("w", words(F.col("p_text")))
    print_of = lambda a, at: F.xxhash64(*[F.get(a, at + i) for i in range(3)])
    long = p.where(F.size("w") >= 5).select("p_key", "p_text", print_of(F.col("w"), F.lit(1)).alias("mark"))
    short = p.where(F.size("w") < 5).select("p_key", "p_text")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_PIECES else df
    w = t.select("t_key", "t_text", words(F.col("t_text")).alias("w"))
    marks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: print_of(F.col("w"), i)))
    met = w.select("t_key", "t_text", F.explode(marks).alias("mark")).join(few(long), "mark").where(F.contains("t_text", "p_text"))
    scanned = t.join(few(short), F.contains("t_text", "p_text"))
    return met.select("p_key", "t_key").unionByName(scanned.select("p_key", "t_key")).select(F.col("p_key").alias(piece_key), F.col("t_key").alias(text_key))
