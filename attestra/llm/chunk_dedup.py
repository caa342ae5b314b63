"""Exact de-duplication by content-defined chunk recipes.

Each text is cut at places that its own content defines. Equal chunks get one identifier, verified by
comparing bytes; a text then is its recipe, the ordered list of identifiers, and only recipes are
compared and grouped. A long document's bytes move at most once, and copies of a chunk meet in
map-side aggregation first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import ascii_lower, written

#: Least and largest characters of a chunk. A chunk ends after the first white space past the least
#: size that follows one of CUT_AFTER, or at the largest size.
MIN_CHUNK, MAX_CHUNK = 1024, 16384
CUT_AFTER = ".,;:!?aeon"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of ``text`` in order; they concatenate to it. An empty text has none.

    Where a cut falls depends on the characters before it only, so equal texts have equal chunks.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?<=[{CUT_AFTER}]\s)|.{{1,{most}}}"), F.lit(0))


def recipes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", normalise=ascii_lower) -> DataFrame:
    """``(id, parts: array<struct<digest, chunk>>, text_sha256)`` for each row; null text counts as empty."""
    norm = normalise(F.coalesce(F.col(text), F.lit("")))
    one = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    return one.select("id", chunks(F.col("norm")).alias("chunks"), F.sha2("norm", 256).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", normalise=ascii_lower) -> DataFrame:
    """One row per row of ``docs``: ``(<id>, keep_id, group_size, kept, text_sha256, n_chunks)``.

    Texts are equal when identical after ``normalise`` (lower-casing A-Z). Of equal texts the row with
    the largest id stays; a null id loses to any other; of repeated rows with the same id and text all
    have that id as keep_id and all are kept. Null text counts as empty; empty texts are equal. An
    empty table gives an empty result. Other columns of ``docs`` are not read.

    Each task cuts its texts and sends, for each distinct chunk that it saw, the digest and the bytes
    once; the least and greatest bytes of a digest are compared there. A digest with two contents is
    not an identifier: texts that hold such a chunk are grouped by their whole text instead.
    """
    made = recipes(docs, text, id_col, normalise)
    digest = F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256)))
    lists = written(made.select("id", digest.alias("recipe"), "text_sha256"), "recipes")
    each = made.select(F.explode("chunks").alias("chunk")).select(F.unhex(F.sha2("chunk", 256)).alias("digest"), "chunk")
    clash = written(each.groupBy("digest").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low <> high").select("digest"), "clashes")
    if clash.limit(1).count():
        # never seen for SHA-256; the recipe of such a text is followed by the text itself
        bad = made.select("id", "text_sha256", F.explode("chunks").alias("chunk"), F.concat_ws("", "chunks").alias("whole")).withColumn("digest", F.unhex(F.sha2("chunk", 256)))
        bad = bad.join(clash, "digest", "left_semi").groupBy("id", "text_sha256").agg(F.array(F.encode(F.min("whole"), "UTF-8")).alias("more"))
        lists = written(lists.join(bad, ["id", "text_sha256"], "left").select("id", F.concat("recipe", F.coalesce("more", F.array().cast("array<binary>"))).alias("recipe"), "text_sha256"), "recipes")
    # the list itself is compared, not a digest of it
    groups = lists.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # written, so that the join has plain exchanges on both sides and a hot recipe can be split
    many = written(groups.where("group_size > 1"), "copies")
    out = lists.join(many, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )
