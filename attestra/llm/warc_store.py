"""A content-addressed archive of WARC records.

Payload bytes are stored once under a strong digest; record headers are kept apart, byte for byte;
the records are put together again by a join. All of it is DataFrames over two Parquet tables in a
store that driver and executors share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import scratch_dir, small, written

#: The base-32 alphabet and the profile that WARC/1.1 names for equal payloads.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URN = "urn:x-page"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests that several rows have, of some 130 bytes, up to which they are broadcast.
BROADCAST_DIGESTS = 100_000
#: Payloads of at least so many bytes are stored once.
MIN_BYTES = 0


def base32(hexed: Column) -> Column:
    """Upper-case base-32 of a hex string whose length is a multiple of 5 digits (SHA-1 has 40)."""
    letters = F.array(*[F.lit(c) for c in BASE32])

    def four(i: Column) -> Column:
        v = F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.element_at(letters, F.shiftright(v, s).bitwiseAND(31) + 1) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(hexed) / 5).cast("int") - 1), four), "")


def _urn(page: Column) -> Column:
    """A name for any id, none the same as another's; what would end it or the line is percent-encoded. A null id has a name of its own."""
    said = page.cast("string")
    for sign in "%>\r\n":
        said = F.replace(said, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return F.coalesce(F.concat(F.lit(URN), F.lit(":"), said), F.lit(URN))


def _named(urn: Column) -> Column:
    """The id, as a string, that a name was made of."""
    said = F.when(F.startswith(urn, F.lit(f"{URN}:")), F.substring(urn, len(URN) + 2, 2147483647))
    for sign in "\n\r>%":
        said = F.replace(said, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return said


def _header(page: Column, uri: Column, digest: Column, size: Column, refers_to: Column, revisit: Column) -> Column:
    """The record's header, exact to the byte. A null uri has no line; control characters in one are percent-encoded, so they end no line."""
    clean = F.regexp_replace(F.regexp_replace(uri, "\r", "%0D"), "\n", "%0A")
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <"), _urn(page), F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), _urn(refers_to), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/octet-stream"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(size).cast("string")),
    )
    return F.encode(F.concat(lines, F.lit("\r\n\r\n")), "UTF-8")


@dataclass(frozen=True)
class Archive:
    """Two tables under ``path``: records(id, header, digest) and payloads(digest, owner, payload)."""

    path: str

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/records")

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/payloads")


def write_archive(pages: DataFrame, path: str | None = None, url: str = "url", body: str = "html", id_col: str = "page_id", min_bytes: int = MIN_BYTES) -> Archive:
    """One record per row of ``pages``; the payload is the body in UTF-8, a null one is empty.

    Of records with equal payloads of at least ``min_bytes``, that with the largest id is a response,
    the others revisit it; smaller ones are all responses. Rows that repeat both id and payload are all
    responses; a null id is the smallest. Ids may be numbers or strings. Payloads are equal if SHA-256,
    SHA-1 and length agree. Bodies of any length are kept whole; an empty table gives an empty archive.
    Other columns are not read, whatever their names.

    Bodies move once, to meet the ids that own a payload; digests are made in the scan, and the
    grouping by digest sees a digest once per task. The owners of digests that several rows have are
    written, and are sent to all tasks if a count shows that they are few; else both sides of the join
    are plain, so that Spark can split a digest that is a third of all rows.
    """
    spark = pages.sparkSession
    path = path or scratch_dir(spark, "warc")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("uri"), F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8").alias("payload"))
    sized = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    key = F.when(F.col("size") >= min_bytes, F.concat_ws("-", F.sha2("payload", 256), "sha1", "size")).otherwise(F.concat_ws("-", F.sha2("payload", 256), "sha1", "size", F.coalesce(F.concat(F.lit("id"), F.col("id").cast("string")), F.lit("none"))))
    keyed = sized.withColumn("digest", key)
    narrow = keyed.select("id", "uri", "size", "sha1", "digest")
    owners = written(narrow.groupBy("digest").agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("rows")), "owners")
    shared = owners.where("rows > 1").select("digest", "owner", F.lit(True).alias("shared"))
    owner = F.when(F.col("shared"), F.col("owner")).otherwise(F.col("id"))
    with_owner = narrow.join(small(shared, BROADCAST_DIGESTS), "digest", "left").withColumn("owner", owner).withColumn("revisit", ~F.col("id").eqNullSafe(F.col("owner")))
    header = _header(F.col("id"), F.col("uri"), base32(F.col("sha1")), F.col("size"), F.col("owner"), F.col("revisit"))
    with_owner.select("id", header.alias("header"), "digest").write.parquet(f"{path}/records")
    # one key column for id and digest, so that the rows that the join has put together need not move again
    at = lambda i, d: F.concat_ws("#", d, F.when(i.isNull(), F.lit("none")).otherwise(F.concat(F.lit("id"), i.cast("string"))))
    mine = owners.select(at(F.col("owner"), F.col("digest")).alias("at"), "owner")
    stored = keyed.select(at(F.col("id"), F.col("digest")).alias("at"), "digest", "payload").join(mine, "at")
    stored.dropDuplicates(["at"]).select("digest", "owner", "payload").write.parquet(f"{path}/payloads")
    return Archive(path)


def read_headers(archive: Archive, spark: SparkSession) -> DataFrame:
    """``(id, header, digest, record_type, refers_to, stated_sha1)``, the last three parsed from the header bytes."""
    rec = archive.records(spark)
    text = F.decode("header", "UTF-8")
    line = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ?([^\r\n]*)\r\n", 1), F.lit(""))
    refers = _named(F.regexp_extract(F.coalesce(line("WARC-Refers-To"), F.lit("")), r"^<([^>]*)>$", 1))
    return rec.select("id", "header", "digest", line("WARC-Type").alias("record_type"), refers.cast(rec.schema["id"].dataType).alias("refers_to"), F.replace(line("WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")).alias("stated_sha1"))


def reconstruct(archive: Archive, spark: SparkSession, with_payload: bool = True) -> DataFrame:
    """``(id, header, record_type, refers_to, payload_bytes, payload_digest, intact[, payload])`` per record.

    Length and digest are made from the stored bytes, and ``intact`` says that they agree with the
    store's key and the header. Without payload the join moves only what was made of it.
    """
    # each digest is made once, below the expressions that use it several times
    held = archive.payloads(spark).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"), *["payload"] * with_payload)
    kept = held.select("digest", "payload_bytes", base32(F.col("sha1")).alias("payload_digest"), "sha256", *["payload"] * with_payload)
    heads = read_headers(archive, spark)
    out = heads.join(kept, "digest")
    intact = F.startswith("digest", "sha256") & (F.col("stated_sha1") == F.col("payload_digest"))
    return out.select("id", "header", "record_type", "refers_to", "payload_bytes", "payload_digest", intact.alias("intact"), *["payload"] * with_payload)


def record_bytes(records: DataFrame) -> DataFrame:
    """``(id, record binary)``: whole records as a WARC file holds them; a revisit carries no payload."""
    body = F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return records.select("id", F.concat("header", body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))
