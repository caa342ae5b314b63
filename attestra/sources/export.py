"""Where results go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from attestra.functions.text import strip


def flat(df: DataFrame, key: str) -> DataFrame:
    """``(<key>, path, value)``: every leaf of every column under a dotted path; list places are numbers; a null leaf is empty."""

    def leaves(col: Column, kind: DataType, path: Column) -> Column:
        if isinstance(kind, StructType):
            return F.concat(*[leaves(col[f.name], f.dataType, F.concat_ws(".", path, F.lit(f.name))) for f in kind.fields])
        if isinstance(kind, ArrayType):
            return F.coalesce(F.flatten(F.transform(col, lambda x, i: leaves(x, kind.elementType, F.concat(path, F.lit("."), i.cast("string"))))), F.array().cast("array<struct<path:string,value:string>>"))
        return F.array(F.struct(path.alias("path"), F.coalesce(col.cast("string"), F.lit("")).alias("value")))

    every = F.concat(*[leaves(F.col(f.name), f.dataType, F.lit(f.name)) for f in df.schema.fields if f.name != key])
    return df.select(key, F.inline(every))


def safe_cell(value: Column) -> Column:
    """A value that a spreadsheet takes as text: one that starts like a formula gets an apostrophe."""
    return F.when(value.rlike(r"^\s*[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def write_csv(df: DataFrame, key: str, path: str) -> None:
    flat(df, key).withColumn("value", safe_cell(F.col("value"))).write.option("header", True).option("quoteAll", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def text_report(df: DataFrame, key: str) -> DataFrame:
    """``(<key>, value)``: one text of `path: value` lines."""
    lines = flat(df, key).where("value <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("l"))
    return lines.select(key, F.array_join(F.transform("l", lambda x: F.concat(x["path"], F.lit(": "), x["value"])), "\n").alias("value"))


def blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def counts(all_text: Column, emails: Column, phones: Column) -> Column:
    """``struct<words, emails, phones>`` of a record: words, distinct addresses, distinct numbers."""
    return F.struct(F.size(F.array_remove(F.split(strip(all_text), r"(?U)\s+"), "")).alias("words"), F.size(F.array_distinct(emails)).alias("emails"), F.size(F.array_distinct(phones)).alias("phones"))
