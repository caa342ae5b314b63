"""Where rows come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions.contact import decoded_uri
from attestra.operators.layout import BLOCKS

LINKS = "doc_id long, page int, url string, x0 double, y0 double, x1 double, y1 double"


@dataclass(frozen=True)
class Limits:
    """Bounds on input; what is beyond them is marked, never read in part."""

    upload_mb: int = 15
    pages: int = 30
    chars: int = 300_000
    job_chars: int = 20_000
    candidate_chars: int = 100_000

    def __post_init__(self):
        if min(self.upload_mb, self.pages, self.chars, self.job_chars, self.candidate_chars) < 1:
            raise ValueError("limits are positive")


def pdf_files(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """``(path, length, content, error)``: PDF files with what is wrong with their bytes, null if nothing is."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "length", "content")
    return files.withColumn("error", byte_error(F.col("content"), F.col("path"), limits))


def byte_error(content: Column, name: Column, limits: Limits = Limits()) -> Column:
    """The first fault that bytes alone show; cheap, so it goes before any Python."""
    tail = F.substring(content, -2048, 2048)
    return (
        F.when(F.octet_length(content) > limits.upload_mb << 20, "too large")
        .when(~F.lower(name).endswith(".pdf"), "not a PDF name")
        .when(~F.decode(F.substring(content, 1, 8), "ISO-8859-1").rlike(r"^%PDF-\d\.\d"), "no PDF header")
        .when(~F.contains(F.decode(tail, "ISO-8859-1"), F.lit("%%EOF")), "no end mark")
    )


#: Readers that need a library this package does not bring; a caller may register them.
Hook = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_hooks: dict[str, Hook] = {}


def register_hook(name: str, f: Hook) -> None:
    """``name`` is pdf_lines, the only reader that is called; other names are refused, as nothing would read them."""
    if name != "pdf_lines":
        raise ValueError(f"no hook is called {name}")
    _hooks[name] = f


def through_hook(name: str, df: DataFrame, schema: str) -> DataFrame:
    """``df`` through a registered reader, batch by batch; no rows if none is registered."""
    if name not in _hooks:
        return df.sparkSession.createDataFrame([], schema)
    return df.mapInPandas(_hooks[name], schema)


def pdf_lines(files: DataFrame) -> DataFrame:
    """Positioned lines of sound files, by the registered reader."""
    return through_hook("pdf_lines", files.where("error is null").drop("error"), BLOCKS)


def links(raw: DataFrame) -> DataFrame:
    """Link annotations with decoded addresses; of one address in a document the first by page and place stays."""
    out = raw.withColumn("url", F.when(F.col("url").rlike(r"^[(<]"), decoded_uri(F.col("url"))).otherwise(F.col("url"))).where("url is not null")
    first = Window.partitionBy("doc_id", "url").orderBy("page", "y0", "x0", "y1", "x1")
    return out.withColumn("nth_", F.row_number().over(first)).where("nth_ = 1").drop("nth_")


def ruled_table(cells: Column) -> Column:
    """Rows padded to one width; null with fewer than two rows or columns, or more than 5000 cells."""
    width = F.array_max(F.transform(cells, lambda r: F.size(r)))
    padded = F.transform(cells, lambda r: F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), width - F.size(r))))
    return F.when((F.size(cells) >= 2) & (width >= 2) & (F.size(cells) * width <= 5000), padded)


#: What a request's candidate may hold; names of both input forms.
CANDIDATE = """summary string, skills variant, soft_skills array<string>, experience array<struct<position string, job_title string, start_date string, startDate string, end_date string, endDate string, current_position boolean, responsibilities variant>>,
work_experience array<struct<position string, job_title string, start_date string, startDate string, end_date string, endDate string, current_position boolean, responsibilities variant>>,
education array<struct<degree string, field_of_study string, fieldOfStudy string>>, certifications variant, projects array<struct<description string, technologies variant>>,
professional_profile struct<professional_summary variant>"""


def requests(raw: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Match requests from ``raw(pair_id, cv_json, job_description)`` with ``errors``; a bad row is marked and stays.

    Accepts both forms of a candidate: names of the record or of the dashboard, skills as a list or by
    category, credentials as text or struct, responsibilities as text or list.
    """
    cv = F.from_json("cv_json", CANDIDATE, {"mode": "PERMISSIVE"})
    x = raw.withColumn("c", cv).withColumn("v", F.try_parse_json("cv_json"))
    texts = lambda col, p: F.try_variant_get(col, p, "array<string>")
    named = lambda col: F.try_variant_get(col, "$", "array<struct<name string>>")
    none = F.array().cast("array<string>")
    groups = F.try_variant_get("v", "$.skills", "map<string, array<string>>")
    structs = F.try_variant_get("v", "$.skills", "map<string, array<struct<name string>>>")
    plain = F.coalesce(groups, F.transform_values(structs, lambda _, a: F.transform(a, lambda s: s["name"])))
    soft_keys = lambda k: k.isin("soft", "soft_skills")
    of = lambda keep: F.flatten(F.map_values(F.map_filter(plain, lambda k, _: keep(k))))
    skills = F.coalesce(texts("v", "$.skills"), of(lambda k: ~soft_keys(k)), none)
    soft = F.concat(F.coalesce("c.soft_skills", none), F.coalesce(of(soft_keys), none))
    as_list = lambda col: F.coalesce(F.try_variant_get(col, "$", "array<string>"), F.array_compact(F.array(F.try_variant_get(col, "$", "string"))), none)
    jobs = F.transform(F.coalesce("c.experience", "c.work_experience"), lambda j: F.struct(F.coalesce(j["position"], j["job_title"]).alias("position"), F.coalesce(j["start_date"], j["startDate"]).alias("start_date"), F.coalesce(j["end_date"], j["endDate"]).alias("end_date"), j["current_position"].alias("current_position"), as_list(j["responsibilities"]).alias("responsibilities")))
    studies = F.transform("c.education", lambda e: F.struct(e["degree"].alias("degree"), F.coalesce(e["field_of_study"], e["fieldOfStudy"]).alias("field_of_study")))
    creds = F.coalesce(F.transform(texts("v", "$.certifications"), lambda n: F.struct(n.alias("name"))), named("c.certifications"), F.transform(F.try_variant_get("c.certifications", "$", "array<struct<certificateName string>>"), lambda s: F.struct(s["certificateName"].alias("name"))))
    profile = F.coalesce(F.try_variant_get("v", "$.professional_profile.professional_summary.value", "string"), F.try_variant_get("v", "$.professional_profile.professional_summary", "string"))
    projects = F.flatten(F.transform("c.projects", lambda p: F.array(F.coalesce(p["description"], F.lit("")), F.array_join(as_list(p["technologies"]), ", "))))
    y = x.select(
        "pair_id", "job_description", F.coalesce("c.summary", profile, F.lit("")).alias("summary"), skills.alias("skills"), soft.alias("soft_skills"),
        F.coalesce(jobs, F.array().cast("array<struct<position:string,start_date:string,end_date:string,current_position:boolean,responsibilities:array<string>>>")).alias("experience"),
        F.coalesce(studies, F.array().cast("array<struct<degree:string,field_of_study:string>>")).alias("education"),
        F.coalesce(creds, F.array().cast("array<struct<name:string>>")).alias("certifications"),
        F.filter(F.coalesce(projects, none), lambda p: p != "").alias("project_text"), F.length("cv_json").alias("cv_chars"), F.col("v").isNull().alias("broken"),
    )
    evidence = (F.trim("summary") != "") | F.exists("skills", lambda s: F.trim(s) != "") | (F.size("experience") + F.size("education") + F.size("project_text") + F.size("soft_skills") + F.size("certifications") > 0)
    jd = F.coalesce("job_description", F.lit(""))
    errors = F.array_compact(F.array(F.when(F.col("broken"), "candidate is not an object"), F.when(~jd.rlike(r"[\p{L}\p{N}]"), "requirement has no words"), F.when(F.char_length(jd) > limits.job_chars, "requirement is too long"), F.when(F.col("cv_chars") > limits.candidate_chars, "candidate is too large"), F.when(~evidence, "candidate has no evidence")))
    return y.withColumn("errors", errors).drop("broken", "cv_chars")


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A labelled set in one JSON file with a digest of its bytes and ``errors`` for labels outside their band."""
    from attestra.functions.vocabulary import BANDS

    rows = spark.read.option("multiLine", True).json(path).select(F.explode("pairs").alias("p")).select("p.*")
    bands = F.create_map(*[x for k, (a, b) in BANDS.items() for x in (F.lit(k), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    band = bands[F.col("scenario_band")]
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    return rows.withColumn("errors", F.array_compact(F.array(F.when(~F.col("ai_expected_score").between(band["a"], band["b"]), "label outside its band")))).withColumn("sha256", F.lit(digest))
