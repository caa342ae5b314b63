"""Positioned lines to nested, evidence-carrying records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import contact, dates
from attestra.functions import vocabulary as v
from attestra.operators import entries, evaluate, layout, sections
from attestra.sources.export import blank, counts


def language_of(text: Column) -> Column:
    """``struct<primary, confidence>`` without a language model: `en` for Latin letters, else unknown; unknown below 15 letters."""
    t = F.coalesce(text, F.lit(""))
    letters = F.char_length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return F.when(letters < 15, F.struct(F.lit("und").alias("primary"), F.lit(0.0).alias("confidence"))).otherwise(F.struct(F.when(t.rlike("[A-Za-z]"), "en").otherwise("und").alias("primary"), F.lit(0.5).alias("confidence")))


def contacts(d: DataFrame) -> DataFrame:
    """``d`` with contact fields: from the text ``near``, addresses from ``body`` too, then from link annotations, ``noted``."""
    found = F.concat(contact.urls(F.col("near")), F.array_compact(F.transform(F.split("noted", "\n"), lambda u: contact.url(u))), contact.urls(F.col("body")))
    d = d.withColumn("addresses", found).withColumn("mails", contact.emails(F.concat_ws("\n", "near", "noted"))).withColumn("called", contact.phones(F.col("near")))
    d = d.withColumn("kinds", F.transform("addresses", lambda a: F.struct(contact.url_class(a).alias("kind"), a.alias("address"))))
    of = lambda kind: F.get(F.filter("kinds", lambda a: a["kind"] == kind), F.lit(0))["address"]
    return d.withColumns({
        "numbers": F.when(F.size("called") == 0, contact.phones(F.col("noted"))).otherwise(F.col("called")),
        "linkedin": of("linkedin"), "github": F.coalesce(of("github"), contact.github_user(F.col("near"))), "website": of("website"),
        "portfolio": contact.url(F.nullif(F.regexp_extract("near", r"(?imu)^\s*portfolio\s*:\s*(\S+)", 1), F.lit(""))),
        "labels": contact.personal_labels(F.col("near")),
    })


def unlabelled_location(header: Column) -> Column:
    """A header line of up to six words of letters right below one with an e-mail address; null if there is none."""

    def place(b: Column, i: Column) -> Column:
        good = F.get(header, i - 1)["text"].rlike(v.EMAIL) & b["text"].rlike(r"(?U)^[^\W\d_]+(?:[ ,'-]+[^\W\d_]+)*$") & (F.size(F.split(b["text"], r"(?U)\s+")) <= 6) & sections.exact_heading(b["text"]).isNull()
        return F.when((i > 0) & good, b["text"])

    return F.get(F.array_compact(F.transform(header, place)), F.lit(0))


def parse(blocks: DataFrame, links: DataFrame, as_of: Column, width: float = 612.0, ordered: bool = False, names: DataFrame | None = None, suggestions: DataFrame | None = None) -> DataFrame:
    """One nested record per document of ``blocks``.

    Null texts count as empty; a document without lines has no record; repeated lines are kept. The
    segmented lines meet once, by document, and every part of the record is an expression over them; a
    record is bounded by its document. ``names(doc_id, full_name, confidence)`` are what a recogniser says, taken where
    the header says nothing; ``suggestions`` as in ``sections.accepted_suggestions`` fill fields that are still null.
    """
    lines = sections.segment(blocks if ordered else layout.reading_order(blocks, width))
    readers = {
        "work_experience": ("work_experience", lambda x: entries.experience(x, as_of)), "education": ("education", entries.education), "certifications": ("certifications", entries.certifications),
        "projects": ("projects", entries.projects), "languages": ("languages", entries.languages), "section_text": ("skills", entries.merged_items), "found": ("header", entries.name_candidate), "place": ("header", unlabelled_location),
        "summary": ("professional_summary", lambda x: F.nullif(entries.joined_text(x), F.lit(""))), "summary_confidence": ("professional_summary", lambda x: F.array_min(F.transform(x, lambda b: b["confidence"]))),
    }
    every = F.lit(True)
    kept = sections.is_evidence()
    groups = {"near_lines": F.col("section").isin("header", "personal_information"), "body_lines": every, "kept_lines": kept}
    used = sorted({s for s, _ in readers.values()})
    per = lines.groupBy("doc_id").agg(*[entries.lines_of(F.col("section") == s).alias(f"in_{s}") for s in used], *[F.array_sort(F.collect_list(F.when(c, F.struct("seq", "part", "text")))).alias(n) for n, c in groups.items()])
    noted = links.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "y0", "x0", "url"))), lambda x: x["url"]), "\n").alias("noted"))
    out = per.join(noted, "doc_id", "left")
    out = out.select("doc_id", F.coalesce("noted", F.lit("")).alias("noted"), *[read(F.col(f"in_{s}")).alias(n) for n, (s, read) in readers.items()], entries.joined_text(F.col("near_lines")).alias("head"), entries.joined_text(F.col("body_lines")).alias("body"), entries.joined_text(F.col("kept_lines")).alias("evidence_text"))
    out = contacts(out.withColumn("near", F.when(F.col("head") == "", F.col("body")).otherwise(F.col("head"))))
    out = entries.skills(out, "evidence_text")
    name = F.coalesce(F.col("labels.full_name"), F.col("found.full_name"), F.nullif(F.concat_ws(" ", "labels.first_name", "labels.middle_name", "labels.last_name"), F.lit("")))
    sure = F.when(F.col("labels.full_name").isNotNull(), 0.9).otherwise(F.col("found.confidence"))
    out = out.withColumns({"name": name, "sure": sure, "email": F.get("mails", F.lit(0))})
    if names is not None:
        told = names.groupBy("doc_id").agg(F.max_by("full_name", "confidence").alias("told"), F.max("confidence").alias("told_sure"))
        out = out.join(told, "doc_id", "left").withColumns({"sure": F.when(F.col("name").isNull(), F.col("told_sure")).otherwise(F.col("sure")), "name": F.coalesce("name", "told")})
    if suggestions is not None:
        fields = {"full_name": "name", "email": "email", "professional_summary": "summary"}
        good = sections.accepted_suggestions(suggestions, lines).groupBy("doc_id").agg(*[F.min(F.when(F.col("field") == f, F.col("value"))).alias(f"new_{c}") for f, c in fields.items()])
        out = out.join(good, "doc_id", "left").withColumns({c: F.coalesce(c, f"new_{c}") for c in fields.values()})
    split = contact.name_parts(F.col("name"))
    score = F.array(F.col("sure"), F.when(F.col("email").isNotNull(), 0.95), F.when(F.col("summary").isNotNull(), F.least(F.lit(0.8), F.col("summary_confidence"))))
    more = F.concat(F.transform("work_experience", lambda e: e["confidence"]), F.transform("education", lambda e: e["confidence"]))
    missing = F.array(*[F.when(c, F.lit(n)) for n, c in (("personal_information.full_name", F.col("name").isNull()), ("personal_information.email", F.col("email").isNull()), ("professional_profile.professional_summary", F.col("summary").isNull()), ("work_experience", F.size("work_experience") == 0), ("education", F.size("education") == 0))])
    return out.select(
        "doc_id",
        F.struct(F.col("name").alias("full_name"), F.coalesce("labels.first_name", split["first"]).alias("first_name"), F.coalesce("labels.middle_name", split["middle"]).alias("middle_name"), F.coalesce("labels.last_name", split["last"]).alias("last_name"), "email", F.get("numbers", F.lit(0)).alias("phone"), F.get("numbers", F.lit(1)).alias("alternative_phone"), "linkedin", "github", "website", "portfolio", F.col("labels.date_of_birth").alias("date_of_birth"), contact.stated_gender(F.col("labels.gender")).alias("stated_gender"), F.col("labels.nationality").alias("nationality"), F.col("labels.marital_status").alias("marital_status"), F.coalesce("labels.location", "place").alias("location")).alias("personal_information"),
        "summary", "work_experience", "education", "certifications", "projects", "languages",
        F.col("known").alias("skills"), F.col("other").alias("other_skills"),
        language_of(F.col("body")).alias("document_language"),
        counts(F.col("body"), contact.emails(F.col("near")), F.col("called")).alias("counts"),
        evaluate.quality(F.concat(score, more), missing, F.array().cast("array<string>")).alias("quality"),
    )


def dashboard(records: DataFrame, as_of: Column) -> DataFrame:
    """Records as a flat view of texts: nothing is null, lists are joined."""
    p = lambda c: blank(F.col(f"personal_information.{c}"))
    known = F.col("skills")
    return records.select(
        "doc_id",
        F.struct(p("full_name").alias("fullName"), p("first_name").alias("firstName"), p("last_name").alias("lastName"), p("middle_name").alias("middleName"), p("date_of_birth").alias("dateOfBirth"), p("stated_gender").alias("gender"), p("nationality").alias("nationality"), p("marital_status").alias("maritalStatus"), p("location").alias("address")).alias("personalInformation"),
        F.struct(p("email").alias("email"), p("phone").alias("mobilePhone"), p("alternative_phone").alias("alternativePhone"), p("linkedin").alias("linkedIn"), p("github").alias("gitHub"), F.coalesce("personal_information.portfolio", "personal_information.website", F.lit("")).alias("portfolio")).alias("contactInformation"),
        F.transform("work_experience", lambda e: F.struct(blank(e["company"]).alias("company"), blank(e["job_title"]).alias("position"), blank(e["start_date"]).alias("startDate"), F.when(e["current_position"], "Present").otherwise(blank(e["end_date"])).alias("endDate"), dates.duration(e["start_date"], e["end_date"], e["current_position"], as_of).alias("duration"), F.array_join(e["responsibilities"], "\n").alias("responsibilities"))).alias("experience"),
        F.transform("education", lambda e: F.struct(blank(e["institution"]).alias("university"), blank(e["degree"]).alias("degree"), blank(e["field_of_study"]).alias("fieldOfStudy"), dates.duration(e["start_date"], e["end_date"], F.lit(False), as_of).alias("duration"), blank(e["gpa"]).alias("gpa"))).alias("education"),
        F.struct(F.array_distinct(F.concat(F.transform(F.filter(known, lambda k: k["category"] != "soft_skills"), lambda k: k["name"]), "other_skills")).alias("technical"), F.array_distinct(F.transform(F.filter(known, lambda k: k["category"] == "soft_skills"), lambda k: k["name"])).alias("soft")).alias("skills"),
        F.transform("languages", lambda x: F.struct(x["language"].alias("language"), F.coalesce(x["proficiency"], x["cefr_level"], F.lit("")).alias("level"))).alias("languages"),
        F.transform("certifications", lambda x: F.struct(blank(x["certification_name"]).alias("certificateName"), blank(x["issuer"]).alias("issuingOrganization"), blank(x["issue_date"]).alias("issueDate"), blank(x["credential_id"]).alias("credentialID"))).alias("certifications"),
        F.transform("projects", lambda x: F.struct(blank(x["project_name"]).alias("projectName"), blank(x["description"]).alias("description"), F.array_join(x["technologies"], ", ").alias("technologies"), blank(x["role"]).alias("role"))).alias("projects"),
        blank(F.col("summary")).alias("summary"),
        F.struct(F.col("counts.words").alias("words"), F.col("counts.emails").alias("emails"), F.col("counts.phones").alias("phones"), F.col("document_language.primary").alias("documentLanguage")).alias("metadata"),
    )
