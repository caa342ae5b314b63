"""Candidates against requirement texts: explainable scores for every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text
from attestra.functions import vocabulary as v
from attestra.operators import matching as m
from attestra.operators.lexical import BROADCAST_ROWS, row_similarity

#: Scores of pairs without a matched skill stay at or below this.
UNMATCHED = 9.0


def prepared_candidates(candidates: DataFrame) -> DataFrame:
    """What depends on a candidate alone, once each; other columns go."""
    none = F.array().cast("array<string>")
    made = m.candidate_columns(F.coalesce("skills", none), F.col("summary"), F.coalesce("soft_skills", none), F.col("experience"), F.col("education"), F.col("certifications"), F.coalesce("project_text", none))
    some = candidates.select("cv_id", *[c.alias(n) for n, c in made.items()])
    soft = text.evidence(F.array_join(F.concat(F.array("cv_text"), "soft_list"), "\n"))
    own = F.transform("own_skills", text.canonical)
    return some.select(
        "cv_id", "own_skills", "sanitised", "cv_text", "history", "degree", "summary_evidence",
        F.array_sort(F.array_distinct(F.concat(text.skills_in(F.col("cv_text"), F.col("own_skills")), own))).alias("cv_skills"),
        text.recognised(soft, {s: s for s in v.SOFT}).alias("cv_soft"),
        text.recognised(F.col("cv_text"), v.DOMAINS).alias("cv_domains"),
        text.recognised(F.col("academic"), v.FIELDS).alias("cv_fields"),
        text.recognised(F.col("credential_text"), v.CERTIFICATES).alias("cv_certificates"),
    )


def prepared_requirements(jobs: DataFrame) -> DataFrame:
    """What depends on a requirement text alone, once each."""
    made = m.requirement_columns(F.col("clean"))
    some = jobs.select("jd_id", text.clean(F.col("description"))["text"].alias("clean")).select("jd_id", *[c.alias(n) for n, c in made.items()])
    jd = F.col("jd_text")
    return some.select(
        "jd_id", "jd_clean", "jd_text", "forbidden",
        text.skills_in(jd).alias("jd_skills"), text.contextual(jd).alias("jd_context"),
        text.required_years(jd).alias("needed_years"), text.degree_level(jd, requirement=True).alias("needed_degree"),
        text.recognised(jd, {s: s for s in v.SOFT}).alias("jd_soft"), text.recognised(jd, v.DOMAINS).alias("jd_domains"),
        text.recognised(jd, v.FIELDS).alias("jd_fields"), text.recognised(jd, v.CERTIFICATES).alias("jd_certificates"),
        text.recognised(jd, v.ROLE_FAMILIES).alias("jd_families"), jd.rlike(text.ANY_CASE + v.SOFTWARE_TRIGGER).alias("jd_software"), jd.rlike(text.ANY_CASE + v.TITLE_WORDS).alias("jd_titles"),
    )


def paired(candidates: DataFrame, jobs: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """The rows to score: the given ``pairs(cv_id, jd_id)``, or every candidate with every requirement.

    All pairs are asked for then; the requirements are the small side and are sent to all tasks if a
    count shows that they fit, else Spark plans the product.
    """
    if pairs is not None:
        return pairs.select("cv_id", "jd_id").join(candidates, "cv_id").join(jobs, "jd_id")
    return candidates.crossJoin(F.broadcast(jobs) if jobs.count() <= BROADCAST_ROWS // 20 else jobs)


def blocked_pairs(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """``(cv_id, jd_id)`` of prepared rows that share a skill: all pairs that can score above UNMATCHED.

    A requirement's skills may come from the candidate's own list, so these are looked up in the text.
    """
    a = candidates.select("cv_id", F.explode("cv_skills").alias("skill"))
    b = jobs.select("jd_id", F.explode("jd_skills").alias("skill"))
    known = a.join(b, "skill").select("cv_id", "jd_id")
    own = candidates.select(F.explode(F.transform("own_skills", text.canonical)).alias("skill")).distinct()
    texts = jobs.select("jd_id", text.fold(F.col("jd_text")).alias("t"))
    said = own.join(texts, F.contains("t", "skill") & text.holds(F.col("t"), F.col("skill"))).select("jd_id", "skill")
    return known.unionByName(a.join(said, "skill").select("cv_id", "jd_id")).distinct()


def score(rows: DataFrame, as_of: Column, similarity=row_similarity) -> DataFrame:
    """One row per pair with 12 leaf scores, 4 parents, weights, guards, verdict and texts.

    ``similarity(a, b)`` gives 0 to 1 for two texts of a row; another backend may take its place.
    """
    s = rows.withColumn("required", F.array_sort(F.array_except(F.array_distinct(F.concat("jd_skills", F.filter(F.array_except(F.transform("own_skills", text.canonical), text.one_of(v.SOFT)), lambda x: text.holds(text.fold(F.col("jd_text")), x)))), "forbidden")))
    tools = text.one_of(v.TOOLS)
    s = s.withColumns({
        "matched": m.matched(F.col("required"), F.col("cv_skills")), "missing": m.missing(F.col("required"), F.col("cv_skills")), "violations": F.array_sort(F.array_intersect("cv_skills", "forbidden")),
        "hard": F.array_except("required", tools), "tool": F.array_intersect("required", tools),
        "past": F.filter("history", lambda j: F.coalesce(m.related(j, F.col("jd_families"), F.col("jd_software"), F.col("jd_domains")), F.lit(False))),
        "conflict": text.conflicting(F.col("cv_text"), F.col("jd_clean")),
    })
    s = s.withColumn("spans", m.worked_spans(F.col("past"), as_of)).withColumn("duties", text.evidence(F.array_join(F.transform("past", lambda j: j["raw"]), "\n")))
    years, recent = m.years_and_recency(F.col("spans"), as_of)
    s = s.withColumn("years", years).withColumn("recent", recent)
    s = s.withColumns({n: F.when(text.strip(F.col(c)) == "", 0.0).otherwise(F.round(100 * similarity(F.col(c), F.col("jd_context")), 2)) for n, c in (("sim_duties", "duties"), ("sim_summary", "summary_evidence"))})
    cover = lambda a, b: text.coverage(F.col(a), F.col(b))
    some = lambda c: F.size(c) > 0
    dated, titled = F.col("needed_years").isNotNull(), some("jd_families") | F.col("jd_titles")
    value = {
        "hard_skills_match": cover("cv_skills", "hard"), "tools_and_frameworks_match": cover("cv_skills", "tool"), "soft_skills_match": cover("cv_soft", "jd_soft"),
        "domain_relevance": cover("cv_domains", "jd_domains"), "responsibilities_match": F.col("sim_duties"), "summary_alignment": F.col("sim_summary"),
        "years_of_experience_fit": F.round(F.least(F.lit(100.0), 100 * F.col("years") / F.col("needed_years")), 2), "title_seniority_match": m.title_fit(F.col("past"), F.col("jd_text")), "recency_factor": F.col("recent"),
        "degree_level_fit": F.when(F.coalesce(F.col("degree.level"), F.lit(0)) >= F.col("needed_degree.level"), 100.0).otherwise(0.0), "field_of_study_relevance": cover("cv_fields", "jd_fields"), "certifications_match": cover("cv_certificates", "jd_certificates"),
    }
    active = {
        "hard_skills_match": some("hard"), "tools_and_frameworks_match": some("tool"), "soft_skills_match": some("jd_soft"),
        "domain_relevance": some("jd_domains"), "responsibilities_match": F.lit(True), "summary_alignment": F.lit(True),
        "years_of_experience_fit": dated, "title_seniority_match": titled, "recency_factor": dated | titled,
        "degree_level_fit": F.col("needed_degree").isNotNull(), "field_of_study_relevance": some("jd_fields"), "certifications_match": some("jd_certificates"),
    }
    s = s.withColumns({f"on_{k}": c for k, c in active.items()}).withColumns({k: F.when(c, value[k]).otherwise(0.0) for k, c in active.items()})
    on = {k: F.col(f"on_{k}") for k in active}
    weight, parent = {}, {}
    for group, leaves in v.WEIGHTS.items():
        w = m.normalised_weights(leaves, {k: on[k] for k in leaves})
        weight |= {f"w_{k}": c for k, c in w.items()}
        parent[f"{group}_score"] = m.roll_up({k: F.col(k) for k in leaves}, w)
    any_on = {g: F.greatest(*[on[k] for k in leaves]) for g, leaves in v.WEIGHTS.items()}
    overall = m.normalised_weights(v.OVERALL, any_on)
    s = s.withColumns(weight).withColumns(parent).withColumns({f"w_{g}": c for g, c in overall.items()})
    s = s.withColumn("raw_score", m.roll_up({g: F.col(f"{g}_score") for g in v.OVERALL}, {g: F.col(f"w_{g}") for g in v.OVERALL}))
    s = s.withColumn("score", m.guarded(F.col("raw_score"), some("violations"), F.col("conflict"), some("matched"), F.col("context_score")))
    s = s.withColumn("needs_review", m.needs_review(F.col("raw_score"), F.col("forbidden"), F.col("conflict"), F.col("jd_clean"), (F.col("duties") != "") | (F.col("summary_evidence") != "")))
    named = lambda c: F.transform(c, text.display)
    met = F.col("years_of_experience_fit") >= 100
    adjust = F.when(some("violations"), F.concat(F.lit("Hard exclusion violated: "), F.array_join(named("violations"), ", "))).when(F.col("conflict"), F.lit("Explicit acronym domain conflict: compatibility capped below 10%.")).when(~some("matched"), F.lit("No documented required hard-skill overlap: unrelated experience and education cannot establish compatibility."))
    advice = F.array_compact(F.array(
        adjust,
        F.when(some("missing"), F.concat(F.lit("Missing documented skills: "), F.array_join(named("missing"), ", "), F.lit("."))),
        F.when(dated, F.concat(F.format_string("Documented relevant experience: %.2f years; required: ", F.col("years")), F.regexp_replace(F.col("needed_years").cast("string"), r"\.0$", ""), F.lit(" years. "), F.when(met, "Requirement met.").otherwise("Verify additional relevant experience."))),
        F.when(on["degree_level_fit"] & (F.col("degree_level_fit") < 100), F.concat(F.lit("Required education: "), F.col("needed_degree.name"), F.lit("; verify the candidate's qualification."))),
    ))
    warn = F.array_distinct(F.array_compact(F.array(
        F.when(F.col("sanitised"), F.lit("Instruction-like or repetitive content was excluded from scoring evidence.")),
        F.when(~some("required"), F.lit("No hard skills recognized in the job description; skill coverage is unscored (0).")),
        F.when(~dated, F.lit("No numeric experience requirement recognized; years-of-experience fit is inactive (weight 0).")),
        F.when(~on["degree_level_fit"], F.lit("No mandatory education level recognized; degree-level fit is inactive (weight 0).")),
        F.lit("Unstated requirements have zero scores and zero weight; active weights are proportionally normalized. Missing required evidence still scores zero."),
    )))
    return s.select(
        "cv_id", "jd_id", "score", "raw_score", m.verdict(F.col("score")).alias("verdict"), *[f"{g}_score" for g in v.OVERALL], *[k for _, k in m.LEAVES], *[f"w_{g}" for g in v.OVERALL], *[f"w_{k}" for _, k in m.LEAVES],
        named("matched").alias("matched_skills"), named("missing").alias("missing_skills"), F.array_compact(F.array(adjust)).alias("adjustments"),
        F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("Review the supporting CV evidence and role-specific requirements."))).alias("recommendations"), warn.alias("warnings"),
        F.round("years", 2).alias("candidate_years"), "needed_years", F.col("degree.name").alias("candidate_level"), F.col("needed_degree.name").alias("required_level"), "needs_review",
    )


def match(candidates: DataFrame, jobs: DataFrame, as_of: Column, pairs: DataFrame | None = None, above: float | None = None) -> DataFrame:
    """Scores of ``candidates`` against ``jobs(jd_id, description)``, both taken in compatibility form (NFKC).

    With ``above`` over UNMATCHED only pairs that share a skill are formed, by an equi-join, as no other
    can score more; without it all pairs are.
    """
    a, b = prepared_candidates(text.compatible(candidates)), prepared_requirements(text.compatible(jobs.select("jd_id", "description")))
    if pairs is None and above is not None and above >= UNMATCHED:
        pairs = blocked_pairs(a, b)
    out = score(paired(a, b, pairs), as_of)
    return out if above is None else out.where(F.col("score") > above)
