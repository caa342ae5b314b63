"""Scores of candidate and requirement pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions import dates, text
from attestra.functions import vocabulary as v
from attestra.operators import intervals

LEAVES = [(group, leaf) for group, leaves in v.WEIGHTS.items() for leaf in leaves]


def matched(need: Column, have: Column) -> Column:
    return F.array_intersect(need, have)


def missing(need: Column, have: Column) -> Column:
    return F.array_except(need, have)


def normalised_weights(weights: dict[str, float], active: dict[str, Column]) -> dict[str, Column]:
    """Weights of what is active, scaled to a sum of 1; all 0 if nothing is."""
    total = sum((F.when(active[k], w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return {k: F.when(active[k], w / total).otherwise(0.0) for k, w in weights.items()}


def roll_up(values: dict[str, Column], weights: dict[str, Column]) -> Column:
    """The weighted sum to two places."""
    return F.round(sum((values[k] * weights[k] for k in values), F.lit(0.0)), 2)


def guarded(score: Column, violated: Column, conflict: Column, matched: Column, context: Column) -> Column:
    """0 for a violated exclusion; at most 9 for an acronym of another field; with no matched skill also at most 0.09 of the context."""
    return F.round(F.when(violated, 0.0).when(conflict, F.least(score, F.lit(9.0))).when(~matched, F.least(score, F.lit(9.0), context * 0.09)).otherwise(score), 2)


def verdict(score: Column) -> Column:
    out = F
    for least, name in v.VERDICTS[:-1]:
        out = out.when(score >= least, name)
    return out.otherwise(v.VERDICTS[-1][1])


def seniority(t: Column) -> Column:
    """The highest level that a text names, 0 if none."""
    return text.let(t, lambda x: F.greatest(F.lit(0), *[F.when(x.rlike(rf"{text.ANY_CASE}\b(?:{p})\b"), n) for n, p in v.SENIORITY]))


def candidate_columns(skills: Column, summary: Column, soft: Column, jobs: Column, studies: Column, credentials: Column, projects: Column) -> dict[str, Column]:
    """What depends on the candidate alone.

    ``jobs`` is array<struct<position, start_date, end_date, current_position, responsibilities array>>,
    ``studies`` array<struct<degree, field_of_study>>, ``credentials`` array<struct<name>>.
    """
    blank = lambda x: F.coalesce(x, F.lit(""))
    own = F.array_distinct(F.filter(F.transform(skills, lambda s: text.clean(s)["text"]), lambda s: s != ""))
    duties = lambda j: F.coalesce(j["responsibilities"], F.array().cast("array<string>"))
    parts = F.concat(
        F.array(blank(summary)), own, projects,
        F.flatten(F.transform(jobs, lambda j: F.concat(F.array(blank(j["position"])), duties(j)))),
        F.flatten(F.transform(studies, lambda e: F.array(blank(e["degree"]), blank(e["field_of_study"])))),
    )
    whole = text.clean(F.array_join(F.filter(parts, lambda p: p != ""), "\n"))
    return {
        "own_skills": own,
        "cv_text": text.positive(whole["text"]),
        "sanitised": whole["changed"],
        "summary_evidence": text.evidence(summary),
        "academic": text.evidence(F.array_join(F.transform(studies, lambda e: F.concat(blank(e["degree"]), F.lit(" "), blank(e["field_of_study"]))), "\n")),
        "credential_text": text.evidence(F.array_join(F.transform(credentials, lambda c: blank(c["name"])), "\n")),
        "degree": text.degree_level(F.array_join(F.transform(studies, lambda e: blank(e["degree"])), "\n")),
        "soft_list": soft,
        "history": F.transform(jobs, lambda j: F.struct(text.evidence(blank(j["position"])).alias("title"), text.evidence(F.array_join(duties(j), " ")).alias("duties"), F.array_join(duties(j), "\n").alias("raw"), j["start_date"].alias("start_date"), j["end_date"].alias("end_date"), F.coalesce(j["current_position"], F.lit(False)).alias("current"))),
    }


def requirement_columns(description: Column) -> dict[str, Column]:
    """What depends on the requirement text, once it is clean, alone."""
    c = text.constraints(description)
    return {"jd_clean": description, "jd_text": c["positive"], "forbidden": c["forbidden"]}


def related(job: Column, families: Column, software: Column, domains: Column) -> Column:
    """Whether a job counts for a requirement: by role family, else by field, else by having any text."""
    one = F.array(F.lit("software"))
    return text.let(F.struct(text.recognised(job["title"], v.ROLE_FAMILIES).alias("own"), F.when((F.size(families) == 0) & software, one).otherwise(families).alias("target")), lambda x: _related(job, x["own"], x["target"], domains))


def _related(job: Column, own: Column, target: Column, domains: Column) -> Column:
    one = F.array(F.lit("software"))
    by_role = F.arrays_overlap(own, target) | ((target == one) & F.arrays_overlap(own, F.array(F.lit("backend"), F.lit("frontend"), F.lit("devops")))) | ((own == one) & F.arrays_overlap(text.recognised(job["duties"], v.ROLE_FAMILIES), target))
    by_field = F.arrays_overlap(text.recognised(F.concat(job["title"], F.lit(" "), job["duties"]), v.DOMAINS), domains)
    return F.when(F.size(target) > 0, by_role).when(F.size(domains) > 0, by_field).otherwise((job["title"] != "") | (job["duties"] != ""))


def worked_spans(history: Column, as_of: Column) -> Column:
    """``array<struct<a, b>>`` of the jobs whose dates can be told, ended at ``as_of`` at the latest."""

    def one(j: Column) -> Column:
        ongoing = j["current"] | dates.is_current(j["end_date"])
        a = dates.first_day(dates.partial_date(j["start_date"]))
        b = F.when(ongoing, as_of).otherwise(dates.first_day(dates.partial_date(j["end_date"])))
        return F.struct(a.alias("a"), F.when(b.isNotNull(), F.least(b, as_of)).alias("b"))

    return F.filter(F.transform(history, one), lambda s: s["a"] < s["b"])


def title_fit(history: Column, jd: Column) -> Column:
    """Over the jobs, the best share of the wanted roles in the title, less for a lower level; 100 if nothing is wanted."""

    def fit(x: Column) -> Column:
        target, need = x["target"], x["need"]
        named = lambda j: F.when(F.size(target) > 0, text.coverage(text.recognised(j["title"], v.TITLE_ROLES), target)).otherwise(100.0)
        fits = F.transform(history, lambda j: named(j) * F.when(need > 0, F.least(F.lit(100.0), 100 * seniority(j["title"]) / need)).otherwise(100.0) / 100)
        return F.when((F.size(target) == 0) & (need == 0), 100.0).otherwise(F.round(F.coalesce(F.array_max(fits), F.lit(0.0)), 2))

    return text.let(F.struct(text.recognised(jd, v.TITLE_ROLES).alias("target"), seniority(jd).alias("need")), fit)


def years_and_recency(spans: Column, as_of: Column) -> tuple[Column, Column]:
    return intervals.covered_days(spans) / intervals.DAYS_A_YEAR, intervals.recency(F.array_max(F.transform(spans, lambda s: s["b"])), as_of)


def needs_review(baseline: Column, forbidden: Column, conflict: Column, jd: Column, has_evidence: Column) -> Column:
    """Whether a pair would go to a second, contextual model, which is not part of this package."""
    odd = (F.size(forbidden) > 0) | conflict | jd.rlike(r"\b[A-Z]{2,4}\b|\bnot\b")
    return (baseline.between(40, 70) | odd) & has_evidence
