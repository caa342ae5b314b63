"""Column functions over partial dates, spans and durations.

A partial date is the text YYYY, YYYY-MM or YYYY-MM-DD.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions import vocabulary as v
from attestra.functions.text import ANY_CASE, apply, let, said, strip


def is_current(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(ANY_CASE + "^" + v.CURRENT + "$")


def partial_date(text: Column) -> Column:
    """The partial date that a text states; null if it states none, an impossible or an ambiguous one.

    With both numbers up to 12 and different, day and month can't be told apart. Month names are
    Azerbaijani, English, Turkish or Russian. Other ways to write dates are not read.
    """
    return apply(_partial(), F.lower(strip(F.coalesce(text, F.lit("")))))


@functools.cache
def _partial() -> str:
    def group(pattern: str, i: int) -> str:
        return f"regexp_extract(t, {said(pattern)}, {i})"

    def is_like(pattern: str) -> str:
        return f"t RLIKE {said(pattern)}"

    def day(y: str, m: str, d: str, size: int = 10) -> str:
        """A day as text, or its month; null if there is no such day."""
        return f"substring(CAST(try_to_date(concat_ws('-', lpad({y}, 4, '0'), lpad({m}, 2, '0'), lpad({d}, 2, '0')), 'yyyy-MM-dd') AS STRING), 1, {size})"

    short, triple, month_year = r"^(\d{1,2})\.(\d{1,2})[.-](\d{2})$", r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})$", r"^(\d{1,2})[/.](\d{4})$"
    iso, named = r"^(\d{4})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?$", rf"{ANY_CASE}^(?:(\d{{1,2}})\s+)?({v.MONTH})\s+(\d{{4}})$"
    two = f"try_cast({group(short, 3)} AS INT)"
    year = f"CAST({two} + CASE WHEN {two} < 50 THEN 2000 ELSE 1900 END AS STRING)"
    a, b = f"try_cast({group(triple, 1)} AS INT)", f"try_cast({group(triple, 2)} AS INT)"
    starts = {(w[:4] if w.startswith("iyu") else w[:3]): n for n, words in v.MONTH_STARTS.items() for w in words}
    numbers = "map(" + ", ".join(f"{said(k)}, '{n}'" for k, n in starts.items()) + ")"
    month = "coalesce(" + ", ".join(f"try_element_at({numbers}, substring({group(named, 2)}, 1, {n}))" for n in (4, 3)) + ")"
    cases = [
        (is_like(short), day(year, group(short, 2), group(short, 1))),
        (is_like(ANY_CASE + "^" + v.CURRENT + "$"), "NULL"),
        ("NOT " + is_like(r"(?U)\b(?:19|20)\d{2}\b"), "NULL"),
        (is_like(r"^(?:19|20)\d{2}$"), "t"),
        (f"{is_like(triple)} AND {a} <= 12 AND {b} <= 12 AND {a} <> {b}", "NULL"),
        (f"{is_like(triple)} AND {a} > 12", day(group(triple, 3), group(triple, 2), group(triple, 1))),
        (is_like(triple), day(group(triple, 3), group(triple, 1), group(triple, 2))),
        (f"{is_like(iso)} AND {group(iso, 3)} <> ''", day(group(iso, 1), group(iso, 2), group(iso, 3))),
        (is_like(iso), day(group(iso, 1), group(iso, 2), "'1'", 7)),
        (is_like(month_year), day(group(month_year, 2), group(month_year, 1), "'1'", 7)),
        (f"{is_like(named)} AND {group(named, 1)} <> ''", day(group(named, 3), month, group(named, 1))),
        (is_like(named), day(group(named, 3), month, "'1'", 7)),
    ]
    return "t -> CASE " + " ".join(f"WHEN {c} THEN {x}" for c, x in cases) + " END"


def span(text: Column) -> Column:
    """``struct<start, end, current>`` of the first date range in a text; without one, the text as a single date. A reversed range has neither."""
    pattern = ANY_CASE + v.RANGE

    def ends(t: Column) -> Column:
        found = t.rlike(pattern)
        last = F.when(found, F.regexp_extract(t, pattern, 2))
        return F.struct(partial_date(F.when(found, F.regexp_extract(t, pattern, 1)).otherwise(t)).alias("start"), partial_date(last).alias("end"), (found & is_current(last)).alias("current"))

    def forward(x: Column) -> Column:
        reverse = F.coalesce(F.substring(x["start"], 1, 7) > F.substring(x["end"], 1, 7), F.lit(False))
        return F.when(reverse, F.struct(F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), F.lit(False).alias("current"))).otherwise(x)

    return let(let(text, ends), forward)


def first_day(partial: Column) -> Column:
    """The first day of a partial date."""
    return F.try_to_date(F.concat(partial, F.when(F.length(partial) == 4, "-01-01").when(F.length(partial) == 7, "-01").otherwise("")), "yyyy-MM-dd")


def duration(start: Column, end: Column, current: Column, as_of: Column) -> Column:
    """Time between two partial dates of month precision or better, in words; empty if it can't be told.

    Days count only if both dates have them. ``as_of`` is the end of what is current.
    """
    good = r"^\d{4}-\d{2}(?:-\d{2})?$"
    unit = lambda n, name: F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + name), F.when(n != 1, "s").otherwise("")))

    def ends(until: Column) -> Column:
        whole = (F.length(start) == 10) & (F.length(until) == 10)
        fine = start.rlike(good) & until.rlike(good)
        return F.struct(first_day(start).alias("a"), first_day(until).alias("b"), whole.alias("whole"), fine.alias("fine"))

    def between(x: Column) -> Column:
        a, b = x["a"], x["b"]
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - F.when(x["whole"] & (F.dayofmonth(b) < F.dayofmonth(a)), 1).otherwise(0)
        return F.struct(months.alias("months"), F.datediff(b, a).alias("days"), x["whole"].alias("whole"), F.coalesce(x["fine"] & (b >= a), F.lit(False)).alias("fine"))

    def said(x: Column) -> Column:
        words = F.concat_ws(" ", unit(F.floor(x["months"] / 12).cast("int"), "yr"), unit(x["months"] % 12, "mo"))
        days = F.concat(x["days"].cast("string"), F.lit(" day"), F.when(x["days"] != 1, "s").otherwise(""))
        return F.when(~x["fine"], "").when(x["whole"] & (x["months"] == 0), days).when(x["months"] == 0, "Less than 1 month").otherwise(words)

    return let(let(let(F.when(current, as_of.cast("string")).otherwise(end), ends), between), said)
