"""Column functions over text: clauses, clean evidence, recognition."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from attestra.functions import vocabulary as v

#: Flags under which Java reads a pattern as Unicode-aware and case-blind.
ANY_CASE, UNICODE = "(?iuU)", "(?U)"
#: Line ends as text files have them beyond the line feed.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
CLAUSE_END = r"(?U)[;\n]+|(?<=[.!?])\s+"
BLANK_ENDS, NO_WORD, FORMAT = r"(?U)^\s+|\s+$", r"(?U)\W+", r"\p{Cf}"


@pandas_udf(StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    """NFKC; Spark has no built-in for it, so texts get it once, at ingest."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else t)


def compatible(df: DataFrame) -> DataFrame:
    """``df`` with every string in NFKC, however deep in arrays and structs."""

    def form(x):
        if isinstance(x, str):
            return unicodedata.normalize("NFKC", x)
        return [form(y) for y in x] if isinstance(x, list) else {k: form(y) for k, y in x.items()} if isinstance(x, dict) else x

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([form(r) for r in b.to_pylist()], b.schema)

    return df.mapInArrow(run, df.schema)


@pandas_udf(StringType())
def composed_form(text: pd.Series) -> pd.Series:
    """NFC, at ingest."""
    return text.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else t)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, BLANK_ENDS, "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` where the value is made once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def said(x: str) -> str:
    """A string as SQL text."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` where ``name`` stands for a value that is made once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def apply(function: str, value: Column) -> Column:
    """What a lambda in SQL text gives for a column.

    Functions that plans use many times are written so, as text is parsed at once, while each operation on columns
    is a call from Python to the JVM.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(function)), F.lit(0))


def lookup(table: dict[str, str]) -> Column:
    """A map column of fixed entries, as one expression."""
    return F.expr("map(" + ", ".join(f"{said(k)}, {said(x)}" for k, x in table.items()) + ")")


def fold(text: Column) -> Column:
    """Lower case with the Turkish dotted i undone."""
    return F.replace(F.lower(text), F.lit("i̇"), F.lit("i"))


def canonical(skill: Column) -> Column:
    """The folded skill, or what it is an alias of."""
    return let(fold(strip(skill)), lambda folded: F.coalesce(F.try_element_at(lookup(v.ALIASES), folded), folded))


def display(skill: Column) -> Column:
    """The usual spelling, or a capital after everything that is not a letter."""
    letters = F.split(skill, "")
    titled = F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~F.get(letters, i - 1).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")
    return F.coalesce(F.try_element_at(lookup(v.DISPLAY), skill), titled)


def unknown_characters(text: Column) -> Column:
    """True if a control character other than tab and line ends, or the replacement character, occurs."""
    return text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F�]")


def clauses(text: Column) -> Column:
    """Pieces between semicolons, line feeds, and white space after an end mark; as they are."""
    return F.split(text, CLAUSE_END)


def stuffed(line: Column, least: int = 40, share: float = 0.18) -> Column:
    """Whether a line of ``least`` words or more, without an end mark, has fewer different words than that share of them."""
    words = F.array_remove(F.split(F.lower(line), NO_WORD), "")
    return let(words, lambda w: (F.size(w) >= least) & (F.size(F.array_distinct(w)) < F.size(w) * share)) & ~line.rlike("[.!?]")


def clean(text: Column) -> Column:
    """``struct<text, changed>``: no format characters, instructions or repetition; each clause once.

    A line is cut where an instruction to the reader starts; a line of 40 words or more that are
    mostly the same few, without an end mark, goes; clauses are stripped and the first of equal ones
    stays. ``changed`` tells whether any of that took something away. Null counts as empty.
    """
    return apply(_clean(), text)


@functools.cache
def _clean() -> str:
    strip, marker, end = said(BLANK_ENDS), said(ANY_CASE + "(?:" + v.INSTRUCTION + ")"), said("\n")
    many = bind(f"array_remove(split(lower(y.text), {said(NO_WORD)}), '')", "w", "size(w) >= 40 AND size(array_distinct(w)) < size(w) * 0.18D")
    thin = bind(f"({many}) AND NOT y.text RLIKE '[.!?]'", "s", "named_struct('text', CASE WHEN NOT s THEN y.text END, 'changed', y.told OR s)")
    cut = bind(f"named_struct('text', CASE WHEN line RLIKE {marker} THEN regexp_replace(get(split(line, {marker}, 2), 0), {strip}, '') ELSE line END, 'told', line RLIKE {marker})", "y", thin)
    pieces = f"filter(transform(split(array_join(transform(lines, z -> z.text), {end}), {said(CLAUSE_END)}), c -> regexp_replace(c, {strip}, '')), c -> c <> '')"
    whole = bind(pieces, "p", f"named_struct('text', array_join(array_distinct(p), {end}), 'changed', exists(lines, z -> z.changed) OR size(array_distinct(p)) <> size(p))")
    return "x -> " + bind(f"transform(split(regexp_replace(coalesce(x, ''), {said(FORMAT)}, ''), {said(LINE_END)}), line -> {cut})", "lines", whole)


def positive(text: Column) -> Column:
    """The clauses that deny nothing, a line each."""
    return F.array_join(F.filter(clauses(text), lambda c: ~denies(c)), "\n")


def denies(clause: Column) -> Column:
    """Whether a clause says that something is not so."""
    return clause.rlike(ANY_CASE + v.NEGATIVE)


def evidence(text: Column) -> Column:
    """Clean, then positive."""
    return positive(clean(text)["text"])


def contextual(text: Column) -> Column:
    """A requirement text without its administrative clauses; all of it if none is left."""
    parts = F.split(text, r"(?U)[;\n]|(?<=[.!?])\s+")
    left = strip(F.array_join(F.filter(parts, lambda c: ~c.rlike(ANY_CASE + "(?:" + v.ADMINISTRATIVE + ")")), "\n"))
    return F.when(left == "", text).otherwise(left)


def recognised(text: Column, vocabulary: dict[str, str]) -> Column:
    """The sorted keys whose pattern occurs between word ends, in any case."""
    found = ", ".join(f"CASE WHEN t RLIKE {said(rf'{ANY_CASE}\b(?:{p})\b')} THEN {said(k)} END" for k, p in sorted(vocabulary.items()))
    return apply(f"t -> array_compact(array({found}))", text)


def quoted(phrase: Column) -> Column:
    """A phrase as a pattern that means itself."""
    return F.regexp_replace(phrase, r"([^\p{L}\p{N}\s])", r"\\$1")


def holds(text: Column, phrase: Column) -> Column:
    """Whether ``phrase`` stands in ``text`` with no word character, plus or hash beside it."""
    return F.regexp_like(text, F.concat(F.lit(r"(?U)(?<![\w+#])"), quoted(phrase), F.lit(r"(?![\w+#])")))


def one_of(words: Iterable[str]) -> Column:
    """An array of fixed words, as one expression."""
    return F.map_keys(lookup(dict.fromkeys(words, "")))


@functools.cache
def _terms() -> tuple[str, dict[str, str]]:
    """A pattern that finds the longest vocabulary term at each place, and for each term the canonical skills that it and its beginnings name."""
    words = sorted({s for c, terms in v.SKILLS.items() if c != "soft_skills" for s in terms} | set(v.MORE_SKILLS) | set(v.ALIASES), key=lambda w: (-len(w), w))
    ends = lambda w, u: w == u or (w.startswith(u) and not re.match(r"[\w+#]", w[len(u)]))
    pattern = "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)
    return rf"(?U)(?<![\w+#])(?=({pattern})(?![\w+#]))", {w: ",".join(sorted({v.ALIASES.get(u, u) for u in words if ends(w, u)})) for w in words}


def skills_in(text: Column, extra: Column | None = None) -> Column:
    """The sorted canonical skills of a text: the vocabulary, ``extra`` phrases, and what a line `Skills:` lists; no soft ones."""
    pattern, named = _terms()

    def found(folded: Column) -> Column:
        terms = F.array_distinct(F.regexp_extract_all(folded, F.lit(pattern), F.lit(1)))
        known = F.flatten(F.transform(terms, lambda t: F.split(F.try_element_at(lookup(named), t), ",")))
        lists = F.regexp_extract_all(folded, F.lit(r"(?imuU)" + v.SKILL_LIST), F.lit(1))
        items = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, r"(?U)[,;]|\s+(?:and|və|ve)\s+|\s*&\s*"))), lambda x: F.regexp_replace(strip(x), r"\.+$", ""))
        listed = F.transform(F.filter(items, lambda x: (x != "") & (F.char_length(x) <= 60) & (F.size(F.split(strip(x), r"(?U)\s+")) <= 4)), canonical)
        parts = [known, listed]
        if extra is not None:
            own = F.transform(F.filter(extra, lambda s: strip(s) != ""), canonical)
            parts.append(F.filter(own, lambda s: holds(folded, s)))
        return F.array_sort(F.array_except(F.array_distinct(F.concat(*parts)), one_of(v.SOFT)))

    return let(fold(text), found)


def coverage(have: Column, need: Column) -> Column:
    """Percent of ``need`` that ``have`` holds, to two places; 0 if nothing is needed."""
    return F.when(F.size(need) > 0, F.round(100 * F.size(F.array_intersect(have, need)) / F.size(need), 2)).otherwise(0.0)


def constraints(text: Column) -> Column:
    """``struct<positive, forbidden>``: optional clauses go; the skills of prohibiting clauses are forbidden."""
    bans = lambda c: c.rlike(ANY_CASE + "(?:" + v.PROHIBITED + ")")
    said = F.filter(clauses(text), lambda c: ~c.rlike(ANY_CASE + "(?:" + v.OPTIONAL + ")"))
    return let(said, lambda parts: F.struct(F.array_join(F.filter(parts, lambda c: ~bans(c)), "\n").alias("positive"), skills_in(F.array_join(F.filter(parts, bans), "\n")).alias("forbidden")))


def required_years(text: Column) -> Column:
    """The largest number of years asked for near a word for experience, months as parts of a year; null if none."""
    near = ANY_CASE + rf"((?s:.){{0,40}}?)(?<![\d.]){v.YEARS}(?=((?s:.){{0,60}}))"
    group = lambda t, i, name: F.regexp_extract_all(t, F.lit(near), F.lit(i)).alias(name)
    rows = let(text, lambda t: F.arrays_zip(group(t, 0, "whole"), group(t, 4, "after"), group(t, 2, "number"), group(t, 3, "unit")))
    near_words = ANY_CASE + v.EXPERIENCE_WORDS
    good = F.filter(rows, lambda r: F.concat(r["whole"], r["after"]).rlike(near_words))
    return F.array_max(F.transform(good, lambda r: r["number"].cast("double") / F.when(F.lower(r["unit"]).startswith("month"), 12).otherwise(1)))


def degree_level(text: Column, requirement: bool = False) -> Column:
    """``struct<level, name>``: the lowest degree that a requirement insists on, or the highest that a candidate names; null if none."""
    parts = F.split(text, r"(?U)[\n;]|\.(?=\s+[A-Z])")
    if requirement:
        parts = F.filter(parts, lambda c: ~c.rlike(ANY_CASE + "(?:" + v.NOT_MANDATORY + ")"))
    names = lambda t, pattern: t.rlike(rf"{ANY_CASE}(?<!\w)(?:{pattern})(?!\w)")
    hits = let(F.array_join(parts, "\n"), lambda t: F.array_compact(F.array(*[F.when(names(t, p), F.struct(F.lit(n).alias("level"), F.lit(name).alias("name"))) for n, name, p in v.DEGREES])))
    return F.array_min(hits) if requirement else F.array_max(hits)


def conflicting(a: Column, b: Column) -> Column:
    """Whether both texts use an acronym but spell it out in different fields."""
    out = F.lit(False)
    for acronym, fields in v.ACRONYMS.items():
        both = a.rlike(rf"{ANY_CASE}\b{acronym}\b") & b.rlike(rf"{ANY_CASE}\b{acronym}\b")
        ka, kb = (F.array_compact(F.array(*[F.when(t.rlike(ANY_CASE + "(?:" + p + ")"), F.lit(i)) for i, p in enumerate(fields)])) for t in (a, b))
        out = out | (both & (F.size(ka) > 0) & (F.size(kb) > 0) & ~F.arrays_overlap(ka, kb))
    return out
