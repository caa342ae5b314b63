"""Column functions over contacts and labelled fields."""

from __future__ import annotations

from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from attestra.functions import vocabulary as v
from attestra.functions.dates import is_current, partial_date
from attestra.functions.text import ANY_CASE, fold, let, strip


def emails(text: Column) -> Column:
    """All e-mail addresses in order of place."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(v.EMAIL), F.lit(0))


def phones(text: Column, country: str = "994") -> Column:
    """Distinct numbers in international form, in order of place.

    Read are +, 00 or a trunk 0 before 8 to 14 further digits with spaces, dots, dashes and brackets
    between. A national number belongs to ``country``. Validity by numbering plan is not checked.
    """
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\w+])((?:\+|00|0)[ .()-]*[1-9](?:[ .()-]*\d){7,13})(?!\d)"), F.lit(1))
    plain = F.transform(raw, lambda x: F.regexp_replace(x, r"[^\d+]", ""))
    return F.array_distinct(F.transform(plain, lambda x: F.when(x.startswith("+"), x).when(x.startswith("00"), F.concat(F.lit("+"), F.substring(x, 3, 99))).otherwise(F.concat(F.lit("+" + country), F.substring(x, 2, 99)))))


@pandas_udf(StringType())
def _ascii_host(host: pd.Series) -> pd.Series:
    def one(h):
        try:
            return h.encode("idna").decode().lower() if isinstance(h, str) else None
        except UnicodeError:
            return None

    return host.map(one)


def url(text: Column, international: bool = False) -> Column:
    """A web address in one form: https if none is named, host in lower case, no fragment; null if it isn't one.

    Marks at the end go; white space, a user name, another scheme or a host without a dot make it null.
    ``international`` also rewrites hosts beyond ASCII, which takes Python.
    """
    t = F.regexp_replace(strip(text), r"[.,;)]+$", "")
    whole = let(t, lambda x: F.when(F.locate("://", x) > 0, x).otherwise(F.concat(F.lit("https://"), x)))
    return let(whole, lambda x: _one_form(x, international))


def _one_form(t: Column, international: bool) -> Column:
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
    scheme, place = F.lower(F.regexp_extract(t, pattern, 1)), F.regexp_extract(t, pattern, 2)
    host, port = F.lower(F.regexp_extract(place, r"^([^:]*)", 1)), F.regexp_extract(place, r":(\d+)$", 1)
    if international:
        host = F.when(host.rlike(r"[^\x00-\x7F]"), _ascii_host(host)).otherwise(host)
    query = F.regexp_extract(t, pattern, 4)
    fine = ~t.rlike(r"(?U)[\s\x00-\x1F]") & scheme.isin("http", "https") & host.contains(".") & ~place.contains("@") & place.rlike(r"^[^:]*(?::\d*)?$") & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535)
    named = F.when((port != "") & (port.try_cast("int") > 0), F.concat(host, F.lit(":"), port.try_cast("int").cast("string"))).otherwise(host)
    return F.when(fine, F.concat(scheme, F.lit("://"), named, F.regexp_extract(t, pattern, 3), F.when(query == "?", "").otherwise(query)))


def url_class(address: Column) -> Column:
    """linkedin for a profile, github for a path there, else website."""
    host = F.regexp_replace(F.regexp_extract(address, r"://([^/:?]*)", 1), r"^www\.", "")
    path = F.regexp_extract(address, r"://[^/?]*([^?]*)", 1)
    return F.when((host == "linkedin.com") & path.startswith("/in/"), "linkedin").when((host == "github.com") & (F.regexp_replace(path, "/", "") != ""), "github").when(address.isNotNull(), "website")


def urls(text: Column) -> Column:
    """All addresses of a text in one form, in order of place."""
    return F.array_compact(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?iu)" + v.URL), F.lit(0)), lambda u: url(u)))


def first_of_class(addresses: Column, kind: str) -> Column:
    return F.get(F.filter(addresses, lambda a: url_class(a) == kind), F.lit(0))


def github_user(text: Column) -> Column:
    """The account that a line `github: name` names, as an address."""
    name = F.regexp_extract(text, r"(?imu)\bgithub\s*:\s*([a-z0-9](?:[a-z0-9-]{0,37}[a-z0-9])?)[_ ]*(?=\n|\z)", 1)
    return F.when(name != "", F.concat(F.lit("https://github.com/"), name))


def labelled(text: Column, aliases: str) -> Column:
    """What follows one of the labels, joined by |, at a line's start or after | or ;, up to the next of these; null if absent."""
    found = F.regexp_extract(text, rf"{ANY_CASE}(?:^|[\n|;])\s*(?:{aliases})\s*:\s*([^\n|;]+)", 1)
    return F.nullif(strip(found), F.lit(""))


def labelled_dates(text: Column) -> Column:
    """``struct<start, end, current>`` from labels; reversed dates are dropped."""

    def ends(t: Column) -> Column:
        return let(labelled(t, "end date|to"), lambda end: F.struct(partial_date(labelled(t, "start date|from")).alias("start"), partial_date(end).alias("end"), is_current(end).alias("current")))

    def forward(x: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.when(F.coalesce(x["start"] > x["end"], F.lit(False)), F.struct(none.alias("start"), none.alias("end"), F.lit(False).alias("current"))).otherwise(x)

    return let(let(text, ends), forward)


def personal_labels(text: Column) -> Column:
    """A struct of all labelled personal fields."""
    return F.struct(*[labelled(text, aliases).alias(name) for name, aliases in v.LABELS.items()])


def name_parts(name: Column) -> Column:
    """``struct<first, middle, last>`` by white space; a single word has no last name."""
    w = F.split(strip(name), r"(?U)\s+")
    n = F.size(w)
    return F.struct(F.get(w, F.lit(0)).alias("first"), F.when(n > 2, F.array_join(F.slice(w, 2, F.greatest(n - 2, F.lit(0))), " ")).alias("middle"), F.when(n > 1, F.element_at(w, -1)).alias("last"))


def stated_gender(value: Column) -> Column:
    """male, female, or unknown, from an explicit statement."""
    t = fold(strip(F.coalesce(value, F.lit(""))))
    return F.when(t.isin(*v.GENDERS["male"]), "male").when(t.isin(*v.GENDERS["female"]), "female").otherwise("unknown")


def inferred_gender(name: Column, text: Column, registry: Column | None = None) -> Column:
    """``struct<gender, confidence>`` from a name and its context; opt-in, and no plan of this package uses it.

    ``registry`` is what a name table of the caller says of the first name: female, male, unisex or null.
    """
    words = F.array_remove(F.split(fold(F.coalesce(name, F.lit(""))), r"(?U)[^\p{L}'’-]+"), "")
    first, last = F.get(words, F.lit(0)), F.try_element_at(words, F.lit(-1))
    registry = F.lit(None).cast("string") if registry is None else registry
    say = lambda g, c: F.struct(F.lit(g).alias("gender"), F.lit(c).alias("confidence"))
    context = lambda otherwise: F.when(text.rlike(ANY_CASE + v.GENDER_CONTEXT["female"]), say("female", 0.78)).when(text.rlike(ANY_CASE + v.GENDER_CONTEXT["male"]), say("male", 0.78)).otherwise(say("unknown", otherwise))
    out = F.when(F.size(words) == 0, say("unknown", 0.0))
    for g, forms in v.PATRONYMICS.items():
        out = out.when(F.arrays_overlap(words, F.array(*map(F.lit, forms))), say(g, 0.99))
    ends = lambda forms: F.greatest(*[last.endswith(x) for x in forms])
    for g, c, forms in v.NAME_ENDINGS[:2]:
        out = out.when(ends(forms), say(g, c))
    out = out.when(registry == "unisex", context(0.20))
    for g, c, forms in v.NAME_ENDINGS[2:]:
        out = out.when(ends(forms), say(g, c))
    out = out.when(first.endswith("gül"), say("female", 0.90)).when(registry == "female", say("female", 0.92)).when(registry == "male", say("male", 0.92))
    return out.otherwise(context(0.10))


@pandas_udf(StringType())
def decoded_uri(raw: pd.Series) -> pd.Series:
    """The address in a PDF string, literal `(...)` or hex `<...>`; null if it can't be read."""
    escapes = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}

    def literal(body: str) -> str:
        out, rest = [], body
        while rest:
            head, slash, rest = rest.partition("\\")
            out.append(head)
            if not slash or not rest:
                out.append(slash)
                break
            octal = rest[: next((i for i, c in enumerate(rest[:3]) if c not in "01234567"), min(3, len(rest)))]
            out.append(chr(int(octal, 8)) if octal else escapes.get(rest[0], rest[0]))
            rest = rest[len(octal) or 1 :]
        return unquote("".join(out))

    def one(x):
        if not isinstance(x, str) or len(x) < 2:
            return None
        if x[0] != "<":
            return literal(x[1:-1])
        try:
            data = bytes.fromhex("".join(x[1:-1].split()))
            return data.decode("utf-16" if data[:2] in (b"\xfe\xff", b"\xff\xfe") else "utf-8")
        except ValueError:
            return None

    return raw.map(one)
