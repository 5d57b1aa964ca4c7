"""Text functions as column expressions; nulls count as empty text, and the results are never null unless said."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Institutions known under other codes (fixed values).
INSTITUTION_ALIASES = {"MNHN": "P", "NHMUK": "BM", "BRITISHMUSEUM": "BM"}
#: Kinds of type specimen, in the order in which they are looked for (fixed values).
TYPE_NAMES = ["isolectotype", "isoneotype", "isoholotype", "lectotype", "holotype", "neotype", "syntype", "isotype", "paratype", "epitype", "type"]
#: Countries whose name alone is no locality (fixed values).
COUNTRY_ONLY = ["china", "japan", "taiwan", "chinese taipei", "philippines", "nepal", "india", "vietnam", "thailand", "malaysia", "indonesia"]
#: Words of a locality that narrow it down (fixed values).
DETAIL_WORDS = ["mt.", "mount", "mountain", "river", "stream", "valley", "trail", "village", "mura", "gun", "county", "forest", "road", "km"]
#: Why a locality is too broad (fixed values).
NO_LOCALITY, ONLY_REGION, TOO_BROAD, ONLY_ADMIN = "No locality text is available.", "Only country/state-level locality is available.", "Locality is too broad for georeferencing: ", "Only broad administrative locality is available."
#: Query parameters whose values are secrets (fixed values).
SECRET_PARAMETERS = ["api_key", "apikey", "key", "token", "access_token", "password", "client_secret"]


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def first_present(*columns: Column | str) -> Column:
    """The first column that is not blank, trimmed; "" without any."""
    return F.coalesce(*[F.nullif(F.trim(text(c)), F.lit("")) for c in columns], F.lit(""))


def first_filled(*columns: Column | str) -> Column:
    """The first column that is not empty, as it is; "" without any."""
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in columns], F.lit(""))


def code(c: Column | str) -> Column:
    """Capital letters and digits only, other characters dropped."""
    return F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]+", "")


def institution(c: Column | str) -> Column:
    """An institution's code under its usual name."""
    own = code(c)
    return reduce(lambda rest, kv: F.when(own == kv[0], kv[1]).otherwise(rest), INSTITUTION_ALIASES.items(), own)


def words(c: Column | str) -> Column:
    """Small letters and digits with single blanks between, ASCII only."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def type_token(c: Column | str) -> Column:
    """The first kind of type, in the fixed order, that stands in the text as a word; "" without any."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text(c)), "[^a-z]+", " "), F.lit(" "))
    return reduce(lambda rest, name: F.when(plain.contains(f" {name} "), name).otherwise(rest), reversed(TYPE_NAMES), F.lit(""))


def name_matches(query: Column | str, *candidates: Column | str) -> Column:
    """Whether the query's first two words stand in one of the names; queries of fewer words match anything."""
    q = words(query)
    binomial = F.regexp_extract(q, r"^(\S+ \S+)", 1)
    return (binomial == "") | reduce(lambda a, b: a | b, [words(c).contains(binomial) for c in candidates])


def code_variants(*columns: Column | str) -> Column:
    """The codes that the texts may stand for: each whole text and each of its parts, without empty ones."""
    marks = ":/;,()-"
    parts = [F.concat(F.array(text(c)), F.split(F.translate(text(c), marks, " " * len(marks)), r"\s+")) for c in columns]
    return F.array_distinct(F.filter(F.transform(F.flatten(F.array(*parts)), code), lambda p: p != ""))


def institution_allowed(configured: Sequence[str], *columns: Column | str) -> Column:
    """Whether one of the codes is among the configured ones; an empty configuration allows all."""
    if not configured:
        return F.lit(True)
    return F.arrays_overlap(code_variants(*columns), code_variants(*[F.lit(c) for c in configured]))


def normal_url(c: Column | str) -> Column:
    """An address for comparing: scheme and host in small letters, single slashes in the path, no fragment; other texts trimmed."""
    t = F.trim(text(c))
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]+)?[?]?(#.*)?$"

    def part(i: int) -> Column:
        return F.regexp_extract(t, parts, i)

    built = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), "/+", "/"), part(4))
    return F.when(t.rlike(parts), built).otherwise(t)


def same_host(a: Column | str, b: Column | str) -> Column:
    """Whether two addresses have one host; false if one is no address."""
    hosts = [F.lower(F.try_parse_url(text(c), F.lit("HOST"))) for c in (a, b)]
    return F.coalesce(hosts[0] == hosts[1], F.lit(False))


def redacted(c: Column | str) -> Column:
    """An address with the values of secret parameters masked."""
    return F.regexp_replace(text(c), r"(?i)([?&](?:" + "|".join(SECRET_PARAMETERS) + r")=)[^&\s)]+", "$1REDACTED")


def safe_token(c: Column | str, fallback: str = "unknown") -> Column:
    """Letters, digits, point, hyphen and underscore; other runs become one underscore; at most 140 characters."""
    runs = F.regexp_extract_all(text(c), F.lit(r"([\w.-]+)"), 1)
    t = F.substring(F.btrim(F.array_join(runs, "_"), F.lit("_")), 1, 140)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit(fallback))


def appended_note(existing: Column | str, note: Column | str) -> Column:
    return F.when(text(note) == "", text(existing)).when(text(existing) == "", text(note)).otherwise(F.concat(text(existing), F.lit("; "), text(note)))


def appended_value(existing: Column | str, value: Column | str) -> Column:
    """A list parted by bars with one value more, each value once, in order."""
    have = F.filter(F.transform(F.split(text(existing), r"\|"), lambda v: F.trim(v)), lambda v: v != "")
    return F.array_join(F.array_distinct(F.concat(have, F.array(text(value)))), " | ")


def joined(values: Column, by: str = "; ") -> Column:
    """The filled values of an array, each once, in order."""
    return F.array_join(F.array_distinct(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")), by)


def script_languages(c: Column | str) -> Column:
    """Languages by script, in order: kana ja, Han zh (ja/zh beside kana), Latin letters en/la; und without any."""
    t = text(c)
    kana, han, latin = t.rlike(r"[぀-ヿ]"), t.rlike(r"[一-鿿]"), t.rlike("[A-Za-z]")
    found = F.filter(F.array(F.when(kana, F.lit("ja")), F.when(han, F.when(kana, F.lit("ja/zh")).otherwise(F.lit("zh"))), F.when(latin, F.lit("en/la"))), lambda v: v.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("und")))


def split_languages(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(text(c), "[|,;]"), lambda v: F.trim(v)), lambda v: v != "")


def broad_locality(locality: Column, country: Column, state: Column) -> Column:
    """Why a locality is too broad for a place on the map, "" if it is not.

    locality: all useful locality texts joined by blanks.
    """

    def plain(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(text(c))), r"\s+", " ")

    loc, cou, sta = plain(locality), plain(country), plain(state)
    bare = F.regexp_replace(loc, "^[ .,:;]+|[ .,:;]+$", "")
    tokens = r"[A-Za-z぀-ヿ一-鿿0-9]+"

    def split(c: Column) -> Column:
        return F.regexp_extract_all(c, F.lit(f"({tokens})"), 1)

    informative = F.filter(split(loc), lambda w: ~w.isin("pref", "province", "county", "country"))
    admin = F.array_union(split(cou), split(sta))
    too_broad = F.concat(F.lit(TOO_BROAD), bare, F.lit("."))
    broad = loc.contains("prefecture") | loc.contains("province") | loc.contains("pref.")
    detail = reduce(lambda a, b: a | b, [loc.contains(w) for w in DETAIL_WORDS])
    return (
        F.when((loc == "") & ((cou != "") | (sta != "")), ONLY_REGION)
        .when(loc == "", NO_LOCALITY)
        .when(bare.isin(COUNTRY_ONLY) | (bare == cou) | (bare == sta), too_broad)
        .when((F.size(informative) > 0) & (F.size(admin) > 0) & (F.size(F.array_except(informative, admin)) == 0), too_broad)
        .when(broad & ~detail & (F.size(informative) <= 2), ONLY_ADMIN)
        .otherwise("")
    )


def cache_key(*fields: Column | str) -> Column:
    """The content address of a request: SHA-256 over the fields, each ended by a zero byte."""
    return F.sha2(reduce(lambda a, b: F.concat(a, b), [F.concat(F.encode(text(f), "UTF-8"), F.unhex(F.lit("00"))) for f in fields]), 256)


def human_bytes(c: Column) -> Column:
    """A size with a binary unit, one decimal from KB on."""
    steps = F.when(c < 1024, F.concat(c.cast("long").cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        steps = steps.when(c < 1024 ** (i + 1), F.concat(F.format_string("%.1f", c / 1024.0**i), F.lit(f" {unit}")))
    return steps.otherwise(F.concat(F.format_string("%.1f", c / 1024.0**4), F.lit(" TB")))
