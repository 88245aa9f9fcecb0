"""Scalar functions of dirty records: numbers, strings, signed years, coordinates. All are column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: What counts as nothing, in lower case.
NULL_TOKENS = ("", "na", "n/a", "nan", "null", "none", "<na>", "-")
BIN_YEARS = 25
EARTH_KM = 6371.0
#: Latitude at which the plane projection is true.
TRUE_LATITUDE = 42.5


def text(c: Column) -> Column:
    """White space collapsed and trimmed; a null token is null."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(~F.lower(t).isin(*NULL_TOKENS), t)


def number(c: Column) -> Column:
    """A finite double, else null."""
    d = F.trim(c).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def whole(c: Column) -> Column:
    """A number rounded half to even, as an int, else null."""
    return F.bround(number(c)).try_cast("int")


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits, runs of others one hyphen; 'unnamed' if nothing is left.

    Letters with marks and other signs that decompose (NFKD) count as what
    they hold of ASCII; the rest of Unicode goes without a hyphen.
    """
    s = F.regexp_replace(_ascii(c), r"[^\x00-\x7F]+", "")
    s = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("unnamed")).otherwise(s)


def _decomposed() -> dict[str, str]:
    """Every sign beyond ASCII whose decomposition holds ASCII, and that ASCII. Blanks stand for separators and controls."""
    found = {}
    for code in [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if x < "\x80")
        if plain:
            found[chr(code)] = plain
    return found


_PLAIN = _decomposed()
_SINGLE = {k: v for k, v in _PLAIN.items() if len(v) == 1}
_SEVERAL = {k: v for k, v in _PLAIN.items() if len(v) > 1}


def _ascii(c: Column) -> Column:
    """Signs that decompose to one sign of ASCII at once; those that give several by a table, only in texts that have some left."""
    s = F.translate(c, "".join(_SINGLE), "".join(_SINGLE.values()))
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in _SEVERAL.items())), F.lit("\x01"), F.lit("\x02"))
    by_sign = F.array_join(F.transform(F.split(s, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(s.rlike(r"[^\x00-\x7F]"), by_sign).otherwise(s)


def plain_letters(c: Column) -> Column:
    """Letters without marks, as far as they decompose to one letter of ASCII; others stay."""
    return F.translate(c, "".join(_SINGLE), "".join(_SINGLE.values()))


def year_label(y: Column) -> Column:
    """'400 BC', 'AD 25', 'undated'."""
    return F.when(y < 0, F.concat((-y).cast("string"), F.lit(" BC"))).when(y >= 0, F.concat(F.lit("AD "), y.cast("string"))).otherwise(F.lit("undated"))


def span_label(start: Column, end: Column) -> Column:
    """'400 BC – AD 25'; one label for one year; an unknown end is a dash; 'undated' without both."""
    one = lambda y: F.when(y.isNull(), F.lit("—")).otherwise(year_label(y))
    return F.when(start.isNull() & end.isNull(), F.lit("undated")).when(start.eqNullSafe(end), one(start)).otherwise(F.concat_ws(" – ", one(start), one(end)))


def bin_edge(y: Column) -> Column:
    """The first year of the quarter century of a signed year. There is no year 0; it falls to -24."""
    return F.when(y < 0, (-(F.floor((-y + BIN_YEARS - 1) / BIN_YEARS) * BIN_YEARS))).otherwise(F.floor((y - 1) / BIN_YEARS) * BIN_YEARS + 1).cast("int")


def bin_ordinal(edge: Column) -> Column:
    """Consecutive numbers of bin edges: -25 is -1, 1 is 0."""
    return F.when(edge < 0, F.floor(edge / BIN_YEARS)).otherwise(F.floor((edge - 1) / BIN_YEARS)).cast("int")


def year_ordinal(y: Column) -> Column:
    """bin_ordinal(bin_edge(y)) in one step."""
    return F.floor((y - (y >= 0).cast("int")) / BIN_YEARS).cast("int")


def ordinal_edge(ordinal: Column) -> Column:
    return F.when(ordinal < 0, ordinal * BIN_YEARS).otherwise(ordinal * BIN_YEARS + 1).cast("int")


def bin_label(edge: Column) -> Column:
    """'400–376 BC', 'AD 1–25', 'undated'."""
    before = F.concat((-edge).cast("string"), F.lit("–"), (-edge - BIN_YEARS + 1).cast("string"), F.lit(" BC"))
    after = F.concat(F.lit("AD "), edge.cast("string"), F.lit("–"), (edge + BIN_YEARS - 1).cast("string"))
    return F.when(edge < 0, before).when(edge >= 0, after).otherwise(F.lit("undated"))


def midpoint(start: Column, end: Column) -> Column:
    """The mean of the ends that are there, half to even."""
    return F.bround((F.coalesce(start, end) + F.coalesce(end, start)) / F.lit(2.0)).cast("int")


def century(y: Column) -> Column:
    return F.when(y < 0, -F.floor((-y + 99) / 100)).otherwise(F.floor((y - 1) / 100) + 1).cast("int")


def bin_century(edge: Column) -> Column:
    """The century of a bin as floor(edge / 100): another count than century()."""
    return F.floor(edge / 100).cast("int")


def bin_mid_year(ordinal: Column, first_edge: int = -800) -> Column:
    return F.lit(first_edge + BIN_YEARS / 2) + BIN_YEARS * ordinal


def plane_x(lon: Column, lat: Column | None = None) -> Column:
    """Kilometres east on a plane that is true at TRUE_LATITUDE."""
    return F.radians(lon) * EARTH_KM * F.cos(F.radians(F.lit(TRUE_LATITUDE)))


def plane_y(lat: Column) -> Column:
    return F.radians(lat) * EARTH_KM


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def entropy_bits(p: Column) -> Column:
    """Binary entropy, p kept off 0 and 1 by 1e-12."""
    q = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17; off by less than 7.5e-8."""
    z = F.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def hue_color(index: Column, lightness: float = 0.5, saturation: float = 0.6) -> Column:
    """A hex colour a golden angle on for each index."""
    hue = F.pmod(index * 137.508, F.lit(360.0)) / 60
    chroma = (1 - abs(2 * lightness - 1)) * saturation

    def part(shift: int) -> Column:
        k = F.pmod(hue + shift, F.lit(6.0))
        v = lightness - chroma / 2 + chroma * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(k - 3) - 1))
        return F.lower(F.lpad(F.hex(F.bround(v * 255).cast("int")), 2, "0"))

    return F.concat(F.lit("#"), part(0), part(4), part(2))


def word_count(c: Column) -> Column:
    """Words after markup is gone."""
    bare = F.regexp_replace(c, r"<[^>]*>|\\[a-zA-Z]+|[{}$]", " ")
    return F.size(F.filter(F.split(bare, r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))


# Marks in place names, and words that tell what a place is (the first at the start of a name or its last part).
UNCERTAIN = r"(?U)\s*\(\s*\?\s*\)\s*$|\s*\?\s*$"
FOUND_WRITTEN = r"(?iU)\s*\[\s*found\s*&\s*written\s*\]\s*"
TOMB = r"(?i)^(t\b|t\.|tomba|tomb\b|tumulo|sepolcr|grave\b|hypogeum)"
NECROPOLIS = r"(?i)necropol|cimitero|cemeter|sepolcret"


def place_flags(name: Column) -> Column:
    """struct(name, uncertain, found): a question mark at the end and '[found & written]' lifted out of a place name."""
    bare = F.regexp_replace(name, FOUND_WRITTEN, " ")
    clean = F.regexp_replace(F.regexp_replace(bare, UNCERTAIN, ""), r"(?U)\s+", " ")
    clean = F.regexp_replace(clean, "^[ ,-]+|[ ,-]+$", "")
    return F.struct(F.when(clean == "", F.trim(name)).otherwise(clean).alias("name"), bare.rlike(UNCERTAIN).cast("int").alias("uncertain"), name.rlike(FOUND_WRITTEN).cast("int").alias("found"))


def place_level(name: Column) -> Column:
    """tomb (by the name or its last part), necropolis, locality (a comma or a dash between blanks) or site."""
    tail = F.trim(F.element_at(F.split(name, r"(?U)\s*[,-]\s*"), -1))
    locality = name.contains(",") | name.rlike(r"(?U)\s-\s")
    return F.when(tail.rlike(TOMB) | name.rlike(TOMB), "tomb").when(name.rlike(NECROPOLIS), "necropolis").when(locality, "locality").otherwise("site")


def name_variants(name: Column) -> Column:
    """Slugs by which a place may be known: the whole name, parts between slashes, glosses in their parentheses, parts without them; longer than 2."""
    parts = F.split(name, r"(?U)\s*/\s*")
    glosses = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"\(([^)]*)\)"), F.lit(1))))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)\s*\([^)]*\)", ""))
    slugs = F.transform(F.concat(F.array(name), parts, glosses, bare), slug)
    return F.array_sort(F.array_distinct(F.filter(slugs, lambda s: (F.length(s) > 2) & (s != "unnamed"))))


def code_scheme(code: Column) -> Column:
    return F.when(code.rlike(r"^-?\d+$"), "numeric").otherwise("descriptive")


def first_property(props: Column, *names: str) -> Column:
    """The first non-empty value of a map under one of the names, whatever their case."""
    lowered = F.map_from_entries(F.transform(F.map_entries(props), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    return F.coalesce(*(F.when(F.trim(v) != "", F.trim(v)) for v in (F.try_element_at(lowered, F.lit(n.lower())) for n in names)))
