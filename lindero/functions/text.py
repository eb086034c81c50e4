"""Text columns: cleaning, number reading, types, addresses, identifiers. Null in, null out unless said otherwise."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable
from functools import cache
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words for property types, in the order in which they are looked for.
PROPERTY_WORDS = [
    ("casa", "casa"), ("casas", "casa"), ("house", "casa"), ("departamento", "departamento"), ("departamentos", "departamento"),
    ("depa", "departamento"), ("apartment", "departamento"), ("terreno", "terreno"), ("terrenos", "terreno"), ("land", "terreno"),
    ("local", "local"), ("locales", "local"), ("bodega", "bodega"), ("bodegas", "bodega"), ("warehouse", "bodega"),
]
#: Words for operations, in that order too.
OPERATION_WORDS = [("venta", "venta"), ("sale", "venta"), ("renta", "renta"), ("rent", "renta")]
#: Accented letters and what they fold to.
ACCENTS, PLAIN = "áéíóúüñ", "aeiouun"
#: Query parameters that say where a visitor came from.
TRACKING = ("utm_", "fbclid", "gclid")


def filled(c: Column) -> Column:
    """Null for an empty text. F.nullif() would write its argument down twice, so nested ones are computed many times over."""
    return F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; blank is null."""
    return filled(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTS, PLAIN)


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Lower-case letters of the Latin blocks with their base letters, and those that stand for several."""
    several = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij"}
    single = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ħ": "h", "ı": "i"}
    for point in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(point).lower())[0]
        if chr(point).islower() and base != chr(point) and base.isascii():
            single.setdefault(chr(point), base)
    single = {k: v for k, v in single.items() if k not in several}
    return "".join(single), "".join(single.values()), several


def ascii_fold(c: Column) -> Column:
    """Lower case, Latin letters as ASCII letters."""
    letters, plain, several = _folds()
    out = F.translate(F.lower(c), letters, plain)
    for k, v in several.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def match_key(c: Column) -> Column:
    """For comparisons of places: folded, other characters as one blank, never null."""
    return F.coalesce(F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " ")), F.lit(""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def caseless(c: Column) -> Column:
    """Lower case, with the letters that patterns with (?iu) take for i or s as these: Latin words that such a pattern finds are in here."""
    return F.lower(F.translate(c, "\u0130\u0131\u017f", "iis"))


def property_type(c: Column) -> Column:
    """The type of the first word of the list that the text has, `otro` if it has none, null if it is blank."""

    def kind_of(text: Column) -> Column:
        found = F.when(text.isNull(), F.lit(None).cast("string"))
        for word, kind in PROPERTY_WORDS:
            found = found.when(text.contains(word) & text.rlike(rf"(?U)\b{word}\b"), kind)  # few texts need a pattern's look
        return found.otherwise("otro")

    return once(F.lower(clean_text(c)), kind_of)


def operation(c: Column) -> Column:
    """By substring, sale before rent; `desconocido` otherwise."""

    def kind_of(text: Column) -> Column:
        found = F.when(F.lit(False), "")
        for word, kind in OPERATION_WORDS:
            found = found.when(text.contains(word), kind)
        return found.otherwise("desconocido")

    return once(F.lower(clean_text(c)), kind_of)


def price(c: Column) -> Column:
    """struct(price, currency). A comma with two digits after it, where there is no point, is a decimal comma."""

    def amount(digits: Column) -> Column:
        decimal_comma = ~digits.contains(".") & digits.rlike(",[0-9]{2}$")
        plain = F.when(decimal_comma, F.concat(F.replace(F.regexp_replace(digits, ",[0-9]{2}$", ""), F.lit(","), F.lit("")), F.lit("."), F.right(digits, F.lit(2)))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
        return filled(plain).try_cast("double")

    def told(text: Column) -> Column:
        currency = once(F.upper(text), lambda upper: F.when(upper.rlike(r"USD|US\$|DOL"), "USD").when(upper.rlike(r"MXN|MN|\$"), "MXN"))
        return F.struct(once(F.regexp_replace(text, "[^0-9.,]", ""), amount).alias("price"), currency.alias("currency"))

    return once(clean_text(c), told)


def _first(c: Column, pattern: str) -> Column:
    return filled(F.regexp_extract(clean_text(c), pattern, 0))


def area(c: Column) -> Column:
    """The first number; commas only group digits."""
    return _first(F.replace(c, F.lit(","), F.lit("")), r"[0-9]+(\.[0-9]+)?").try_cast("double")


def whole(c: Column) -> Column:
    return _first(c, r"-?\d+").try_cast("long")


def number(c: Column) -> Column:
    """With a decimal point or comma."""
    return F.replace(_first(c, r"-?\d+([,.]\d+)?"), F.lit(","), F.lit(".")).try_cast("double")


def census_number(c: Column) -> Column:
    """Census text, in which *, N/D and blanks stand for what is not told."""
    return F.when(~F.trim(c).isin("*", "N/D", ""), F.trim(c)).try_cast("double")


def code(c: Column, width: int) -> Column:
    """Padded with zeros on the left; a longer one stays whole."""
    text = F.trim(c.cast("string"))
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def flags(c: Column) -> Column:
    """A JSON list of texts; anything else is an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def canonical_url(urls: pd.Series) -> pd.Series:
    """Lower-case scheme and host, no tracking or blank parameters, no fragment, no slash at the end. Percent codes follow the standard library."""

    def one(url):
        if url is None:
            return None
        p = urlsplit(url.strip())
        kept = [(k, v) for k, v in parse_qsl(p.query) if not k.lower().startswith(TRACKING)]
        return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/") or "/", urlencode(kept), ""))

    return urls.map(one)


def source_id(canonical: Column) -> Column:
    """The last part of a canonical URL's path if it is longer than three letters, else the URL's SHA-1."""
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(canonical, r"\?.*$", ""), r"^[a-z][a-z0-9+.-]*://[^/]*", ""), "/"), -1)
    return F.when(F.length(last) > 3, last).otherwise(F.sha1(canonical))


@F.pandas_udf(StringType())
def python_fingerprint(latitude: pd.Series, longitude: pd.Series, price_: pd.Series, land: pd.Series, built: pd.Series, bedrooms: pd.Series, bathrooms: pd.Series, parking: pd.Series) -> pd.Series:
    """SHA-1 of sorted compact JSON of the rounded fields; null for fewer than three. Python's own rounding and number text are part of the value."""
    import json

    places = {"latitude": 5, "longitude": 5, "price": 0, "land_area_m2": 1, "construction_area_m2": 1}
    names = [*places, "bedrooms", "bathrooms", "parking_spaces"]

    def one(values):
        held = {}
        for name, v in zip(names, values, strict=True):
            if v is None or v != v:
                continue
            held[name] = round(float(v), places[name]) if name in places else int(v) if name != "bathrooms" else float(v)
        return hashlib.sha1(json.dumps(held, sort_keys=True, separators=(",", ":")).encode()).hexdigest() if len(held) > 2 else None

    columns = (latitude, longitude, price_, land, built, bedrooms, bathrooms, parking)
    return pd.Series([one(v) for v in zip(*columns, strict=True)], dtype=object)
