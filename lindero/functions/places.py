"""Places: what an address asks a geocoder, how precise its answers are, and what points of interest tell.

Answers come as columns: `address` and `tags` are maps of texts. An absent, null or blank entry counts as not given.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lindero.functions import text

#: How precise an answer is, from the most precise on; the kinds of address that say so, and the address parts that do.
PRECISIONS = [
    ("street", ["road", "street"], ["road"]),
    ("postal_code", ["postcode"], ["postcode"]),
    ("neighborhood", ["neighbourhood", "suburb", "quarter", "city_district"], ["neighbourhood", "suburb", "quarter", "city_district"]),
    ("locality", ["town", "village", "city"], ["town", "village", "city"]),
    ("municipality", ["municipality", "county"], ["municipality", "county"]),
    ("state", ["state"], ["state"]),
]
#: Types of a street besides.
STREET_TYPES = ["residential", "road"]
#: Categories of points of interest, their tags, and what one without a name is called.
CATEGORIES = [
    ("schools", [("amenity", "school")], "Escuela"),
    ("hospitals", [("amenity", "hospital")], "Hospital"),
    ("parks", [("leisure", "park")], "Parque"),
    ("supermarkets", [("shop", "supermarket")], "Supermercado"),
    ("bus_stops", [("highway", "bus_stop"), ("public_transport", "platform"), ("public_transport", "stop_position")], "Transporte"),
]
#: Tags that tell the kind, and those that name, in order of preference.
KIND_TAGS, NAME_TAGS = ["amenity", "leisure", "shop", "highway", "public_transport"], ["name", "name:es", "brand", "operator"]


def _entry(of: Column, key: str) -> Column:
    return F.nullif(F.trim(F.try_element_at(of, F.lit(key))), F.lit(""))


def _any(tests: list[Column]) -> Column:
    return reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests])


def query_key(c: Column) -> Column:
    """What two geocoder queries share if they ask the same; never null."""
    spaced = F.regexp_replace(F.regexp_replace(text.fold(F.trim(c)), r"(?U)\s+", " "), r"\s*,\s*", ", ")
    return F.coalesce(F.btrim(F.regexp_replace(spaced, "[^a-z0-9, .-]", ""), F.lit(" ,")), F.lit(""))


def query(address: Column, neighborhood: Column, locality: Column, municipality: Column, state: Column, postal_code: Column, told: Column) -> Column:
    """The geocoder query of a listing: its parts in this order without those that another one holds, and the country. The postal code counts if the listing's own texts (told) have it."""
    parts = F.array(address, neighborhood, locality, municipality, state, F.when(told.contains(postal_code), postal_code))
    given = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    within = lambda held, x: F.exists(held, lambda y: query_key(y).contains(query_key(x)) | query_key(x).contains(query_key(y)))
    kept = F.aggregate(given, F.array().cast("array<string>"), lambda held, x: F.when(within(held, x), held).otherwise(F.concat(held, F.array(x))))
    return F.array_join(F.when(F.arrays_overlap(kept, F.array(F.lit("México"), F.lit("Mexico"))), kept).otherwise(F.concat(kept, F.array(F.lit("México")))), ", ")


def precision(address: Column, address_type: Column, place_type: Column) -> Column:
    found = F.when(_entry(address, "house_number").isNotNull() & _entry(address, "road").isNotNull(), "exact_address")
    for name, kinds, parts in PRECISIONS:
        tests = [F.lower(address_type).isin(kinds)] + [_entry(address, p).isNotNull() for p in parts]
        found = found.when(_any(tests + [F.lower(place_type).isin(STREET_TYPES)] * (name == "street")), name)
    return found.otherwise("unknown")


def _bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(text.fold(c), "[^a-z0-9 ]+", " "))


def confirms(address: Column, parts: list[str], expected: Column) -> Column:
    """Whether one of the parts holds the expected name or lies within it; false where nothing is expected."""
    want = _bare(F.nullif(expected, F.lit("")))
    return _any([want.contains(_bare(_entry(address, p))) | _bare(_entry(address, p)).contains(want) for p in parts])


def street_matches(road: Column, street: Column) -> Column:
    """Whether the road has a word of the street that is longer than three letters and no number."""
    words = F.filter(F.split(_bare(street), r"\s+"), lambda w: (F.length(w) > 3) & ~w.rlike("^[0-9]+$"))
    return _any([(road != "") & F.exists(words, lambda w: _bare(road).contains(w))])


def category(tags: Column) -> Column:
    """Of a point of interest; null if it is none that counts."""
    return F.coalesce(*[F.when(_any([F.try_element_at(tags, F.lit(k)) == v for k, v in wanted]), name) for name, wanted, _ in CATEGORIES])


def kind(tags: Column) -> Column:
    return F.coalesce(*[F.concat(F.lit(f"{k}="), _entry(tags, k)) for k in KIND_TAGS], F.lit("unknown"))


def address(tags: Column) -> Column:
    road = F.concat(_entry(tags, "addr:street"), F.coalesce(F.concat(F.lit(" #"), _entry(tags, "addr:housenumber")), F.lit("")))
    return F.nullif(F.concat_ws(", ", road, _entry(tags, "addr:city"), _entry(tags, "addr:state")), F.lit(""))


def name(tags: Column) -> Column:
    """A name to show, from the tags or else the category."""
    label = F.coalesce(*[F.when(category(tags) == n, word) for n, _, word in CATEGORIES], F.lit("POI"))
    return F.coalesce(*[_entry(tags, k) for k in NAME_TAGS], F.concat(label, F.lit(" "), _entry(tags, "ref")), address(tags), label)


def colonia_label(colonia: Column, zone: Column) -> Column:
    number = F.coalesce(F.nullif(F.ltrim(F.replace(colonia, F.lit("COL_"), F.lit("")), F.lit("0")), F.lit("")), colonia)
    return F.concat(F.lit("Colonia "), number, F.coalesce(F.concat(F.lit(" - zona "), F.nullif(zone, F.lit(""))), F.lit("")))


def colonia_of_key(key: Column) -> Column:
    """COL_ and at least two digits; null for a blank key."""
    return F.concat(F.lit("COL_"), text.code(F.nullif(key, F.lit("")), 2))
