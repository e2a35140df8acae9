"""Place text: coordinates, suggestions, lists and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"([-+]?\d+(?:\.\d+)?)"
COORDINATES = rf"^\s*{_NUMBER}\s*[,; ]\s*{_NUMBER}\s*$"


def coordinates(text: Column) -> tuple[Column, Column]:
    """(lat, lon) of "lat, lon" within +-85 and +-180; both null otherwise."""
    part = lambda i: F.regexp_extract(text, COORDINATES, i).try_cast("double")
    fits = part(1).between(-85, 85) & part(2).between(-180, 180)
    return F.when(fits, part(1)), F.when(fits, part(2))


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def preferred(text: Column) -> Column:
    """The lower-case entries of a comma list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def joined_parts(name: Column, parts: Column) -> Column:
    """The parts joined by ', ', each once whatever its case, without blanks and the name."""
    low = F.transform(parts, F.lower)
    first = F.filter(parts, lambda x, i: (F.trim(x) != "") & (F.lower(x) != F.lower(name)) & (F.array_position(low, F.lower(x)) == i + 1))
    return F.array_join(first, ", ")


def query_value(url: Column, key: str) -> Column:
    """A decoded value of a URL's query, null if absent."""
    return F.try_url_decode(F.nullif(F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1), F.lit("")))


#: Fixed values, in the order in which they are asked: keys of a map URL's query that may hold coordinates.
PLACE_KEYS = ("q", "query", "ll", "center", "destination", "daddr")
_PIN = rf"!3d{_NUMBER}!4d{_NUMBER}"
_VIEW = rf"@{_NUMBER},{_NUMBER}"


def _pair(text: Column, pattern: str) -> Column:
    a, b = (F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(a.between(-85, 85) & b.between(-180, 180), F.struct(a.alias("lat"), b.alias("lon")))


def map_location(url: Column) -> Column:
    """Struct (lat, lon) of a map URL: its pin, else coordinates in its query, else its viewport."""
    whole = F.coalesce(F.try_url_decode(url), url)
    asked = [_pair(query_value(url, k), COORDINATES) for k in PLACE_KEYS]
    return F.coalesce(_pair(whole, _PIN), *asked, _pair(whole, _VIEW))


def place_name(url: Column) -> Column:
    """The name in a map URL's path, else a q or query that is none but words; null if neither."""
    named = lambda t: F.when((t != "") & ~t.rlike(COORDINATES), t)
    in_path = F.trim(F.replace(F.coalesce(F.try_url_decode(F.regexp_extract(url, r"/place/([^/?#]+)", 1)), F.lit("")), F.lit("+"), F.lit(" ")))
    return F.coalesce(named(in_path), *[named(F.trim(query_value(url, k))) for k in ("q", "query")])


def input_kind(text: Column) -> Column:
    """What a place input is: coordinates, a link (anywhere in it) or words to search for."""
    return F.when(F.trim(text).rlike(COORDINATES), "coordinates").when(text.rlike(r"https?://\S+"), "link").when(F.trim(text) == "", "none").otherwise("words")
