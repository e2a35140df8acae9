"""Geospatial column expressions: Web Mercator, tiles, distances, folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 256
EARTH_M = 6_371_000.0


def world(zoom: int) -> float:
    return float(TILE << zoom)


def pixel_x(lon: Column, zoom: int) -> Column:
    return (lon + 180.0) / 360.0 * world(zoom)


def pixel_y(lat: Column, zoom: int) -> Column:
    s = F.sin(F.radians(lat))
    return (F.lit(0.5) - F.ln((1 + s) / (1 - s)) / (4 * F.pi())) * world(zoom)


def index_x(lon: Column, zoom: int) -> Column:
    """Pixel centres are whole numbers here."""
    return pixel_x(lon, zoom) - 0.5


def index_y(lat: Column, zoom: int) -> Column:
    return pixel_y(lat, zoom) - 0.5


def lon_of(x: Column, zoom: int) -> Column:
    return x / world(zoom) * 360.0 - 180.0


def lat_of(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / world(zoom)))))


def metres_per_pixel(lat: Column, zoom: int) -> Column:
    return F.cos(F.radians(lat)) * (2 * 3.141592653589793 * 6_378_137.0 / world(zoom))


def floor_div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def region_corner(g: Column) -> Column:
    """First tile of the two along an axis that keep the point half a tile inside."""
    return F.floor((g - 128) / 256).cast("int")


def climate(lat: Column) -> Column:
    a = F.abs(lat)
    return F.when(a < 23.5, "tropical").when(a < 35, "subtropical").otherwise("midlat")


def satellite_covers(lat: Column, lon: Column) -> Column:
    away = F.abs((lon - 140.7 + 540.0) % 360.0 - 180.0)
    return (F.abs(lat) <= 60) & (away <= 65)


def snap(v: Column) -> Column:
    """Nearest quarter degree, halves away from zero."""
    return F.round(v / 0.25) * 0.25


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def fold(lat: Column, lon: Column) -> Column:
    cell = F.concat(F.floor(lat / 15).cast("string"), F.lit(","), F.floor(lon / 15).cast("string"))
    return (F.crc32(cell.cast("binary")) % 2).cast("int")


def speed_kmh(dx: Column, dy: Column, km_per_pixel: Column) -> Column:
    return F.hypot(dx, dy) * km_per_pixel * 60


def heading(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north."""
    return (F.degrees(F.atan2(dx, -dy)) + 360) % 360


def compass(degrees: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.round(F.pmod(degrees, F.lit(360)) / 45) % 8 + 1).cast("int"))


def tiles_overlap(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether the 3x3 mosaics around two tiles share one."""
    return F.greatest(F.abs(ax - bx), F.abs(ay - by)) < 3


def square(low: int, high: int) -> Column:
    """Array of (i, j) offsets of a square of tiles, row by row."""
    span = range(low, high + 1)
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in span for i in span])


def in_world(x: Column, y: Column, zoom: int) -> Column:
    return x.between(0, (1 << zoom) - 1) & y.between(0, (1 << zoom) - 1)


def tile_centre(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """(lat, lon) of a tile's middle."""
    return lat_of((y + 0.5) * TILE, zoom), lon_of((x + 0.5) * TILE, zoom)


def satellite_pixel(v: Column) -> Column:
    """A radar pixel (zoom 7) in satellite pixels (zoom 5)."""
    return v / 4


def satellite_tiles(x: Column, y: Column, margin: int) -> Column:
    """Array of the satellite tiles (x, y) under the 3x3 radar tiles around a centre, with a margin in
    satellite pixels: x goes round the world, y ends at its edges, each once."""
    low = lambda v: F.floor(((v - 1) * (TILE // 4) - margin) / TILE)
    high = lambda v: F.floor(((v + 2) * (TILE // 4) + margin - 1) / TILE)
    columns = F.transform(F.sequence(low(x), high(x)), lambda i: F.pmod(i, F.lit(32)))
    rows = F.filter(F.sequence(low(y), high(y)), lambda j: j.between(0, 31))
    pairs = F.transform(columns, lambda i: F.transform(rows, lambda j: F.struct(i.cast("int").alias("x"), j.cast("int").alias("y"))))
    return F.array_distinct(F.flatten(pairs))


def parsed_place(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(lat, lon) of two texts, to 1e-4; both null unless both are numbers within +-85 and +-180."""
    a, b = lat.try_cast("double"), lon.try_cast("double")
    fits = a.between(-85, 85) & b.between(-180, 180)
    return F.when(fits, F.round(a, 4)), F.when(fits, F.round(b, 4))
