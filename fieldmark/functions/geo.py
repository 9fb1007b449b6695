"""Column functions on coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii in km / m.
POLAR_RADIUS_KM = 6356.7523
MERCATOR_RADIUS_M = 6378137.0
# Series terms of the length of one degree in metres.
LAT_TERMS = (111132.954, -559.822, 1.175, -0.0023)
LON_TERMS = (111412.84, -93.5, 0.118)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = POLAR_RADIUS_KM) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    s = F.sin((b - a) / 2)
    t = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = s * s + F.cos(a) * F.cos(b) * t * t
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere; straight-line distance there has no seam at the poles or at 180 degrees."""
    a, o = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)


def lat_degrees(km: Column, radius: float = POLAR_RADIUS_KM) -> Column:
    return km / F.lit(radius) * F.lit(180.0) / F.pi()


def lon_degrees(km: Column, lat: Column, radius: float = POLAR_RADIUS_KM) -> Column:
    return km / (F.lit(radius) * F.cos(F.abs(lat) * F.pi() / F.lit(180.0))) * F.lit(180.0) / F.pi()


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    a = F.radians(lat)
    c0, c2, c4, c6 = (F.lit(v) for v in LAT_TERMS)
    d1, d3, d5 = (F.lit(v) for v in LON_TERMS)
    north = c0 + c2 * F.cos(a * 2) + c4 * F.cos(a * 4) + c6 * F.cos(a * 6)
    east = d1 * F.cos(a) + d3 * F.cos(a * 3) + d5 * F.cos(a * 5)
    return north, east


def box_from_centre(lat: Column, lon: Column, metres_lat: float, metres_lon: float) -> Column:
    north, east = metres_per_degree(lat)
    dy, dx = F.lit(float(metres_lat)) / north, F.lit(float(metres_lon)) / east
    return F.struct((lon - dx).alias("minx"), (lon + dx).alias("maxx"), (lat - dy).alias("miny"), (lat + dy).alias("maxy"))


def box_ring(box: Column) -> Column:
    corners = [("minx", "miny"), ("minx", "maxy"), ("maxx", "maxy"), ("maxx", "miny")]
    return F.array(*[F.struct(box[x].alias("lon"), box[y].alias("lat")) for x, y in corners])


def square_buffer(lat: Column, lon: Column, metres: float) -> Column:
    """Square of half side ``metres`` in spherical Mercator, given back in degrees."""
    r, half = F.lit(MERCATOR_RADIUS_M), F.lit(float(metres))
    x = r * F.radians(lon)
    y = r * F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2))

    def back_lat(v: Column) -> Column:
        return F.degrees(F.lit(2.0) * F.atan(F.exp(v / r)) - F.pi() / 2)

    return F.struct(F.degrees((x - half) / r).alias("minx"), F.degrees((x + half) / r).alias("maxx"),
                    back_lat(y - half).alias("miny"), back_lat(y + half).alias("maxy"))


def sincos(lat: Column, lon: Column, elevation: Column | None = None) -> Column:
    x, y = lon / F.lit(180.0), lat / F.lit(90.0)
    parts = [F.sin(F.pi() * x), F.sin(F.pi() * y), F.cos(F.pi() * x), F.cos(F.pi() * y)]
    if elevation is not None:
        parts.append(elevation / F.lit(5000.0))
    return F.array(*parts)


def strictly_inside(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd test over all rings (holes count), with points on an edge left out."""

    def edges(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(ring, lambda a, i: F.struct(a.alias("a"), F.get(ring, (i + 1) % n).alias("b")))

    def step(state: Column, e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        spans = (ay > lat) != (by > lat)
        # NULL-safe: the quotient is only taken where the edge spans the latitude, so by != ay
        cross = F.when(spans, lon < (bx - ax) * (lat - ay) / F.when(spans, by - ay).otherwise(1.0) + ax).otherwise(False)
        on_edge = (((bx - ax) * (lat - ay) == (by - ay) * (lon - ax))
                   & lon.between(F.least(ax, bx), F.greatest(ax, bx)) & lat.between(F.least(ay, by), F.greatest(ay, by)))
        return F.struct((state["odd"] != cross).alias("odd"), (state["edge"] | on_edge).alias("edge"))

    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("edge"))
    return F.aggregate(F.flatten(F.transform(rings, edges)), start, step, lambda s: s["odd"] & ~s["edge"])


def ring_bounds(rings: Column) -> dict[str, Column]:
    points = F.flatten(rings)
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return {"minx": F.array_min(lon), "maxx": F.array_max(lon), "miny": F.array_min(lat), "maxy": F.array_max(lat)}
