"""Distances, bearings and turns as column expressions (degrees in, feet out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Feet in a metre, Earth radii, and feet in a degree of the planar model.
FT_PER_M = 3.28084
EARTH_M = 6371000.0
EARTH_FT = 20902231.0
FT_PER_LON = 245000.0
FT_PER_LAT = 364000.0
#: Turn classes in degrees.
TURN_DEG, TURN_HARD_DEG, TURN_SHARP_DEG = 30, 60, 110
COMPASS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")


def _arc(lon1, lat1, lon2, lat2) -> Column:
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * F.asin(F.sqrt(a))


def haversine_ft(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle feet on the metric radius."""
    return EARTH_M * _arc(lon1, lat1, lon2, lat2) * FT_PER_M


def haversine_ft_profile(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle feet on the radius that elevation profiles use."""
    return EARTH_FT * _arc(lon1, lat1, lon2, lat2)


def planar_ft(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Feet on the local plane."""
    return F.sqrt(F.pow((lon2 - lon1) * FT_PER_LON, 2) + F.pow((lat2 - lat1) * FT_PER_LAT, 2))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial compass bearing, 0 to 360."""
    dlon = F.radians(lon2) - F.radians(lon1)
    x = F.sin(dlon) * F.cos(F.radians(lat2))
    y = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360, F.lit(360.0))


def turn_delta(before: Column, after: Column) -> Column:
    """Signed turn, negative to the left."""
    return F.pmod(after - before + 540, F.lit(360.0)) - 180


def axis_angle(a: Column, b: Column) -> Column:
    """Angle between two axes, 0 to 90."""
    d = F.abs(turn_delta(b, a))
    return F.when(d > 90, 180 - d).otherwise(d)


def classify_turn(before: Column, after: Column, circle: Column) -> Column:
    """The words for a turn; traffic circles have their own."""
    delta = turn_delta(before, after)
    size, left = F.abs(delta), delta < 0
    side = F.when(left, "left").otherwise("right")
    at_circle = F.concat(F.when(size >= TURN_SHARP_DEG, "Make a ").otherwise("Turn "), side, F.lit(" at the traffic circle"))
    plain = F.concat(F.when(size >= TURN_SHARP_DEG, "Sharp ").when(size >= TURN_HARD_DEG, "Turn ").otherwise("Slight "), side)
    return F.when(size <= TURN_DEG, "Continue").when(circle, at_circle).otherwise(plain)


def _compass(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in COMPASS]), index.cast("int") + 1)


def heading_name(b: Column) -> Column:
    """The nearest of eight directions, halves rounded up before wrapping."""
    return _compass(F.pmod(F.floor(b / 45 + 0.5), F.lit(8)))


def compass8(b: Column) -> Column:
    """The sector of eight that holds the bearing."""
    return _compass(F.floor(F.pmod(b + 22.5, F.lit(360.0)) / 45))


def sidewalk_side(heading: Column, offset: Column) -> Column:
    """left or right of travel; null within five degrees of the axis."""
    rel = F.pmod(offset - heading, F.lit(360.0))
    return F.when((rel < 5) | (rel > 355) | ((rel > 175) & (rel < 185)), None).when(rel < 180, "right").otherwise("left")


def stop_faces(flags: Column, b: Column) -> Column:
    """Whether bits 4 to 11 of a node's flags hold a stop for traffic on this bearing."""
    sector = F.pmod(F.floor(F.pmod(b, F.lit(360.0)) / 45 + 0.5), F.lit(8)).cast("int")
    return F.getbit(flags.cast("bigint"), sector + 4) == 1


def project(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column, sx: float = 1.0, sy: float = 1.0) -> tuple[Column, Column]:
    """Clamped place along a segment (0 to 1) and distance to it, axes scaled by sx, sy."""
    bx, by, qx, qy = (x1 - x0) * sx, (y1 - y0) * sy, (px - x0) * sx, (py - y0) * sy
    sq = bx * bx + by * by
    t = F.when(sq > 0, F.least(F.greatest((qx * bx + qy * by) / sq, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return t, F.sqrt(F.pow(qx - t * bx, 2) + F.pow(qy - t * by, 2))


def orient(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Sign of the turn a, b, c."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_meet(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether segments ab and cd share a point, touching and overlap included."""
    o1, o2, o3, o4 = orient(*a, *b, *c), orient(*a, *b, *d), orient(*c, *d, *a), orient(*c, *d, *b)

    def on(p, q, r):
        return (r[0] >= F.least(p[0], q[0])) & (r[0] <= F.greatest(p[0], q[0])) & (r[1] >= F.least(p[1], q[1])) & (r[1] <= F.greatest(p[1], q[1]))

    return (
        ((o1 * o2 < 0) & (o3 * o4 < 0))
        | ((o1 == 0) & on(a, b, c)) | ((o2 == 0) & on(a, b, d)) | ((o3 == 0) & on(c, d, a)) | ((o4 == 0) & on(c, d, b))
    )


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether the interiors of ab and cd cross in one point."""
    return (orient(*a, *b, *c) * orient(*a, *b, *d) < 0) & (orient(*c, *d, *a) * orient(*c, *d, *b) < 0)


def in_rings(px: Column, py: Column, rings: Column) -> Column:
    """Point in polygon by even-odd crossings; rings: array of arrays of struct(lon, lat), closed or not."""

    def ring_crossings(ring):
        return F.aggregate(
            F.sequence(F.lit(1), F.size(ring)),
            F.lit(False),
            lambda odd, i: odd != _edge_crossed(px, py, F.element_at(ring, i), F.element_at(ring, F.when(i == F.size(ring), 1).otherwise(i + 1))),
        )

    return F.aggregate(rings, F.lit(False), lambda odd, ring: odd != ring_crossings(ring))


def _edge_crossed(px, py, p, q) -> Column:
    spans = (p["lat"] > py) != (q["lat"] > py)
    at = p["lon"] + (py - p["lat"]) * (q["lon"] - p["lon"]) / F.when(q["lat"] != p["lat"], q["lat"] - p["lat"])
    return F.coalesce(spans & (px < at), F.lit(False))


def polyline_ft(points: Column, length=haversine_ft) -> Column:
    """Length of an array of struct(lon, lat)."""
    steps = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)), lambda p, q: length(p["lon"], p["lat"], q["lon"], q["lat"]))
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x))


def running_ft(points: Column, length=haversine_ft) -> Column:
    """Distance from the start at every vertex."""
    return F.transform(points, lambda _, i: polyline_ft(F.slice(points, 1, i + 1), length))


def point_at(points: Column, share: Column) -> Column:
    """struct(lon, lat) at a share of the length, measured in degrees."""
    degrees = lambda a, b, c, d: F.sqrt(F.pow(c - a, 2) + F.pow(d - b, 2))
    return point_at_distance(points, running_ft(points, degrees), share * polyline_ft(points, degrees))


def point_at_distance(points: Column, along: Column, target: Column) -> Column:
    """struct(lon, lat) at a distance, clamped to the ends; ``along``: distance at every vertex."""
    n = F.size(points)
    k = F.greatest(F.least(F.size(F.filter(along, lambda d: d <= target)), n - 1), F.lit(1))
    p, q, a, b = F.element_at(points, k), F.element_at(points, k + 1), F.element_at(along, k), F.element_at(along, k + 1)
    t = F.least(F.greatest(F.when(b > a, (target - a) / (b - a)).otherwise(F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.struct((p["lon"] + t * (q["lon"] - p["lon"])).alias("lon"), (p["lat"] + t * (q["lat"] - p["lat"])).alias("lat"))


def slice_to_end(points: Column, place: Column, leg: Column, forward: bool) -> Column:
    """The line from ``place``, a point on its ``leg``-th piece (from 1), on to its end, or back to its beginning."""
    rest = F.slice(points, leg + 1, F.size(points)) if forward else F.reverse(F.slice(points, 1, leg))
    return F.concat(F.array(place), rest)


def inside_parts(x0: Column, y0: Column, x1: Column, y1: Column, rings: Column) -> Column:
    """Shares [t0, t1] of a segment that lie in a polygon: cut where it crosses an edge, kept where the middle is inside.

    A segment whose box lies beside the polygon's has none, which is told without a look at the edges.
    """

    def cut(p, q):
        den = (x1 - x0) * (q["lat"] - p["lat"]) - (y1 - y0) * (q["lon"] - p["lon"])
        t = ((p["lon"] - x0) * (q["lat"] - p["lat"]) - (p["lat"] - y0) * (q["lon"] - p["lon"])) / den
        u = ((p["lon"] - x0) * (y1 - y0) - (p["lat"] - y0) * (x1 - x0)) / den
        return F.when((den != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1), t)

    ends = lambda ring: F.transform(ring, lambda p, i: cut(p, F.get(ring, F.when(i == F.size(ring) - 1, 0).otherwise(i + 1))))
    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.array_compact(F.flatten(F.transform(rings, ends)))))
    middle = lambda s, a, b: a + (s["t0"] + s["t1"]) / 2 * (b - a)

    def kept(c):
        spans = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c)), lambda a, b: F.struct(a.alias("t0"), b.alias("t1")))
        return F.filter(spans, lambda s: (s["t1"] > s["t0"]) & in_rings(middle(s, x0, x1), middle(s, y0, y1), rings))

    # cut once, as a lambda variable
    parts = F.flatten(F.transform(F.array(cuts), kept))
    points = F.flatten(rings)

    def beside(a: Column, b: Column, name: str) -> Column:
        low, high = F.array_min(points[name]), F.array_max(points[name])
        # where an edge is met is rounded: a part in 10^9 is allowed for
        slack = (F.abs(low) + F.abs(high)) * 1e-9
        return (F.greatest(a, b) < low - slack) | (F.least(a, b) > high + slack)

    none = F.array().cast("array<struct<t0:double,t1:double>>")
    return F.when(F.coalesce(beside(x0, x1, "lon") | beside(y0, y1, "lat"), F.lit(False)), none).otherwise(parts)


def clip_lines(lines: DataFrame, rings: Column, key: str, points: str = "points") -> DataFrame:
    """The parts of lines inside a polygon with holes: key, part (from 0 along the line), points.

    ``points``: array of struct(lon, lat). Every leg is cut where it crosses an edge, and pieces
    that follow one another are joined again, so a line that only touches the polygon from inside,
    or meets a corner, stays whole. What runs along an edge counts by the rule of in_rings(). Lines of
    fewer than two points, and null ones, have no part; ``key`` is one line each, so lines of a
    feature of several need keys of their own.
    """
    n = F.size(points)
    pair = F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    legs = lines.filter(n > 1).select(key, F.posexplode(pair).alias("leg", "s")).select(key, "leg", F.col("s.p").alias("p"), F.col("s.q").alias("q"))
    spans = legs.select(key, "leg", "p", "q", F.inline(inside_parts(F.col("p.lon"), F.col("p.lat"), F.col("q.lon"), F.col("q.lat"), rings)))
    w = Window.partitionBy(key).orderBy("leg", "t0")
    before, end = F.lag("leg").over(w), F.lag("t1").over(w)
    follows = ((before == F.col("leg")) & (end == F.col("t0"))) | ((before == F.col("leg") - 1) & (end == 1) & (F.col("t0") == 0))
    at = lambda t: F.when(t == 0, F.col("p")).when(t == 1, F.col("q")).otherwise(F.struct(*[(F.col(f"p.{c}") + t * (F.col(f"q.{c}") - F.col(f"p.{c}"))).alias(c) for c in ("lon", "lat")]))
    placed = spans.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("new").over(w) - 1)
    rows = placed.select(key, "part", F.struct("leg", "t0", at(F.col("t0")).alias("a"), at(F.col("t1")).alias("b")).alias("x"))
    parts = rows.groupBy(key, "part").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return parts.select(key, "part", F.concat(F.array(F.get("xs", F.lit(0))["a"]), F.transform("xs", lambda x: x["b"])).alias("points"))


def rounded(x: Column, places: int) -> Column:
    """``x`` to decimal places as SQL engines that scale doubles do it: halves of the scaled double go away from zero.

    Spark's round() goes by the shortest decimal text of the double instead, so the two part at what
    only looks like a half.
    """
    scale = float(10**places)
    y = F.abs(x) * scale
    return F.signum(x) * (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / scale
