"""Map-feature tags and attributes as column expressions; tags are MAP<STRING, STRING>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Highway classes.
NEVER = ("motorway", "motorway_link", "trunk", "trunk_link", "construction", "raceway", "proposed", "abandoned", "razed")
ROADS = (
    "residential", "tertiary", "tertiary_link", "secondary", "secondary_link",
    "primary", "primary_link", "unclassified", "living_street",
)
RESTRICTED = ("path", "footway", "track", "pedestrian")
#: Keys that make a named feature a point of interest, in order.
POI_KEYS = ("amenity", "leisure", "tourism", "shop", "public_transport", "railway", "aeroway", "office", "place", "natural", "historic")
#: Facility classes with their rank (lower is better) and the wider network's names for them.
FACILITY_RANK = {"BKF-NGW": 0, "BKF-PBL": 0, "BKF-OFFST": 0, "BKF-BBL": 1, "BKF-BL": 2, "BKF-CLMB": 3, "BKF-SHW": 3}
NETWORK_CLASS = {
    "Existing Bike+ - Non-Arterial": "BKF-NGW",
    "Existing Bike+ - Arterial": "BKF-PBL",
    "Existing Multi-Use Trail": "BKF-OFFST",
}
PROPOSED = (
    "Proposed Bike+ - Arterial", "Proposed Bike+ - Upgrade, Arterial", "Proposed Bike+ - Non-Arterial",
    "Proposed Multi-Use Trail", "Non-Bike+ Planned",
)
#: Structure categories by priority, and bits of an edge's flags.
SOURCE_PRIORITY = ("bridge", "tunnel", "layered", "embankment", "cutting", "covered", "indoor")
EDGE_BITS = {
    "has_centerline": 1, "is_oneway": 2, "is_bridge": 4, "is_tunnel": 8, "is_covered": 16, "is_indoor": 32,
    "is_crossing": 64, "is_approach": 128, "is_embankment": 256, "is_cutting": 512, "is_sidewalk": 1024,
}
#: Bit of each facing of a stop sign.
FACING_BITS = {"N": 0, "NE": 1, "E": 2, "SE": 3, "S": 4, "SW": 5, "W": 6, "NW": 7}


def is_never(tags: Column) -> Column:
    return F.coalesce(tags["highway"].isin(*NEVER), F.lit(False))


def is_sidewalk(tags: Column) -> Column:
    return F.coalesce((tags["highway"] == "footway") & tags["footway"].isin("sidewalk", "crossing"), F.lit(False))


def is_routable(tags: Column) -> Column:
    """Whether a bicycle may use the way; the first rule that applies decides."""
    hw, bike = tags["highway"], tags["bicycle"]
    rule = (
        F.when(hw.isNull() | (hw == "") | hw.isin(*NEVER), False)
        .when(bike == "no", False)
        .when(tags["access"].isin("no", "private") & ~F.coalesce(bike.isin("yes", "designated", "permissive"), F.lit(False)), False)
        .when(hw.isin(*ROADS, "cycleway") | is_sidewalk(tags), True)
        .when(hw.isin(*RESTRICTED, "service"), F.coalesce(bike.isin("yes", "designated"), F.lit(False)))
    )
    return F.coalesce(rule, F.lit(False))


def is_circle(tags: Column) -> Column:
    return F.coalesce(tags["highway"] == "mini_roundabout", F.lit(False)) | F.coalesce(tags["junction"].isin("mini_roundabout", "roundabout", "circular"), F.lit(False))


def facility_class(status: Column, category: Column) -> Column:
    """The class of a facility in service; null for any other."""
    return F.when(status.isin("INSVC", "PLNRECON") & category.isin(*FACILITY_RANK), category)


def network_class(category: Column) -> Column:
    """The class of an existing part of the wider network."""
    return _lookup(NETWORK_CLASS, category)


def facility_rank(category: Column) -> Column:
    return _lookup(FACILITY_RANK, category)


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def is_installed(status: Column) -> Column:
    return F.coalesce(status.isin("INSVC", "PLNRECON"), F.lit(False))


def under_construction(status: Column) -> Column:
    return F.coalesce(status == "UNDERCONS", F.lit(False))


def is_proposed(category: Column) -> Column:
    return F.coalesce(category.isin(*PROPOSED), F.lit(False))


#: The groups of facility classes that map layers show.
LAYER_GROUPS = {"aaa": ("BKF-NGW", "BKF-PBL", "BKF-OFFST"), "bbl": ("BKF-BBL",), "bl": ("BKF-BL",), "narrow": ("BKF-CLMB", "BKF-SHW")}


def facility_layer(status: Column, category: Column) -> Column:
    """The layer a facility is drawn in, such as aaa or construction-bl; null if in none."""
    group = F.coalesce(*[F.when(category.isin(*c), g) for g, c in LAYER_GROUPS.items()])
    return F.when(is_installed(status), group).when(under_construction(status), F.concat(F.lit("construction-"), group))


def poi_category(tags: Column) -> Column:
    """key=value of the first key that classifies the feature."""
    return F.coalesce(*[F.when((tags[k] != "") & (tags[k] != "no"), F.concat(F.lit(f"{k}="), tags[k])) for k in POI_KEYS])


def address_label(tags: Column) -> Column:
    """House number and street, both needed."""
    number, street = tags["addr:housenumber"], tags["addr:street"]
    return F.when((number != "") & (street != ""), F.concat_ws(" ", F.trim(number), F.trim(street)))


def center(kind: Column, own: Column, middle: Column) -> Column:
    """A node's own position, another element's centre."""
    return F.when(kind == "node", own).otherwise(middle)


def lanes_of_width(width: Column) -> Column:
    """Lanes of a street width in feet; null for none, text or none positive."""
    w = width.cast("string").try_cast("double")
    return F.when(w > 0, F.greatest(F.lit(1.0), (w - 7.5) / 10))


def lanes_of_class(arterial: Column) -> Column:
    """The usual lanes of an arterial class."""
    return F.coalesce(_lookup({0: 2.0, 1: 4.0, 2: 3.0, 3: 2.5, 9: 3.0}, arterial.cast("string").try_cast("int")), F.lit(2.0))


def lanes(width: Column, arterial: Column) -> Column:
    return F.coalesce(lanes_of_width(width), lanes_of_class(arterial))


def direction(tag: Column, street: Column) -> Column:
    """forward, reverse or bidir: an explicit tag first, then the street's."""
    return (
        F.when(tag.isin("-1", "reverse"), "reverse")
        .when(tag.isin("yes", "true", "1"), "forward")
        .when(tag.isin("no", "false", "0"), "bidir")
        .when(street == "Y", "forward")
        .otherwise("bidir")
    )


def is_set(tag: Column) -> Column:
    """A tag that is there and not no."""
    return ~F.lower(F.trim(F.coalesce(tag, F.lit("")))).isin("", "no")


def whole_number(tag: Column) -> Column:
    """An integer, or null."""
    t = F.trim(tag)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))


def source_category(bridge, tunnel, layer, embankment, cutting, covered, indoor) -> Column:
    """The structure an edge belongs to, by priority; null for none."""
    return (
        F.when(bridge, "bridge").when(tunnel, "tunnel").when(layer != 0, "layered").when(embankment, "embankment")
        .when(cutting, "cutting").when(covered, "covered").when(indoor, "indoor")
    )


def source_priority(category: Column) -> Column:
    return _lookup({c: i for i, c in enumerate(SOURCE_PRIORITY)}, category)


def has_level(bridge, tunnel, covered, indoor, layer) -> Column:
    """Whether an edge says which level it is on; layer 0 counts."""
    return bridge | tunnel | covered | indoor | layer.isNotNull()


def needs_correction(flags: Column, layer: Column) -> Column:
    """Bridges, tunnels, crossings and approaches; layers without a structure of their own."""
    hard, own = 4 | 8 | 64 | 128, 4 | 8 | 256 | 512
    level = F.coalesce(layer != 0, F.lit(False)) & (flags.bitwiseAND(F.lit(own)) == 0)
    return (flags.bitwiseAND(F.lit(hard)) != 0) | level


def edge_category(flags: Column, layer: Column) -> Column:
    """Why an edge is corrected: bridge, tunnel, layered(+n), untagged-crossing, approach or other."""
    bit = lambda b: flags.bitwiseAND(F.lit(b)) != 0
    return (
        F.when(bit(4), "bridge").when(bit(8), "tunnel").when(layer != 0, F.format_string("layered(%+d)", layer))
        .when(bit(64), "untagged-crossing").when(bit(128), "approach").otherwise("other")
    )


def pack_flags(columns: dict[str, Column]) -> Column:
    """EDGE_BITS of the given booleans as one integer."""
    out = F.lit(0)
    for name, col in columns.items():
        out = out.bitwiseOR(F.when(col, F.lit(EDGE_BITS[name])).otherwise(F.lit(0)))
    return out


def by_zoom(zoom: Column, stops: list[tuple[float, float]]) -> Column:
    """Linear interpolation between stops, constant outside."""
    out = F.when(zoom <= stops[0][0], F.lit(float(stops[0][1])))
    for (z0, v0), (z1, v1) in zip(stops, stops[1:], strict=False):
        out = out.when(zoom <= z1, v0 + (zoom - z0) * (v1 - v0) / (z1 - z0))
    return out.otherwise(F.lit(float(stops[-1][1])))


def slope_class(percent: Column) -> Column:
    """Class 0 to 6 of a slope's size: from 0, 1, 3, 6, 10, 15 and 20 percent."""
    size = F.abs(percent)
    out = F.when(size < 1, 0)
    for k, top in enumerate((3, 6, 10, 15, 20), 1):
        out = out.when(size < top, k)
    return out.otherwise(6)
