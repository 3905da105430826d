"""Labels and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and their abbreviations, in the order they are tried.
DIRECTIONS = (
    ("Northwest", "NW"), ("Northeast", "NE"), ("Southwest", "SW"), ("Southeast", "SE"),
    ("North", "N"), ("South", "S"), ("East", "E"), ("West", "W"),
)
STREET_WORDS = (
    ("Boulevard", "Blvd"), ("Parkway", "Pkwy"), ("Highway", "Hwy"), ("Terrace", "Ter"), ("Avenue", "Ave"), ("Street", "St"),
    ("Place", "Pl"), ("Drive", "Dr"), ("Court", "Ct"), ("Road", "Rd"), ("Lane", "Ln"),
)
FACILITY_ENDINGS = ("protected bike lane", "bike lane", "bike path", "cycle track", "cycletrack", "cycleway")


def normalize_address(s: Column) -> Column:
    """Abbreviate direction and street words anywhere, in any case."""
    short = _map({k.lower(): v for k, v in DIRECTIONS + STREET_WORDS})
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"\w+|\W+"), 0), lambda w: F.coalesce(short[F.lower(w)], w)), "")


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def abbreviate_label(s: Column) -> Column:
    """Abbreviate a leading direction, the street word at the end (also before a direction), then a trailing direction; case matters."""
    way, street = _map(dict(DIRECTIONS)), _map(dict(STREET_WORDS))
    ways, streets = ("|".join(full for full, _ in words) for words in (DIRECTIONS, STREET_WORDS))
    part = lambda pattern, k: F.regexp_extract(s, pattern, k)
    lead = rf"(?s)^({ways}) (.*)$"
    s = F.when(s.rlike(lead), F.concat(way[part(lead, 1)], F.lit(" "), part(lead, 2))).otherwise(s)
    word = rf"(?s)^(.*) ({streets})((?: (?:{ways}))?)$"
    s = F.when(s.rlike(word), F.concat(part(word, 1), F.lit(" "), street[part(word, 2)], part(word, 3))).otherwise(s)
    tail = rf"(?s)^(.*) ({ways})$"
    return F.when(s.rlike(tail), F.concat(part(tail, 1), F.lit(" "), way[part(tail, 2)])).otherwise(s)


def base_name(s: Column) -> Column:
    """Lower-cased street name without a facility ending; null as empty."""
    n = F.trim(F.lower(F.coalesce(s, F.lit(""))))
    return F.trim(F.regexp_replace(n, f" ({'|'.join(FACILITY_ENDINGS)})$", ""))


def format_distance(ft: Column) -> Column:
    """Tens of feet under a tenth of a mile, else miles."""
    tens = (F.floor(ft / 10 + 0.5) * 10).cast("bigint")
    return F.when(ft < 528, F.format_string("%d ft", tens)).otherwise(F.format_string("%.2f mi", F.floor(ft * 100 / 5280 + 0.5) / 100))


def title_case(s: Column) -> Column:
    """Capitals at word starts; short directions in capitals."""
    words = F.transform(
        F.split(F.lower(s), r"(?<=[^a-z0-9_])|(?=[^a-z0-9_])"),
        lambda w: F.when(w.isin("nw", "ne", "sw", "se", "n", "s", "e", "w"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, F.length(w)))),
    )
    return F.array_join(words, "")


def format_phone(s: Column, area: str = "206") -> Column:
    """Seven or ten digits as (area) ddd-dddd; anything else as it is; empty as null."""
    d = F.regexp_replace(s, r"\D", "")
    seven = F.concat(F.lit(f"({area}) "), F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 4))
    ten = F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))
    return F.when(s == "", None).when(F.length(d) == 7, seven).when(F.length(d) == 10, ten).otherwise(s)


def escape_html(s: Column) -> Column:
    """Escaped text; blank as null."""
    t = F.trim(s)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(raw), F.lit(safe))
    return F.when(t != "", t)


def category_words(s: Column) -> Column:
    """The value of key=value, underscores as spaces."""
    return F.replace(F.when(F.instr(s, "=") > 0, F.regexp_replace(s, "^[^=]*=", "")).otherwise(s), F.lit("_"), F.lit(" "))


def place_label(lon: Column, lat: Column) -> Column:
    """lat, lon to five places."""
    return F.format_string("%.5f, %.5f", lat, lon)


def format_bytes(n: Column) -> Column:
    """Bytes, KB or MB."""
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024 * 1024, F.format_string("%.0f KB", F.round(n / 1024)))
        .otherwise(F.format_string("%.1f MB", F.round(n / (1024 * 1024), 1)))
    )


def content_type(url: Column) -> Column:
    """MIME type by ending."""
    return F.when(url.endswith(".json") | url.endswith(".geojson"), "application/json").otherwise("application/octet-stream")


def version_time(s: Column) -> Column:
    """yyyymmdd-hhmmss as a timestamp; null where it is none."""
    return F.try_to_timestamp(F.when(s.rlike(r"^\d{8}-\d{6}$"), s), F.lit("yyyyMMdd-HHmmss"))


def decode(table: dict[str, str], code: Column) -> Column:
    """The code's label, else the code, else null."""
    labels = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(code != "", F.coalesce(labels[code], code))
