"""Map-style expressions (nested arrays, as in style files) compiled to columns.

Nulls: ``get`` of a missing property is null; ``==`` and ``!=`` compare null as a value of its
own, ``in`` of null holds in no list that lacks it, ``match`` of null takes the default, and
``to-boolean`` takes null, "", 0, not-a-number and false as false. An input left of the first
stop of ``step`` or ``interpolate`` takes the first value; a null input gives null.
Properties may have any type; values of different types are unequal.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of values: a property's kind decides what it may equal.
TEXT, NUMBER, TRUTH = "text", "number", "truth"


class Style:
    """Compiles expressions over ``properties``: name -> (column, kind)."""

    def __init__(self, properties: Mapping[str, tuple[Column, str]], zoom: Column | float | None = None):
        self.properties, self.zoom = properties, zoom if zoom is None or isinstance(zoom, Column) else F.lit(float(zoom))

    def column(self, expression) -> Column:
        """The expression's value."""
        return self._made(expression)[0]

    def test(self, expression) -> Column:
        """The expression as a filter: true or false, never null."""
        return F.coalesce(self._truth(expression), F.lit(False))

    def _made(self, e) -> tuple[Column, str]:
        if not isinstance(e, list):
            kind = TRUTH if isinstance(e, bool) else NUMBER if isinstance(e, (int, float)) else TEXT
            return F.lit(float(e) if kind == NUMBER else e), kind
        compiled: Callable | None = getattr(self, f"_{_NAMES.get(e[0], e[0]).replace('-', '_')}", None)
        if compiled is None or e[0].startswith("_"):
            raise ValueError(f"unknown expression {e[0]!r}")
        return compiled(*e[1:])

    def _truth(self, e) -> Column:
        made, kind = self._made(e)
        return made if kind == TRUTH else self._to_boolean(e)[0]

    def _get(self, name: str) -> tuple[Column, str]:
        return self.properties.get(name, (F.lit(None).cast("string"), TEXT))

    def _has(self, name: str) -> tuple[Column, str]:
        return self._get(name)[0].isNotNull(), TRUTH

    def _zoom(self) -> tuple[Column, str]:
        if self.zoom is None:
            raise ValueError("this expression needs a zoom")
        return self.zoom, NUMBER

    def _literal(self, value) -> tuple[Column, str]:
        return self._made(value) if not isinstance(value, list) else (F.array(*[self._made(x)[0] for x in value]), "list")

    def _equal(self, a, b) -> tuple[Column, str]:
        (x, kind), (y, other) = self._made(a), self._made(b)
        return (x.eqNullSafe(y) if kind == other else x.isNull() & y.isNull()), TRUTH

    def _unequal(self, a, b) -> tuple[Column, str]:
        return ~self._equal(a, b)[0], TRUTH

    def _in(self, needle, values) -> tuple[Column, str]:
        given = values[1] if values[0] == "literal" else values
        return reduce(lambda a, b: a | b, [self._equal(needle, v)[0] for v in given], F.lit(False)), TRUTH

    def _all(self, *parts) -> tuple[Column, str]:
        return reduce(lambda a, b: a & b, [F.coalesce(self._truth(p), F.lit(False)) for p in parts], F.lit(True)), TRUTH

    def _any(self, *parts) -> tuple[Column, str]:
        return reduce(lambda a, b: a | b, [F.coalesce(self._truth(p), F.lit(False)) for p in parts], F.lit(False)), TRUTH

    def _not(self, part) -> tuple[Column, str]:
        return ~F.coalesce(self._truth(part), F.lit(False)), TRUTH

    def _to_boolean(self, part) -> tuple[Column, str]:
        x, kind = self._made(part)
        held = x if kind == TRUTH else x != "" if kind == TEXT else (x != 0) & ~F.isnan(x.cast("double"))
        return F.coalesce(held, F.lit(False)), TRUTH

    def _to_string(self, part) -> tuple[Column, str]:
        x, kind = self._made(part)
        whole = F.when(x == F.floor(x.cast("double")), x.cast("bigint").cast("string")).otherwise(x.cast("string")) if kind == NUMBER else x.cast("string")
        return F.coalesce(whole, F.lit("")), TEXT

    def _concat(self, *parts) -> tuple[Column, str]:
        return F.concat(*[self._to_string(p)[0] for p in parts]), TEXT

    def _match(self, needle, *rest) -> tuple[Column, str]:
        """Labels and their values by turns, the default last."""
        last, kind = self._made(rest[-1])
        out = None
        for labels, value in zip(rest[:-1:2], rest[1:-1:2], strict=True):
            hit = self._in(needle, labels if isinstance(labels, list) else [labels])[0]
            out = F.when(hit, self._made(value)[0]) if out is None else out.when(hit, self._made(value)[0])
        return (last if out is None else out.otherwise(last)), kind

    def _step(self, at, first, *stops) -> tuple[Column, str]:
        x, (value, kind) = self._made(at)[0], self._made(first)
        out = F.when(x.isNull(), F.lit(None))
        for place, then in zip(stops[::2], stops[1::2], strict=True):
            out, value = out.when(x < float(place), value), self._made(then)[0]
        return out.otherwise(value), kind

    def _interpolate(self, how, at, *stops) -> tuple[Column, str]:
        if list(how) != ["linear"]:
            raise ValueError(f"cannot interpolate by {how}")
        x = self._made(at)[0]
        places, values = [float(p) for p in stops[::2]], [self._made(v)[0] for v in stops[1::2]]
        out = F.when(x.isNull(), F.lit(None)).when(x <= places[0], values[0])
        for k in range(1, len(places)):
            share = (x - places[k - 1]) / (places[k] - places[k - 1])
            out = out.when(x <= places[k], values[k - 1] + share * (values[k] - values[k - 1]))
        return out.otherwise(values[-1]), NUMBER


_NAMES = {"==": "equal", "!=": "unequal", "!": "not"}

# The filters of the map's layers, by layer.
_STATUS, _CLASS, _NETWORK = ["get", "CURRENT_STATUS"], ["get", "CATEGORY"], ["get", "bike_network_category"]
INSTALLED = ["in", _STATUS, ["literal", ["INSVC", "PLNRECON"]]]
BUILDING = ["==", _STATUS, "UNDERCONS"]
GROUPS = {"aaa": ["BKF-NGW", "BKF-PBL", "BKF-OFFST"], "bbl": ["BKF-BBL"], "bl": ["BKF-BL"], "narrow": ["BKF-CLMB", "BKF-SHW"]}
PROPOSED = ["match", _NETWORK, ["Proposed Bike+ - Arterial", "Proposed Bike+ - Upgrade, Arterial", "Proposed Bike+ - Non-Arterial", "Proposed Multi-Use Trail", "Non-Bike+ Planned"], True, False]
LAYERS = {
    "contours-thin": ["==", ["get", "index"], 0],
    "contours-index": ["==", ["get", "index"], 1],
    "contours-labels": ["==", ["get", "index"], 1],
    "bike-plus-planned": ["==", ["to-boolean", PROPOSED], True],
    "bike-plus-existing": ["!", ["to-boolean", PROPOSED]],
    **{f"bike-facilities-{state}{name}": ["all", rule, ["in", _CLASS, ["literal", some]]] for name, some in GROUPS.items() for state, rule in (("", INSTALLED), ("construction-", BUILDING))},
    "bike-racks": INSTALLED,
    "parks-restrooms": ["all", ["==", ["get", "OPENTOPUBLIC"], "YES"], ["==", ["get", "LIFECYCLESTATUSTXT"], "A"], ["!=", ["get", "CURRENTSTATUS"], "CLOSED"]],
    "community-centers": ["==", ["get", "OPERATIONALSTATUS"], "Open Regular Hours"],
}
# Widths of lines and labels by zoom.
WIDTHS = {"green": ["interpolate", ["linear"], ["zoom"], 10, 1.5, 14, 3.5], "orange": ["interpolate", ["linear"], ["zoom"], 10, 0.8, 14, 1.8], "index": ["interpolate", ["linear"], ["zoom"], 11, 0.6, 14, 1.1, 16, 1.5]}
ELEVATION_LABEL = ["concat", ["to-string", ["get", "elev_ft"]], " ft"]


def layers_of(style: Style) -> Column:
    """The layers whose filters a feature passes, in their order."""
    return F.array_compact(F.array(*[F.when(style.test(rule), F.lit(name)) for name, rule in LAYERS.items()]))
