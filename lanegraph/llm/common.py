"""What several corpus operators share: text and Arrow helpers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space that separates words (0x20 and 0x09 to 0x0D).
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced_words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def spare_names(taken: list[str], *names: str) -> list[str]:
    """The names for columns of our own, each with as many underscores before it as keep it off ``taken`` (letters' case aside)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def map_rows(df: DataFrame, make, fields: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add columns computed by Python from whole Arrow batches; a narrow step.

    ``make(batches)`` takes an iterator of record batches and yields, per batch, a dict of the
    new columns (lists or Arrow arrays); ``fields`` is their DDL. Other columns pass through
    as they are, those in ``drop`` and those that a new one replaces (letters' case aside) do not.
    """
    new = StructType.fromDDL(fields)
    gone = {n.lower() for n in (*drop, *new.names)}
    keep = [f for f in df.schema.fields if f.name.lower() not in gone]
    schema = StructType(keep + new.fields)
    arrow = to_arrow_schema(new)
    names = [f.name for f in keep]

    def run(batches):
        held = []

        def tee():
            for b in batches:
                held.append(b)
                yield b

        for made in make(tee()):
            b = held.pop(0)
            old = [b.column(b.schema.get_field_index(n)) for n in names]
            own = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(old + own, names=names + arrow.names)

    return df.mapInArrow(run, schema)


def byte_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]
