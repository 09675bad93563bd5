"""Scalar functions over loosely typed values: numbers and times from text, IRIs, scales."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_XSD = "http://www.w3.org/2001/XMLSchema#"


def to_number(text: Column) -> Column:
    """Number of a text: trimmed, empty is 0, hexadecimal allowed, anything else null."""
    t = F.trim(text)
    plain = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    hexed = t.rlike(r"^0[xX][0-9a-fA-F]{1,15}$")
    return F.when(t == "", F.lit(0.0)).when(hexed, F.conv(F.substring(t, 3, 15), 16, 10).cast("double")).when(plain, t.try_cast("double"))


def to_time(text: Column) -> Column:
    """Timestamp of an ISO text, else null."""
    return F.try_to_timestamp(text)


def local_part(iri: Column) -> Column:
    """What follows the last #, else the last /, else the last colon."""
    return (
        F.when(F.instr(iri, "#") > 0, F.substring_index(iri, "#", -1))
        .when(F.instr(iri, "/") > 0, F.substring_index(iri, "/", -1))
        .otherwise(F.substring_index(iri, ":", -1))
    )


def literal_number(value: Column, datatype: Column) -> Column:
    """Numeric value of a literal: untyped or of a numeric datatype."""
    kinds = [_XSD + k for k in ("integer", "int", "long", "float", "double", "decimal")]
    return F.when(datatype.isNull() | datatype.isin(kinds), value.try_cast("double"))


def cast_literal(value: Column, datatype: Column) -> Column:
    """(number, flag, text) of a typed literal, one of them set: whole and decimal numbers are read as far as they go."""
    whole = datatype.rlike("#(integer|int|long)$")
    part = F.when(whole, F.regexp_extract(value, r"^\s*([+-]?\d+)", 1)).otherwise(F.regexp_extract(value, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1))
    numeric, flag = F.coalesce(datatype.rlike("#(integer|int|long|float|double|decimal)$"), F.lit(False)), F.coalesce(datatype.endswith("#boolean"), F.lit(False))
    return F.struct(F.when(numeric, part.try_cast("double")).alias("number"), F.when(flag, value == "true").alias("flag"), F.when(~numeric & ~flag, value).alias("text"))


def expanded(name: Column, prefixes: dict[str, str]) -> Column:
    """prefix:local as an IRI; an unknown prefix leaves it as it is."""
    known = F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv))
    base = F.try_element_at(known, F.substring_index(name, ":", 1))
    return F.when((F.instr(name, ":") > 0) & base.isNotNull(), F.concat(base, F.regexp_replace(name, "^[^:]*:", ""))).otherwise(name)


def shortened(iri: Column, prefixes: dict[str, str]) -> Column:
    """An IRI as prefix:local by the first prefix that fits, else its local part."""
    out = local_part(iri)
    for short, base in reversed(list(prefixes.items())):
        out = F.when(iri.startswith(base), F.concat(F.lit(f"{short}:"), F.substring(iri, len(base) + 1, 2**31 - 1))).otherwise(out)
    return out


def finite(value: Column) -> Column:
    """The value, or null where it isn't a finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(math.inf)), value)


def scaled(value: Column, lo: Column, hi: Column, least: float, most: float) -> Column:
    """Linear scale to [least, most], clamped; an empty domain counts as one unit wide."""
    width = F.when(hi > lo, hi - lo).otherwise(1.0)
    return least + (most - least) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / width))


def palette_step(share: Column, palette: list[str]) -> Column:
    """Nearest step of a sequential palette for a share clamped to 0..1 (halves round up)."""
    at = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (len(palette) - 1) + 0.5)
    return F.element_at(F.array(*map(F.lit, palette)), (at + 1).cast("int"))


def luminance(color: Column) -> Column:
    """Relative luminance of ``#rrggbb``, null for anything else."""
    def channel(at: int) -> Column:
        c = F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return F.when(color.rlike("^#[0-9a-fA-F]{6}$"), 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6))


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two colors."""
    x, y = luminance(a), luminance(b)
    return F.when(x.isNotNull() & y.isNotNull(), (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))


#: What glyphs are drawn in on a dark and on a light fill, and the luminance that the dark one is taken to have (with 0.05 added).
LIGHT_STROKE, DARK_STROKE, DARK_LUMINANCE = "#ffffff", "#1a1a1a", 0.0617


def glyph_stroke(fill: Column) -> Column:
    """The stroke that stands out more from a fill by contrast; the light one where the fill is no ``#rrggbb``."""
    held = luminance(fill) + 0.05
    return F.when(held / DARK_LUMINANCE > 1.05 / held, DARK_STROKE).otherwise(LIGHT_STROKE)


def weak_colours(palette: list[str], background: str, least: float = 1.6) -> Column:
    """The colours of a palette that contrast less than ``least`` with a background."""
    every = F.array(*(F.struct(F.lit(c).alias("c"), contrast(F.lit(c), F.lit(background)).alias("r")) for c in palette))
    return F.transform(F.filter(every, lambda x: x["r"] < least), lambda x: x["c"])
