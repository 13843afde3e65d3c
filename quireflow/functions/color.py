"""Colour arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws

# Thresholds of the accent rules, and the neutral accent.
DARK_LUMINANCE = 0.35
LIGHT_INK = 0.6
BAND_LUMINANCE = 0.2
MIN_CHROMA = 48
MIN_BUCKET_PIXELS = 8
NEUTRAL_ACCENT = (0x24, 0x2B, 0x38)


def parse_hex_color(value: Column | str) -> Column:
    """struct<r, g, b> of doubles, null for anything but 3 or 6 hex digits after an optional ``#``."""
    value = F.col(value) if isinstance(value, str) else value
    digits = F.regexp_extract(strip_ws(value), r"^#?([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})\z", 1)
    digits = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)

    def channel(start: int) -> Column:
        return F.conv(F.substring(digits, start, 2), 16, 10).cast("double")

    color = F.struct(channel(1).alias("r"), channel(3).alias("g"), channel(5).alias("b"))
    return F.when(digits != "", color)


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"))


def chroma(color: Column) -> Column:
    channels = [color[name] for name in "rgb"]
    return F.greatest(*channels) - F.least(*channels)


def luminance(color: Column) -> Column:
    """Relative luminance of an sRGB colour with channels 0..255."""

    def linear(channel: Column) -> Column:
        unit = channel / 255.0
        return F.when(unit <= 0.04045, unit / 12.92).otherwise(F.pow((unit + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(color["r"]) + 0.7152 * linear(color["g"]) + 0.0722 * linear(color["b"])
