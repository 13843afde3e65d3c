"""Accent colours from pixel tables ``pixels(image, r, g, b[, a])``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import (
    BAND_LUMINANCE,
    DARK_LUMINANCE,
    LIGHT_INK,
    MIN_BUCKET_PIXELS,
    MIN_CHROMA,
    NEUTRAL_ACCENT,
    chroma,
    luminance,
    parse_hex_color,
    rgb,
)


def color_buckets(pixels: DataFrame) -> DataFrame:
    """(image, bucket, n, r, g, b): saturated pixels by the top three bits per channel, with mean colours.

    Counts and sums combine in each task first, so an image holding most pixels
    sends at most 512 rows per task.
    """
    color = rgb(F.col("r"), F.col("g"), F.col("b"))
    bits = lambda name: F.shiftright(F.col(name).cast("int"), 5)
    bucket = bits("r") * 64 + bits("g") * 8 + bits("b")
    mean = lambda name: (F.sum(F.col(name).cast("double")) / F.count("*")).alias(name)
    return (
        pixels.filter(chroma(color) >= MIN_CHROMA)
        .groupBy("image", bucket.alias("bucket"))
        .agg(F.count("*").alias("n"), mean("r"), mean("g"), mean("b"))
    )


def top_bucket(buckets: DataFrame) -> DataFrame:
    """The fullest bucket of each image if it has enough pixels; ties go to the lowest bucket."""
    best = F.max(F.struct("n", (-F.col("bucket")).alias("minus_bucket"), "r", "g", "b")).alias("best")
    return (
        buckets.filter(F.col("n") >= MIN_BUCKET_PIXELS)
        .groupBy("image")
        .agg(best)
        .select("image", (-F.col("best.minus_bucket")).alias("bucket"), "best.n", "best.r", "best.g", "best.b")
    )


def dominant_color(pixels: DataFrame) -> DataFrame:
    return top_bucket(color_buckets(pixels)).select("image", "r", "g", "b")


def ink_luminance(pixels: DataFrame) -> DataFrame:
    """(image, ink): luminance of the alpha-weighted mean colour; null when fully transparent."""
    weighted = pixels.groupBy("image").agg(
        F.sum("a").cast("double").alias("_a"),
        *(F.sum(F.col(c).cast("double") * F.col("a")).alias(f"_{c}") for c in "rgb"),
    )
    mean = rgb(*(F.col(f"_{c}") / F.col("_a") for c in "rgb"))
    return weighted.select("image", F.when(F.col("_a") >= 1, luminance(mean)).alias("ink"))


def accent_color(sites: DataFrame, dominants: DataFrame) -> DataFrame:
    """Add ``accent``: first dark theme colour, else the logo's, else the icon's dark dominant colour, else neutral.

    ``sites(site, theme_colors, logo, icon)`` name images of ``dominants(image, r, g, b)``.
    """
    dark = F.filter(
        F.transform("theme_colors", parse_hex_color), lambda c: c.isNotNull() & (luminance(c) < DARK_LUMINANCE)
    )
    color = F.struct("r", "g", "b")
    usable = dominants.filter(luminance(color) < DARK_LUMINANCE).select("image", color.alias("color"))
    found = sites
    for name in ("logo", "icon"):
        found = found.join(usable.select(F.col("image").alias(name), F.col("color").alias(f"_{name}")), name, "left")
    neutral = rgb(*(F.lit(channel) for channel in NEUTRAL_ACCENT))
    return found.withColumn("accent", F.coalesce(F.get(dark, F.lit(0)), "_logo", "_icon", neutral)).drop("_logo", "_icon")


def light_mark(accented: DataFrame, inks: DataFrame) -> DataFrame:
    """Add ``light_mark``: the logo, or without one the icon, is too light for paper and the accent is dark."""
    marked = accented.withColumn("_mark", F.coalesce("logo", "icon"))
    joined = marked.join(inks.select(F.col("image").alias("_mark"), "ink"), "_mark", "left")
    light = (F.col("ink") > LIGHT_INK) & (luminance(F.col("accent")) < BAND_LUMINANCE)
    return joined.withColumn("light_mark", F.coalesce(light, F.lit(False))).drop("_mark", "ink")
