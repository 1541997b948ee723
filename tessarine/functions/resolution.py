"""Microns per pixel from slide properties, by two chains of sources that stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    """A number, or null; an empty string is no value."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def mpp_of_view(props: Column) -> Column:
    """First parsable of mpp-x, mpp-y and the scanner's own, then 10 / objective power; else null."""
    at = lambda k: _number(F.try_element_at(props, F.lit(k)))
    power = at("openslide.objective-power")
    return F.coalesce(at("openslide.mpp-x"), at("openslide.mpp-y"), at("aperio.MPP"), F.when(power != 0, 10.0 / power))


def mpp_of_comment(comment: Column) -> Column:
    return _number(F.nullif(F.regexp_extract(comment, r"<PixelSizeMicrons>(.*?)</PixelSizeMicrons>", 1), F.lit("")))


def mpp_of_xml(description: Column) -> Column:
    """PhysicalSizeX of the first Pixels of the first Image; anything else is null. A name prefix is allowed, and broken text never raises."""
    image = F.regexp_extract(description, r"(?s)<(?:\w+:)?Image\b(.*)", 1)
    return _number(F.regexp_extract(image, r"(?s)<(?:\w+:)?Pixels\b[^>]*?\sPhysicalSizeX\s*=\s*[\"']([^\"']*)[\"']", 1))


def mpp_of_index(props: Column, default: float | None = None, strict: bool = False) -> Column:
    """mpp-x, else the comment's, else the description's, zero counting as missing, else the default; strict: an error if none is left."""
    at = lambda k: F.try_element_at(props, F.lit(k))
    found = F.coalesce(_number(at("openslide.mpp-x")), F.nullif(mpp_of_comment(at("openslide.comment")), F.lit(0.0)), F.nullif(mpp_of_xml(at("tiff.ImageDescription")), F.lit(0.0)))
    found = F.nullif(found, F.lit(0.0))
    if default is not None:
        return F.coalesce(found, F.lit(default))
    return F.coalesce(found, F.raise_error(F.lit("no slide resolution found and no default given")).cast("double")) if strict else found
