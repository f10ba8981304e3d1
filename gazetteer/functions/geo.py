"""Distances and distance text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazetteer import vocab


def haversine(
    lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float,
    cos1: Column | None = None, cos2: Column | None = None,
) -> Column:
    """Distance on the sphere; ``cos1`` and ``cos2`` are the cosines of the latitudes where a caller has them."""
    cos1, cos2 = F.cos(F.radians(lat1)) if cos1 is None else cos1, F.cos(F.radians(lat2)) if cos2 is None else cos2
    dlat = F.radians(lat2 - lat1) / 2
    dlng = F.radians(lng2 - lng1) / 2
    h = F.pow(F.sin(dlat), F.lit(2.0)) + cos1 * cos2 * F.pow(F.sin(dlng), F.lit(2.0))
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def metres(lat1, lng1, lat2, lng2) -> Column:
    return haversine(lat1, lng1, lat2, lng2, vocab.EARTH_M)


def miles(lat1, lng1, lat2, lng2) -> Column:
    return haversine(lat1, lng1, lat2, lng2, vocab.EARTH_MILES)


def distance_text(d: Column, otherwise: Column | None = None) -> Column:
    text = F.concat(F.format_string("%.1f", d.cast("double")), F.lit(" mi"))
    return F.when(d.isNotNull(), text).otherwise(
        F.lit(None).cast("string") if otherwise is None else otherwise
    )


def in_city(lat: Column, lng: Column) -> Column:
    south, north, west, east = vocab.CITY_BOX
    return (lat > south) & (lat < north) & (lng > west) & (lng < east)
