"""Plot-ready map tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometric import fixed
from regiometric.functions import numeric_code, text_code


def colour_position(value: Column | str, limits: tuple[Column | float, Column | float] = fixed.COLOUR_LIMITS) -> Column:
    """Place of a value on the colour scale, 0 to 1; values outside the limits get NULL."""
    column = F.col(value) if isinstance(value, str) else value
    low, high = (limit if isinstance(limit, Column) else F.lit(float(limit)) for limit in limits)
    return F.when(column.between(low, high), F.try_divide(column - low, high - low))


def colour_class(position: Column | str, step: float = fixed.COLOUR_STEP) -> Column:
    """0-based class between colour breaks ``step`` apart; the upper end belongs to the last class."""
    column = F.col(position) if isinstance(position, str) else position
    last = round(1 / step) - 1
    # least() skips NULL, so positions off the scale are kept out of it
    return F.when(column.isNotNull(), F.least(F.floor(column / step), F.lit(last))).cast("int")


def with_colour(
    df: DataFrame,
    value: str,
    limits: tuple[float, float] | None = fixed.COLOUR_LIMITS,
    step: float = fixed.COLOUR_STEP,
) -> DataFrame:
    """Rows with ``colour_position`` and ``colour_class``; ``limits=None`` takes the range of the data."""
    if limits is None:
        span = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
        limits = (span.select("low").scalar(), span.select("high").scalar())
    return df.withColumn("colour_position", colour_position(value, limits)).withColumn(
        "colour_class", colour_class("colour_position", step)
    )


def map_layer(
    polygons: DataFrame,
    rates: DataFrame,
    value: str = "rate",
    polygon_key: str = "reg_id",
    rate_key: str = "cod_regiao_saude",
    limits: tuple[float, float] | None = fixed.COLOUR_LIMITS,
) -> DataFrame:
    """Every polygon with the rate of its region (NULL without one), coordinate system and colour.

    Keys are compared as whole numbers, since polygon files and rate tables spell codes differently.
    """
    left = polygons.withColumn("_polygon", numeric_code(polygon_key))
    right = rates.withColumn("_rate", numeric_code(rate_key))
    layer = left.join(right, F.col("_polygon") == F.col("_rate"), "left").drop("_polygon", "_rate")
    return with_colour(layer.withColumn("srid", F.lit(fixed.SRID)), value, limits)


def in_view(
    longitude: Column | str,
    latitude: Column | str,
    limits_longitude: tuple[float, float] = fixed.VIEW_LONGITUDE,
    limits_latitude: tuple[float, float] = fixed.VIEW_LATITUDE,
) -> Column:
    """Whether a point lies in the viewport. Zooming drops no rows, so this is a flag and not a filter."""
    x = F.col(longitude) if isinstance(longitude, str) else longitude
    y = F.col(latitude) if isinstance(latitude, str) else latitude
    return x.between(*limits_longitude) & y.between(*limits_latitude)


def capital_points(
    hierarchy: DataFrame,
    capitals: Sequence[str] = fixed.CAPITALS,
    code: str = "cod_municipiodv",
    columns: Sequence[str] = ("cod_municipio", "municipio"),
) -> DataFrame:
    """Listed municipalities with numeric coordinates and the viewport flag."""
    chosen = hierarchy.filter(text_code(code).isin(*capitals))
    points = chosen.select(
        *columns,
        F.col("longitude").cast("string").try_cast("double").alias("longitude"),
        F.col("latitude").cast("string").try_cast("double").alias("latitude"),
    )
    return points.withColumn("in_view", in_view("longitude", "latitude"))
