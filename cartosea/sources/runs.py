"""A run's description beside its outputs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an archive of a run may hold, by the end of the name.
ARCHIVED = (".tif", ".png", ".geojson", ".json", ".parquet")


def write_metadata(spark: SparkSession, path: str, generator: str, timestamp: str, **more) -> None:
    """Write a run's metadata (generator, timestamp as YYYY_MM_DD_HHMMSS, and outputs or bounds, area and resolutions) as
    one JSON document under path. Keys are sorted."""
    text = json.dumps({"generator": generator, "timestamp": timestamp} | more, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The document."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


#: Resolutions that a run may ask for, and the layers that its archive may hold.
RESOLUTIONS = ("25cm", "1m", "10m")
LAYERS = ("dem_", "hillshade_", "slope_", "water_", "floodplain_", "contours_", "rgb_")
ALWAYS = ("zoom_levels.json", "preview_imagery.png")


def check_request(bounds: tuple[float, float, float, float], resolutions: list[str]) -> None:
    """Raise ValueError unless bounds (west, south, east, north) are in order and all resolutions are known."""
    west, south, east, north = bounds
    if not (west < east and south < north):
        raise ValueError(f"bounds aren't in order: {bounds}")
    unknown = [r for r in resolutions if r not in RESOLUTIONS]
    if unknown:
        raise ValueError(f"unknown resolutions: {', '.join(unknown)}; there are {', '.join(RESOLUTIONS)}")


def archived_layers(names: DataFrame, resolutions: list[str]) -> DataFrame:
    """Of names (name) the files that an archive of these resolutions holds: zoom levels, the preview, and rasters of known
    layers tagged with one of them and with no other."""
    tag = lambda r: F.contains("name", F.lit(f"_{r}"))
    none = F.lit(False)
    asked = [tag(r) for r in RESOLUTIONS if r in resolutions]
    other = [tag(r) for r in RESOLUTIONS if r not in resolutions]
    known = reduce(lambda a, b: a | b, [F.startswith("name", F.lit(x)) for x in LAYERS])
    raster = F.endswith("name", F.lit(".tif")) & known & reduce(lambda a, b: a | b, asked, none) & ~reduce(lambda a, b: a | b, other, none)
    return names.where(F.col("name").isin(*ALWAYS) | raster)


def archived(names: list[str]) -> list[str]:
    """The names of a run's files that go into its archive, in order; hidden and temporary ones don't."""
    return sorted(n for n in names if n.lower().endswith(ARCHIVED) and not n.rsplit("/", 1)[-1].startswith((".", "_")))
