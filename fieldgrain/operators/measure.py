"""Objects from label and intensity planes joined by pixel, and summaries per image. All in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

SCALED = {"area_pixels": "area_um2", "perimeter_pixels": "perimeter_um", "equivalent_diameter_pixels": "equivalent_diameter_um", "major_axis_pixels": "major_axis_um", "minor_axis_pixels": "minor_axis_um", "centroid_x": "centroid_x_um", "centroid_y": "centroid_y_um"}


def regions(px: DataFrame) -> DataFrame:
    """(image, label, y, x, v) to a row per object: size, place, box, ellipse and intensity (times 255)."""
    on = px.where("label > 0")
    g = on.groupBy("image", F.col("label").cast("long").alias("object_id")).agg(
        F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), F.count("*").cast("double").alias("area_pixels"),
        F.min("y").alias("top"), F.min("x").alias("left"), (F.max("y") + 1).alias("bottom"), (F.max("x") + 1).alias("right"),
        F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"),
        (F.avg("v") * 255).alias("mean_intensity"), (F.max("v") * 255).alias("maximum_intensity"), (F.min("v") * 255).alias("minimum_intensity"),
    )
    major, minor, ecc = C.axes(F.col("vx"), F.col("vy"), F.col("vxy"))
    return g.withColumns({"equivalent_diameter_pixels": C.equivalent_diameter(F.col("area_pixels")), "major_axis_pixels": major, "minor_axis_pixels": minor, "eccentricity": ecc}).drop("vx", "vy", "vxy")


def touches_border(height: int, width: int):
    return (F.col("top") <= 0) | (F.col("left") <= 0) | (F.col("bottom") >= height) | (F.col("right") >= width)


def in_microns(objects: DataFrame, pixel_size: float | None) -> DataFrame:
    """Scaled columns added; none without a positive pixel size."""
    if not pixel_size or pixel_size <= 0:
        return objects
    return objects.withColumns({new: F.col(old) * (pixel_size**2 if old == "area_pixels" else pixel_size) for old, new in SCALED.items() if old in objects.columns})


def summarize(images: DataFrame, objects: DataFrame, image: str = "image") -> DataFrame:
    """A row per image, also of those without objects: count, mean and median area, means of intensity and circularity (missing ones skipped), objects at the border."""
    found = objects.groupBy(image).agg(
        F.count("*").alias("count"), F.avg("area_pixels").alias("mean_area"), F.median("area_pixels").alias("median_area"), F.avg("mean_intensity").alias("mean_intensity"),
        F.avg(C.known(F.col("circularity"))).alias("mean_circularity"), F.count_if("touches_border").alias("border_count"),
    )
    return images.select(image).distinct().join(found, image, "left").fillna(0, ["count", "border_count"])


def small_dropped(px: DataFrame, least: int) -> DataFrame:
    """px with labels of fewer pixels set to 0, the others numbered anew from 1 in their order."""
    kept = px.where("label > 0").groupBy("image", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ranks = kept.select("image", "label", F.row_number().over(Window.partitionBy("image").orderBy("label")).alias("rank"))
    return px.join(ranks, ["image", "label"], "left").withColumn("label", F.coalesce("rank", F.lit(0)).cast("int")).select(px.columns)


def batch_summary(images: DataFrame, objects: DataFrame, image: str = "image") -> DataFrame:
    """images (image, error) with their counts; a failed image keeps its row, with nulls."""
    n = objects.groupBy(image).agg(F.count("*").alias("n"), F.avg("area_pixels").alias("mean_area"))
    out = images.join(n, image, "left")
    ok = F.col("error").isNull()
    return out.select(image, "error", F.when(ok, F.coalesce("n", F.lit(0))).alias("n_objects"), F.when(ok, F.col("mean_area")).alias("mean_area"))


def batch_total(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("images"), F.count("error").alias("failed"), F.sum(F.coalesce("n_objects", F.lit(0))).alias("objects"))


def histogram(df: DataFrame, value: str, by: str, factor: float, least: int, most: int = 40, split=None) -> DataFrame:
    """(by, bin, lower, n[, per value of split]): equal bins over each group's range, int(sqrt(n) * factor) of them within bounds, the last closed."""
    span = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.sqrt(F.count("*")) * factor))).cast("int").alias("bins"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)).otherwise(0).cast("int")
    counts = [F.count("*").alias("n")] + ([F.count_if(split).alias("n_split")] if split is not None else [])
    return df.join(span, by).where(F.col(value).isNotNull()).groupBy(by, at.alias("bin"), (F.col("lo") + at * width).alias("lower")).agg(*counts)
