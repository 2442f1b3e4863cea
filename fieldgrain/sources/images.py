"""Readers of image folders, listings, plate maps and truth files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings that are read.
ENDINGS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")


def image_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """path, modificationTime, length, content. Filters on path and length are pushed down to the listing: apply them before any decoding."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join((*endings, *(e.upper() for e in endings))) + "}").option("recursiveFileLookup", "true").load(folder)


def stem(path):
    """The file's name without folder and ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def split_stems(spark: SparkSession, path: str) -> DataFrame:
    """Stems listed in a text file, one file name a line; blank lines are skipped."""
    return spark.read.text(path).select(stem(F.trim("value")).alias("stem")).where("stem <> ''")


def listed_stems(spark: SparkSession, path: str, files: DataFrame, ending: str = ".tif") -> DataFrame:
    """Stems of a listing, or of all files (path) of that ending, in order, where there is no listing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return split_stems(spark, path)
    return files.where(F.endswith(F.lower("path"), F.lit(ending))).select(stem(F.col("path")).alias("stem")).orderBy("stem")


def pair_with_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """stem, content, mask: images with a mask of the same stem; others drop out."""
    return images.select(stem(F.col("path")).alias("stem"), "content").join(masks.select(stem(F.col("path")).alias("stem"), F.col("content").alias("mask")), "stem")


def platemap(spark: SparkSession, path: str, columns: int = 12, rows: int = 8) -> DataFrame:
    """well_row, well_col, dose from a text file with one value a line, row by row, after a header line."""
    lines = spark.read.text(path, wholetext=True)
    cells = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit("")))), lambda x: x != "")
    values = lines.select(F.posexplode(cells)).where(f"pos between 1 and {rows * columns}")
    n = F.col("pos") - 1
    return values.select(F.char(F.lit(65) + F.floor(n / columns)).alias("well_row"), (n % columns + 1).cast("int").alias("well_col"), F.col("col").cast("double").alias("dose"))


WELL = r"Channel(\d+)-.*-([A-H])-(\d\d)\.BMP$"


def well_images(files: DataFrame) -> DataFrame:
    """channel, well_row, well_col and content of files named by plate position."""
    part = lambda n: F.regexp_extract("path", WELL, n)
    return files.where(F.col("path").rlike(WELL)).select(part(1).cast("int").alias("channel"), part(2).alias("well_row"), part(3).cast("int").alias("well_col"), "path", "content")


def well_channels(files: DataFrame, doses: DataFrame) -> DataFrame:
    """A row per well of the plate map: dose, content of channel 1 and 2. The plate map has at most a plate's wells."""
    wells = well_images(files)
    one, two = (wells.where(F.col("channel") == c).select("well_row", "well_col", F.col("content").alias(f"channel_{c}")) for c in (1, 2))
    return one.join(two, ["well_row", "well_col"]).join(F.broadcast(doses), ["well_row", "well_col"])


def truth_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, truth (JSON text of its value) from a JSON object by file name."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("file", "truth"))


SAMPLES = (
    ("Synthetic, easy", "synthetic_easy.png", ""),
    ("Synthetic, moderate", "synthetic_moderate.png", "clusters"),
    ("Synthetic, difficult", "synthetic_difficult.png", "uneven light, debris: counts fall short"),
    ("Synthetic, two channels", "synthetic_marker_pair.png", "blue nuclei, green marker"),
    ("Immunohistochemistry, brightfield", "public_immunohistochemistry.png", "stained tissue on a light background"),
)
#: Parameters that differ from the defaults for a file, and files whose numbers must not be taken for measurements.
OVERRIDES = {"public_immunohistochemistry.png": {"channel": "blue", "background": "light"}}
CAVEATS = {"public_immunohistochemistry.png": "not valid measurements: brightfield tissue needs its stains separated first, a threshold outlines whole regions"}


def samples(spark: SparkSession) -> DataFrame:
    """The registry of samples, in order: place, label, file, note, override (null: the default), caveat (null: none)."""
    rows = [(i, *s, OVERRIDES.get(s[1], {}).get("channel"), OVERRIDES.get(s[1], {}).get("background"), CAVEATS.get(s[1])) for i, s in enumerate(SAMPLES)]
    return spark.createDataFrame(rows, "place int, label string, file string, note string, channel string, background string, caveat string")


def with_overrides(files: DataFrame, registry: DataFrame, channel: str = "grayscale", background: str = "dark") -> DataFrame:
    """files (path, ...) with the channel and background to analyse them by and a caveat: the registry's where it has the file, else the defaults. The registry is a few rows."""
    known = registry.select(F.col("file").alias("_file"), F.col("channel").alias("_channel"), F.col("background").alias("_background"), "caveat")
    found = files.withColumn("_file", F.element_at(F.split("path", "/"), -1)).join(F.broadcast(known), "_file", "left")
    return found.withColumns({"channel": F.coalesce("_channel", F.lit(channel)), "background": F.coalesce("_background", F.lit(background))}).drop("_file", "_channel", "_background")
