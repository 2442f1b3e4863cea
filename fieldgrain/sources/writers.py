"""Sinks: CSV with three decimals, PNG bytes, reports, and the three files of an analysed image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def csv_ready(df: DataFrame) -> DataFrame:
    """Fractional columns as text with three decimals; NaN and null are empty."""
    shown = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), None).otherwise(F.format_string("%.3f", F.col(c).cast("double")))
    return df.select(*[shown(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, folder: str) -> None:
    csv_ready(df).write.mode("overwrite").option("header", "true").option("emptyValue", "").option("encoding", "UTF-8").csv(folder)


def csv_text(df: DataFrame, by: str) -> DataFrame:
    """(by, csv): a small table as CSV text per value of `by`, rows in order of their first column."""
    columns = [c for c in df.columns if c != by]
    ready = csv_ready(df)
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = ready.select(by, F.struct(F.col(columns[0]).cast("double").alias("k"), line.alias("line")).alias("r"))
    lines = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"])
    return rows.groupBy(by).agg(F.concat_ws("\n", F.lit(",".join(columns)), F.concat_ws("\n", lines)).alias("csv"))


def write_files(df: DataFrame, folder: str, name: str, content: str) -> None:
    """Each row's bytes as one file of the given name under a folder all executors reach."""

    def save(batches):
        import os

        for b in batches:
            for n, c in zip(b[name], b[content], strict=True):
                path = os.path.join(folder, n)
                with open(f"{path}.part", "wb") as f:
                    f.write(c if isinstance(c, bytes) else str(c).encode())
                os.replace(f"{path}.part", path)  # a task that runs twice leaves the same file
            yield b[[name]]

    import os

    os.makedirs(folder, exist_ok=True)
    df.select(name, content).mapInPandas(save, f"`{name}` string").write.format("noop").mode("overwrite").save()


def report_text(df: DataFrame, by: str, lines: list[tuple[str, str]]) -> DataFrame:
    """(by, report): one line per (name, column), names padded to 24 characters; null columns leave their line out."""
    return df.select(by, F.concat_ws("\n", *[F.when(F.col(c).isNotNull(), F.concat(F.rpad(F.lit(n), 24, " "), F.col(c).cast("string"))) for n, c in lines]).alias("report"))


def save_outputs(analyzed: DataFrame, folder: str, keep: str = "path") -> None:
    """Of each analysed image (with planes) three files named after it and, but for the default, its parameter set: measurements, annotated picture, mask. Two images of one name are an error, before anything is written."""
    stem = F.regexp_extract(keep, r"([^/]+?)(?:\.[^./]*)?$", 1)
    name = F.when(F.col("params") == "default", stem).otherwise(F.concat(stem, F.lit("_"), F.regexp_replace("params", r"[^A-Za-z0-9.=,-]", "_")))
    good = analyzed.where("error is null and mask_png is not null")
    if twice := good.groupBy(name.alias("name")).count().where("count > 1").head():
        raise ValueError(f"{twice['count']} analyses would write files of the name {twice['name']}")
    objects = good.select(name.alias("stem"), F.explode("objects").alias("o")).select("stem", "o.*")
    parts = [csv_text(objects, "stem").select(F.concat("stem", F.lit("_measurements.csv")).alias("name"), F.encode("csv", "UTF-8").alias("content"))]
    parts += [good.select(F.concat(name, F.lit(f"_{kind}.png")).alias("name"), F.col(f"{kind}_png").alias("content")) for kind in ("annotated", "mask")]
    write_files(parts[0].union(parts[1]).union(parts[2]), folder, "name", "content")


def save_marker_outputs(objects: DataFrame, summary: DataFrame, folder: str, by: str = "path") -> None:
    """Of each two-channel image a CSV of its objects' marker values, and one CSV of all images' summaries. summary: a row per image."""
    stem = F.regexp_extract(by, r"([^/]+?)(?:\.[^./]*)?$", 1)
    each = csv_text(objects.withColumn("_stem", stem).drop(by), "_stem").select(F.concat("_stem", F.lit("_markers.csv")).alias("name"), F.encode("csv", "UTF-8").alias("content"))
    whole = csv_text(summary.select(F.row_number().over(Window.orderBy(by)).alias("row"), "*", F.lit("all").alias("_all")), "_all").select(F.lit("marker_summary.csv").alias("name"), F.encode("csv", "UTF-8").alias("content"))
    write_files(each.union(whole), folder, "name", "content")


def report_json(df: DataFrame, by: str) -> DataFrame:
    """(by, json): all further columns as one JSON object a row, missing and infinite values left out."""
    shown = [F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c != by]
    return df.select(by, F.to_json(F.struct(*shown)).alias("json"))
