"""Image tier: bytes to planes, label planes and object rows. One row is one image, and one Python crossing does it all."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs, kernels
from . import render


@dataclass(frozen=True)
class SegmentParams:
    """The only defaults; every step gets them all."""

    channel: str = "grayscale"
    background: str = "dark"
    normalize: bool = True
    illumination_radius: int = 0
    smoothing_sigma: float = 0.6
    method: str = "otsu"
    manual_threshold: float | None = None
    cleanup_radius: int = 0
    min_size: int = 60
    watershed: bool = True
    seeding: str = "h_maxima"
    seed_depth: float = 1.0
    peak_min_distance: float = 9
    refine_band: int = 0  # kept for comparison, like seeding "adaptive"
    engine: str = "classical"


@dataclass
class Segmentation:
    labels: np.ndarray
    threshold: float | None  # None: no threshold (flat image, or an engine without one)
    method: str
    separated: bool

    @property
    def mask(self) -> np.ndarray:
        return self.labels > 0

    @property
    def n_objects(self) -> int:
        return int(self.labels.max(initial=0))


#: Pixel counts from which on (exclusive) an image is slow, or too large.
SLOW_PIXELS, MOST_PIXELS = 6_000_000, 40_000_000


def size_verdict(width, height):
    """Column: ok, slow or too_large, by the header's size."""
    pixels = width.cast("long") * height.cast("long")
    return F.when(pixels > MOST_PIXELS, "too_large").when(pixels > SLOW_PIXELS, "slow").otherwise("ok")


def load_image(raw: bytes) -> np.ndarray:
    try:
        return kernels.flatten_stack(*codecs.read(raw))
    except codecs.ImageLoadError:
        raise
    except ValueError as e:
        raise codecs.ImageLoadError(str(e)) from e


def prepare(image: np.ndarray, p: SegmentParams) -> tuple[np.ndarray, np.ndarray]:
    """(analysis, intensity): signal high in both; only the first is stretched."""
    if p.background not in ("dark", "light"):
        raise ValueError(f"unknown background {p.background!r}")
    plane = kernels.pick_channel(image, p.channel)
    if p.background == "light":
        plane = 1 - plane
    return (kernels.stretch(plane) if p.normalize else plane), plane


def build_mask(plane: np.ndarray, threshold: float, cleanup: int, least: int) -> np.ndarray:
    mask = plane > threshold
    if cleanup > 0:
        mask = kernels.closing(kernels.opening(mask, kernels.disk(cleanup)), kernels.disk(cleanup))
    return kernels.drop_small(kernels.fill_holes(mask), least)


def classical(plane: np.ndarray, p: SegmentParams) -> Segmentation:
    if plane.ndim != 2:
        raise ValueError("segmentation needs a 2-D plane")
    work = kernels.gaussian(kernels.even_out(plane, p.illumination_radius), p.smoothing_sigma)
    t = kernels.threshold_of(work, p.method, p.manual_threshold)
    if not np.isfinite(t):
        return Segmentation(np.zeros(plane.shape, np.int32), None, p.method, False)
    mask = build_mask(work, t, p.cleanup_radius, p.min_size)
    labels = kernels.separate(mask, p.seeding, p.seed_depth, p.peak_min_distance) if p.watershed else kernels.components(mask)
    if p.refine_band > 0:
        labels = kernels.refine(labels, work, p.refine_band)
    return Segmentation(kernels.relabel(kernels.drop_small(labels, p.min_size)), t, p.method, p.watershed)


#: Engines by name: the function, or the reason why it can't run here.
ENGINES: dict = {}


def register_engine(name: str, run=None, reason: str | None = None) -> None:
    """Offer run(plane, params) -> Segmentation under a name, or say why it isn't there. It runs in the executors' Python: register it in a module that these import too."""
    if (run is None) == (reason is None):
        raise ValueError("an engine has either a function or a reason")
    ENGINES[name] = run or reason


register_engine("classical", classical)
register_engine("learned", reason="the learned engine's libraries are not installed")


def engine_reason(name: str) -> str | None:
    """None if the engine can run."""
    found = ENGINES.get(name, f"unknown engine {name!r}")
    return found if isinstance(found, str) else None


def segment(plane: np.ndarray, p: SegmentParams) -> Segmentation:
    if reason := engine_reason(p.engine):
        raise ValueError(reason)
    return ENGINES[p.engine](plane, p)


OBJECT_COLUMNS = ("object_id", "centroid_x", "centroid_y", "area_pixels", "perimeter_pixels", "equivalent_diameter_pixels", "circularity", "eccentricity", "solidity", "major_axis_pixels", "minor_axis_pixels", "mean_intensity", "maximum_intensity", "minimum_intensity", "touches_border")
OBJECT = "object_id long, centroid_x double, centroid_y double, area_pixels double, perimeter_pixels double, equivalent_diameter_pixels double, circularity double, eccentricity double, solidity double, major_axis_pixels double, minor_axis_pixels double, mean_intensity double, maximum_intensity double, minimum_intensity double, touches_border boolean"


def measure(labels: np.ndarray, plane: np.ndarray) -> list[tuple]:
    """Object rows of a label plane over an intensity plane (times 255)."""
    if labels.shape != plane.shape:
        raise ValueError(f"label plane {labels.shape} and intensity plane {plane.shape} differ in shape")
    h, w = labels.shape
    ys, xs = np.nonzero(labels)
    order = np.argsort(labels[ys, xs], kind="stable")
    ys, xs = ys[order], xs[order]
    names, starts = np.unique(labels[ys, xs], return_index=True)
    rows = []
    for name, y, x in zip(names.tolist(), np.split(ys, starts[1:]), np.split(xs, starts[1:]), strict=True):
        area, v = len(y), plane[y, x].astype(np.float64) * 255
        top, left, bottom, right = y.min(), x.min(), y.max() + 1, x.max() + 1
        own = np.zeros((bottom - top, right - left), bool)
        own[y - top, x - left] = True
        cov = np.cov(np.stack([x, y]), bias=True) if area > 1 else np.zeros((2, 2))
        small, large = np.maximum(np.linalg.eigvalsh(cov), 0)
        around = kernels.crofton(own)
        rows.append((name, float(x.mean()), float(y.mean()), float(area), kernels.perimeter(own), float(np.sqrt(4 * area / np.pi)), float(min(1.0, max(0.0, 4 * np.pi * area / around**2))) if around > 0 else None,
                     float(np.sqrt(1 - small / large)) if large > 0 else 0.0, area / max(area, kernels.convex_area(own)), float(4 * np.sqrt(large)), float(4 * np.sqrt(small)), float(v.mean()), float(v.max()), float(v.min()), bool(top <= 0 or left <= 0 or bottom >= h or right >= w)))
    return rows


def analyze(files: DataFrame, params: SegmentParams | dict[str, SegmentParams] | None = None, keep: str = "path", content: str = "content", planes: bool = False, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """A row per image and named parameter set: keep, params, width, height, error, n_objects, threshold, objects, and with `planes` label_plane (int32 bytes), mask_png and annotated_png.

    The image is decoded once for all parameter sets; sizes are judged from the header before any pixel is read. A bad
    image gives an error row, never a failed job. Carry no more columns than these through Python: join others back by `keep`.
    """
    named = params if isinstance(params, dict) else {"default": params or SegmentParams()}
    kind = files.schema[keep].dataType.simpleString()
    schema = f"`{keep}` {kind}, params string, width int, height int, error string, n_objects long, threshold double, objects array<struct<{OBJECT.replace(' ', ':', 0)}>>, label_plane binary, mask_png binary, annotated_png binary"
    schema = schema.replace(OBJECT, ", ".join(c.replace(" ", ": ", 1) for c in OBJECT.split(", ")))

    def run(batches):
        for b in batches:
            rows = []
            for key, raw in zip(b["keep"], b["content"], strict=True):
                width = height = None
                try:
                    width, height = codecs.size_of(bytes(raw or b""))
                    if width * height > most_pixels:
                        raise codecs.ImageLoadError(f"{width} x {height} pixels are too many")
                    image = load_image(bytes(raw))
                except codecs.ImageLoadError as e:
                    rows += [(key, n, width, height, str(e), None, None, None, None, None, None) for n in named]
                    continue
                for n, p in named.items():
                    try:
                        analysis, intensity = prepare(image, p)
                        found = segment(analysis, p)
                        objects = [dict(zip(OBJECT_COLUMNS, o, strict=True)) for o in measure(found.labels, intensity)]
                        extra = (found.labels.astype("<i4").tobytes(), codecs.to_png(render.mask_picture(found.labels)), codecs.to_png(render.outlined(intensity, found.labels))) if planes else (None,) * 3
                        rows.append((key, n, width, height, None, found.n_objects, found.threshold, objects, *extra))
                    except (ValueError, MemoryError) as e:
                        rows.append((key, n, width, height, str(e) or type(e).__name__, None, None, None, None, None, None))
            frame = pd.DataFrame(rows, columns=[keep, "params", "width", "height", "error", "n_objects", "threshold", "objects", "label_plane", "mask_png", "annotated_png"]).astype(object)
            yield frame.where(frame.notna(), None)

    return files.select(F.col(keep).alias("keep"), F.col(content).alias("content")).mapInPandas(run, schema)


def objects(analyzed: DataFrame, keep: str = "path") -> DataFrame:
    """One row per object; images without objects have none."""
    return analyzed.select(keep, "params", F.explode("objects").alias("o")).select(keep, "params", "o.*")


def grid(**choices) -> dict[str, SegmentParams]:
    """Every combination of the given parameter values, by a readable name, in order."""
    out = [SegmentParams()]
    for k, values in choices.items():
        out = [replace(p, **{k: v}) for p in out for v in values]
    return {",".join(f"{k}={asdict(p)[k]}" for k in choices): p for p in out}


MARKED = "object_id:bigint,area_pixels:double,touches_border:boolean,marker_mean:double,marker_max:double"


def analyze_pair(files: DataFrame, nuclear: SegmentParams | None = None, marker: SegmentParams | None = None, keep: str = "path", content: str = "content", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """A row per two-channel image: keep, error, n_objects, objects with their marker means. Objects come from the nuclear channel alone, so that it sets the denominator."""
    nuclear, marker = nuclear or SegmentParams(channel="blue"), marker or SegmentParams(channel="green")
    kind = files.schema[keep].dataType.simpleString()

    def one(raw: bytes) -> tuple:
        width, height = codecs.size_of(raw)
        if width * height > most_pixels:
            raise codecs.ImageLoadError(f"{width} x {height} pixels are too many")
        image = load_image(raw)
        analysis, intensity = prepare(image, nuclear)
        found, plane = segment(analysis, nuclear), prepare(image, marker)[1].astype(np.float64) * 255
        shape = [dict(zip(OBJECT_COLUMNS, o, strict=True)) for o in measure(found.labels, intensity)]
        inside = found.labels > 0
        n = np.bincount(found.labels[inside], minlength=found.n_objects + 1)
        total, peak = np.bincount(found.labels[inside], plane[inside], minlength=found.n_objects + 1), np.zeros(found.n_objects + 1)
        np.maximum.at(peak, found.labels[inside], plane[inside])
        return found.n_objects, [{k: o[k] for k in ("object_id", "area_pixels", "touches_border")} | {"marker_mean": float(total[i] / n[i]), "marker_max": float(peak[i])} for o in shape for i in (o["object_id"],)]

    def run(batches):
        for b in batches:
            rows = []
            for key, raw in zip(b["keep"], b["content"], strict=True):
                try:
                    rows.append((key, None, *one(bytes(raw or b""))))
                except (ValueError, MemoryError) as e:
                    rows.append((key, str(e) or type(e).__name__, None, None))
            frame = pd.DataFrame(rows, columns=[keep, "error", "n_objects", "objects"]).astype(object)
            yield frame.where(frame.notna(), None)

    return files.select(F.col(keep).alias("keep"), F.col(content).alias("content")).mapInPandas(run, f"`{keep}` {kind}, error string, n_objects long, objects array<struct<{MARKED}>>")


def percent_positive(files: DataFrame, keep: str = "path", method: str = "mixture", manual: float | None = None, **how) -> DataFrame:
    """A row per image, failed and empty ones too: error, n_objects, and the call over its objects' marker means by a method of markers.METHODS; the mixture has its evidence beside it."""
    from . import markers
    from .positivity import mixture_calls

    found = analyze_pair(files, keep=keep, **how)
    each = found.select(keep, F.explode("objects").alias("o")).select(keep, "o.marker_mean")
    if method != "mixture":
        called = markers.call(each, markers.choose_thresholds(each, keep, "marker_mean", method, manual), keep)
        return found.drop("objects").join(markers.summarize(found.where("error is null"), called, keep).withColumnsRenamed({"total": "n_total", "positive": "n_positive"}), keep, "left")
    return found.drop("objects").join(mixture_calls(each, keep, "marker_mean").withColumnRenamed("g", keep), keep, "left")
