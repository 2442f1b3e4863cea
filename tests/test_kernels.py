"""Image algorithms on shapes whose answers are known, and against brute force."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from fieldgrain.functions import codecs, kernels
from fieldgrain.operators import segment
from fieldgrain.operators.segment import SegmentParams

YX = np.mgrid[:240, :240]


def disks(size, places, r, background=0.0, bright=0.9):
    a = np.full((size, size), background, np.float32)
    for y, x in places:
        a[(YX[0, :size, :size] - y) ** 2 + (YX[1, :size, :size] - x) ** 2 <= r * r] = bright
    return a


masks = hnp.arrays(bool, st.tuples(st.integers(1, 9), st.integers(1, 9)))


@settings(max_examples=60, deadline=None)
@given(masks)
def test_distance_is_exact(mask):
    got = kernels.distance(mask)
    back = np.argwhere(~(np.pad(mask, 1) if mask.all() else mask)) - (1 if mask.all() else 0)
    for y, x in np.ndindex(mask.shape):
        want = np.sqrt(((back - [y, x]) ** 2).sum(axis=1).min()) if mask[y, x] else 0
        assert got[y, x] == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(hnp.arrays(np.int8, st.tuples(st.integers(1, 8), st.integers(1, 8)), elements=st.integers(0, 2)))
def test_components(values):
    got, want, n = kernels.components(values), np.zeros(values.shape, int), 0
    for y, x in np.ndindex(values.shape):
        if values[y, x] and not want[y, x]:
            n += 1
            stack = [(y, x)]
            while stack:
                j, i = stack.pop()
                if 0 <= j < values.shape[0] and 0 <= i < values.shape[1] and not want[j, i] and values[j, i] == values[y, x]:
                    want[j, i] = n
                    stack += [(j - 1, i), (j + 1, i), (j, i - 1), (j, i + 1)]
    assert (got == want).all()


def test_diagonal_pixels_are_apart_and_rings_fill():
    assert kernels.components(np.eye(2)).max() == 2
    ring = np.ones((5, 5), bool)
    ring[1:4, 1:4] = False
    assert kernels.fill_holes(ring).all()


@settings(max_examples=80, deadline=None)
@given(hnp.arrays(float, st.tuples(st.integers(1, 5), st.integers(1, 5)), elements=st.floats(0, 1)))
def test_assignment_is_optimal(gain):
    n, m = gain.shape
    best = max(sum(gain[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else max(sum(gain[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
    pairs = kernels.assign(gain)
    assert len(pairs) == min(n, m) and sum(gain[i, j] for i, j in pairs) == pytest.approx(best)


def test_assignment_prefers_the_total():
    assert kernels.assign(np.array([[0.505, 0.329], [0.329, 0]])) == [(0, 1), (1, 0)]


def test_small_objects_go_by_an_inclusive_size():
    a = np.zeros((60, 60), np.float32)
    a[10:20, 10:20] = 1
    for least, n in ((100, 1), (101, 0)):
        assert segment.segment(a, SegmentParams(min_size=least, smoothing_sigma=0, watershed=False)).n_objects == n


def test_touching_disks_are_one_or_two():
    a = disks(160, [(80, 55), (80, 98)], 25)
    assert segment.segment(a, SegmentParams(watershed=False)).n_objects == 1
    two = segment.segment(a, SegmentParams())
    assert two.n_objects == 2 and (two.mask == segment.segment(a, SegmentParams(watershed=False)).mask).all()


def test_uneven_light():
    places = [(60, 60), (120, 180), (190, 90)]
    a = (0.7 * YX[1] / 240 + 0.2 * (disks(240, places, 16) > 0)).astype(np.float32)
    assert segment.segment(a, SegmentParams(illumination_radius=30)).n_objects == 3


def test_flat_image_has_no_objects_nor_threshold():
    s = segment.segment(np.full((30, 30), 0.5, np.float32), SegmentParams())
    assert s.n_objects == 0 and s.threshold is None


def test_measurement():
    labels = np.zeros((100, 100), np.int32)
    labels[10:30, 10:40] = 1
    (row,) = segment.measure(labels, np.full((100, 100), 0.5, np.float32))
    o = dict(zip(segment.OBJECT_COLUMNS, row, strict=True))
    assert o["area_pixels"] == 600 and (o["centroid_x"], o["centroid_y"]) == (24.5, 19.5) and not o["touches_border"]
    assert o["major_axis_pixels"] == pytest.approx(4 * np.sqrt(899 / 12)) and o["minor_axis_pixels"] == pytest.approx(4 * np.sqrt(399 / 12))
    assert o["solidity"] == 1 and o["mean_intensity"] == 127.5
    disk = (disks(200, [(100, 100)], 40) > 0).astype(np.int32)
    assert dict(zip(segment.OBJECT_COLUMNS, segment.measure(disk, disk.astype(np.float32))[0], strict=True))["circularity"] == pytest.approx(1, abs=0.06)
    with pytest.raises(ValueError):
        segment.measure(labels, np.zeros((3, 3)))


def test_perimeters():
    disk = disks(120, [(60, 60)], 40) > 0
    assert kernels.perimeter(disk) == pytest.approx(263.76, abs=0.01) and kernels.crofton(disk) == pytest.approx(252.75, abs=0.01)
    assert kernels.perimeter(np.ones((20, 120), bool)) == 276


def test_units():
    assert kernels.to_unit(np.array([[4095]], np.uint16))[0, 0] == pytest.approx(4095 / 65535)
    assert kernels.to_unit(np.array([[0]], np.int16))[0, 0] == pytest.approx(0.5, abs=1e-4)
    assert (kernels.to_unit(np.full((2, 2), 7.0)) == 0).all()
    with pytest.raises(ValueError):
        kernels.pick_channel(np.zeros((2, 2)), "violet")


def test_gaussian_keeps_constants():
    assert np.allclose(kernels.gaussian(np.full((9, 9), 0.3), 1.5), 0.3)


@settings(max_examples=20, deadline=None)
@given(st.sampled_from([np.uint8, np.uint16]), st.integers(1, 9), st.integers(1, 9), st.integers(0, 9))
def test_codecs_round_trip(kind, h, w, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, np.iinfo(kind).max + 1, (h, w)).astype(kind)
    assert (codecs.read(codecs.write_png(a))[0] == a).all()
    assert (codecs.read(codecs.write_tiff(np.stack([a, a])))[0] == a).all() and codecs.size_of(codecs.write_tiff(a[None])) == (w, h)
    if kind == np.uint8:
        assert (codecs.read(codecs.write_bmp(a))[0] == a).all()


def test_stack_is_projected_and_garbage_is_an_error():
    stack = np.zeros((5, 32, 32), np.uint8)
    stack[3, 4, 5] = 200
    assert segment.load_image(codecs.write_tiff(stack))[4, 5] == 200
    with pytest.raises(codecs.ImageLoadError):
        segment.load_image(b"this is not an image")


def test_watershed_partitions_the_mask():
    mask = disks(100, [(50, 35), (50, 62)], 16) > 0
    labels = kernels.separate(mask)
    assert ((labels > 0) == mask).all() and labels.max() == 2


def test_thresholds_separate_two_levels():
    a = np.where(disks(100, [(30, 30), (70, 70)], 12) > 0, 0.8, 0.1) + np.random.default_rng(0).normal(0, 0.01, (100, 100))
    for name in kernels.THRESHOLDS:
        assert 0.05 < kernels.threshold_of(a, name) < 0.8
    assert kernels.threshold_of(np.ones((3, 3))) == float("inf")


def test_variants_kept_for_comparison():
    mask = disks(100, [(50, 30), (50, 64)], 16) > 0
    assert kernels.separate(mask, "adaptive").max() >= 2
    a = disks(100, [(50, 50)], 16)
    assert (kernels.refine((a > 0).astype(np.int32), a) > 0).sum() == (a > 0).sum()
    with pytest.raises(ValueError):
        kernels.separate(mask, "stars")


@settings(max_examples=60, deadline=None)
@given(masks.filter(lambda m: m.any()))
def test_convex_area_covers_the_mask(mask):
    n = kernels.convex_area(mask)
    assert mask.sum() <= n <= mask.size and (kernels.convex_area(np.ones_like(mask)) == mask.size)
    ys, xs = np.nonzero(mask)
    assert n <= (np.ptp(ys) + 1) * (np.ptp(xs) + 1)
