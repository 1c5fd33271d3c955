"""Volumes as bricks."""

from __future__ import annotations

from voxlake.operators import volumes

GROUPS = "object string, frame int, stack_id string, in_stack int, position array<double>, row array<double>, column array<double>, spacing array<double>, between double, thickness double, slope double, intercept double"


def test_bricks_are_the_volume(spark):
    rows = [("a", k, [k * 10 + i for i in range(3)]) for k in (4, 0, 9, 2, 7)] + [("b", 1, [1, 2, 3, 4]), ("c", 5, [])]
    df = spark.createDataFrame(rows, "series_uid string, slice_index int, voxels array<int>")
    found = sorted(map(tuple, volumes.bricks(df, depth=2).collect()))
    assert found == [("a", 0, 0, 2, 0, [0, 1, 2, 20, 21, 22]), ("a", 1, 2, 2, 12, [40, 41, 42, 70, 71, 72]), ("a", 2, 4, 1, 24, [90, 91, 92]), ("b", 0, 0, 1, 0, [1, 2, 3, 4]), ("c", 0, 0, 1, 0, [])]
    sizes = {r.series_uid: (r.bricks, r.slices, r["size"]) for r in volumes.volume_sizes(volumes.bricks(df, depth=2)).collect()}
    assert sizes == {"a": (3, 5, 15), "b": (1, 1, 4), "c": (1, 1, 0)}
    assert volumes.bricks(df.where("false")).count() == 0


def test_physical_values_only_where_all_frames_have_them(spark):
    rows = [("v", 0, [1], [0.5], "u"), ("v", 1, [2], None, "u"), ("w", 0, [3], [1.5], "u"), ("w", 1, [4], [2.0], "x")]
    df = spark.createDataFrame(rows, "volume string, frame int, pixels array<int>, physical array<double>, units string")
    assert sorted((r.volume, r.brick, r.pixels, r.physical, r.units) for r in volumes.scalar_bricks(df, depth=1).collect()) == [("v", 0, [1], None, "u"), ("v", 1, [2], None, "u"), ("w", 0, [3], [1.5], None), ("w", 1, [4], [2.0], None)]


def geometry(spark, positions, objects=("o", 3, 1, "MONOCHROME2", 16), **changed):
    rows = []
    for k, z in enumerate(positions):
        row = {"stack_id": None, "in_stack": None, "position": [1.0, 2.0, z], "row": [1.0, 0.0, 0.0], "column": [0.0, 1.0, 0.0], "spacing": [0.5, 0.25], "between": None, "thickness": 4.0, "slope": float(k), "intercept": None}
        row |= {name: v for name, (frame, v) in changed.items() if frame == k}
        rows.append(("o", k, *row.values()))
    o = spark.createDataFrame([(objects[0], *objects[1:], 1.0, -5.0)], "object string, frames int, samples int, photometric string, bits_allocated int, slope double, intercept double")
    return volumes.enhanced_geometry(o, spark.createDataFrame(rows, GROUPS)).first()


def test_upper_median_and_order(spark):
    g = geometry(spark, [5.0, 0.0, 2.4, 7.5])
    # Steps 2.4, 2.6, 2.5: the upper of the middle ones of three is the middle.
    assert g.error is None and g.depth == 4 and abs(g.spacing[2] - 2.5) < 1e-9 and g.spacing[:2] == [0.25, 0.5] and g.origin == [1.0, 2.0, 0.0] and (g.slope, g.intercept) == (1.0, -5.0)
    g = geometry(spark, [0.0, 2.45, 5.0])
    assert abs(g.spacing[2] - 2.55) < 1e-9 and g.directions == [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def test_rules(spark):
    assert geometry(spark, [0.0, 1.0, 1.0]).error == "duplicate slice position"
    assert geometry(spark, [0.0, 1.0, 2.2]).error == "variable slice spacing"
    assert geometry(spark, [0.0, 1.0, 2.0], row=(1, None)).error == "no plane orientation"
    assert geometry(spark, [0.0, 1.0, 2.0], position=(1, None)).error == "no plane position"
    assert geometry(spark, [0.0, 1.0, 2.0], spacing=(2, None)).error == "no pixel spacing"
    assert geometry(spark, [0.0, 1.0, 2.0], column=(1, [0.0, 0.9, 0.1])).error == "inconsistent orientation"
    assert geometry(spark, [0.0, 1.0], ("o", 3, 1, "MONOCHROME2", 16)).error == "functional groups do not cover the frames"
    assert geometry(spark, [0.0], ("o", 1, 1, "MONOCHROME2", 16)).error == "a single frame"
    assert geometry(spark, [0.0, 1.0, 2.0], ("o", 3, 3, "RGB", 8)).error == "not grey"
    assert geometry(spark, [0.0, 1.0, 2.0], ("o", 3, 1, "MONOCHROME1", 32)).error == "bits allocated"
    assert geometry(spark, [0.0, 1.0, 2.0], ("other", 3, 1, "MONOCHROME1", 8)).error == "no functional groups"
