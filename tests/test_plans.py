"""Shapes of the physical plans that matter at scale."""

import os
import re

import pytest

from tesselon.plans.queries import queries

DATA = os.environ.get("TESSELON_TEST_DATA", "/root/testdata/sf0.001")


def plan(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables here")
    return queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["points_within_box", "cx_slice", "total_bounds", "partition_extents", "hilbert_distance", "morton_distance", "geohash_int", "geohash_string", "sjoin_points_within_boxes", "sjoin_boxes_cover_points", "sjoin_semi"])
def test_box_arithmetic_stays_in_generated_code(spark, name):
    text = plan(spark, name)
    assert not re.search("Python|Arrow|Pandas", text)


@pytest.mark.parametrize("name", ["sjoin_points_within_boxes", "sjoin_intersects", "sjoin_lines_cross_boxes"])
def test_spatial_joins_are_equi_joins(spark, name):
    text = plan(spark, name)
    assert not re.search("NestedLoop|Cartesian", text) and re.search("HashJoin|SortMergeJoin", text)


def test_only_needed_columns_are_read(spark):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(spark, "points_within_box"))[1]
    assert {c.split(":")[0] for c in schema.split(",")} == {"c_custkey", "c_mktsegment"}


def test_dissolve_shuffles_partial_unions(spark):
    text = plan(spark, "dissolve_sum")
    assert "MapInPandas" in text or "PythonMapInArrow" in text or "MapInArrow" in text
