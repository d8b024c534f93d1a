"""Literal expected values."""

import math

import pytest
from pyspark.sql import functions as F

from inkloom.functions.fixed_values import PLATES, SHEETS
from inkloom.functions.mixing import scramble32
from inkloom.functions.numeric import round_half_even, round_half_up
from inkloom.operators import geometry as g
from inkloom.operators import preflight as p
from inkloom.operators import screen as sc
from inkloom.operators import separate as s


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_rounding_rules(spark):
    r = one(spark, round_half_up(F.lit(-2.5)).alias("a"), round_half_up(F.lit(2.5)).alias("b"),
            round_half_even(F.lit(2.5)).alias("c"), round_half_even(F.lit(-2.5)).alias("d"))
    assert tuple(r) == (-2, 3, 2.0, -2.0)


def test_scramble_matches_32_bit_product(spark):
    assert one(spark, scramble32(F.lit(12345)).alias("v")).v == 1349996928
    for v in (0, 1, 701, 65535, 2**31, 2**32 - 1):
        assert one(spark, scramble32(F.lit(v).cast("bigint")).alias("v")).v == ((v ^ 0x9E3779B9) * 2654435761) % 2**32


@pytest.mark.parametrize("w,h,cell,angle,marks", [
    (100, 50, 10, 0, 50), (100, 50, 10, 45, 121), (100, 50, 10, 90, 60), (0, 0, 0, 30, 1), (3600, 5280, 4, 45, 2464900)])
def test_mark_estimates(spark, w, h, cell, angle, marks):
    assert one(spark, p.estimate_grid_points(w, h, cell, angle).alias("n")).n == marks


def separated(spark, rgb, **kw):
    px = spark.createDataFrame([("i", 1, 1, 0, 0, *rgb)], "image_id string, w int, h int, x int, y int, r int, g int, b int")
    return {r["plate"]: r["cov"] for r in s.coverage(px, **kw).collect()}


@pytest.mark.parametrize("rgb,ink", [
    ((0, 0, 0), {"black": 1}), ((128, 128, 128), {"black": 1 - 128 / 255}), ((255, 255, 255), {}),
    ((255, 0, 0), {"magenta": 1, "yellow": 1}), ((0, 255, 0), {"cyan": 1, "yellow": 1}),
    ((0, 0, 255), {"cyan": 1, "magenta": 1}), ((0, 255, 255), {"cyan": 1}), ((255, 0, 255), {"magenta": 1}),
    ((255, 255, 0), {"yellow": 1}), ((191, 255, 255), {"cyan": 1 - 191 / 255})])
def test_separation(spark, rgb, ink):
    got = separated(spark, rgb)
    for plate in PLATES:
        assert got[plate] == pytest.approx(ink.get(plate, 0), abs=1e-12)


@pytest.mark.parametrize("rgb", [(255, 255, 255), (250, 250, 250), (255, 249, 255)])
def test_paper_stays_empty_on_inverted_plates(spark, rgb):
    assert set(separated(spark, rgb, invert=True).values()) == {0.0}


def test_inverted_cyan_of_red(spark):
    assert separated(spark, (255, 0, 0), invert=True)["cyan"] == 1


@pytest.mark.parametrize("level", [0, 32, 64, 128, 192, 249])
def test_grey_ramp(spark, level):
    assert separated(spark, (level,) * 3, grayscale=True)["black"] == pytest.approx((1 - level / 255) ** 0.75, abs=1e-10)
    got = separated(spark, (level,) * 3, grayscale=True, invert=True)["black"]
    assert got == pytest.approx((level / 255) ** 0.75, abs=1e-10)


def test_red_in_grayscale(spark):
    assert separated(spark, (255, 0, 0), grayscale=True) == {"black": pytest.approx((1 - 76 / 255) ** 0.75)}


def test_sheets(spark):
    sizes = {"letter": (2040, 2640), "a4": (1985, 2806), "8x10": (1920, 2400), "9x12": (2160, 2880),
             "11x15": (2640, 3600), "11x17": (2640, 4080), "13x19": (3120, 4560), "15x22": (3600, 5280)}
    assert [v[0] for v in SHEETS] == list(sizes)
    df = spark.createDataFrame([(k, o) for k in sizes for o in ("portrait", "landscape")], "sheet_id string, orientation string")
    for r in g.sheet_dims(df).collect():
        want = sizes[r.sheet_id]
        assert (r.sheet_w, r.sheet_h) == (want if r.orientation == "portrait" else want[::-1])


@pytest.mark.parametrize("job,want", [
    ((1000, 500, 2400, 3000, 100), (700, 1250, 1000, 500)), ((1000, 500, 2400, 3000, 50), (950, 1375, 500, 250)),
    ((101, 51, 401, 301, 50), (175, 138, 50, 25))])
def test_placement(spark, job, want):
    df = spark.createDataFrame([job], "src_w int, src_h int, sheet_w int, sheet_h int, scale_pct int")
    r = g.placement(df).first()
    assert (r.art_x, r.art_y, r.art_w, r.art_h) == want


def test_desktop_placement_pans(spark):
    df = spark.createDataFrame([(1000, 500, 2400, 3000, 100, 10, -20)],
                               "src_w int, src_h int, sheet_w int, sheet_h int, scale_pct int, offset_x int, offset_y int")
    r = g.placement(df, "desktop").first()
    assert (r.art_x, r.art_y) == (690, 1270)


def test_target_dims_without_request(spark):
    df = spark.createDataFrame([(2640, 3600)], "sheet_w int, sheet_h int")
    r = g.target_dims(df, preview=True).first()
    assert (r.target_w, r.target_h, r.sample_w, r.sample_h) == (2640, 3600, 807, 1100)


def test_lpi_and_steps(spark):
    r = one(spark, g.lpi(16).alias("a"), g.quantize_step(F.lit(7.13), 0.0, 10.0, 0.25, 2).alias("b"),
            g.normalize_angle(F.lit(375.0)).alias("c"), g.normalize_angle(F.lit(-15.0)).alias("d"))
    assert tuple(r) == (15.0, 7.25, 15.0, 345.0)


def test_outline_geometry(spark):
    df = spark.createDataFrame([("circle-outline", 20.0), ("cross", 100.0), ("triangle", 100.0)], "shape string, size double")
    area = {r.shape: r.area for r in sc.dot_geometry(df, stroke=2.5).collect()}
    assert area["circle-outline"] == pytest.approx(math.pi * (10**2 - 7.5**2))
    assert area["cross"] == pytest.approx(2 * 100 * 28 - 28 * 28)
    assert area["triangle"] == 5000
    full = sc.dot_geometry(spark.createDataFrame([("circle-outline", 4.0)], "shape string, size double"), stroke=10.0)
    assert full.first().area == pytest.approx(math.pi * 4)


def test_desktop_registration_corners(spark):
    df = spark.createDataFrame([(100, 80)], "w int, h int")
    rows = sc.registration_marks(df, size=20, offset=10, weight=2.0, variant="desktop").orderBy("mark").collect()
    assert [(r.x, r.y) for r in rows] == [(10, 10), (90, 10), (90, 70), (10, 70)]
    assert rows[0].weight == 4.0
    middle = sc.registration_marks(df, mode="centered").orderBy("mark").collect()
    assert [(r.x, r.y, r.size) for r in middle] == [(50, 14, 7), (50, 66, 7)]
