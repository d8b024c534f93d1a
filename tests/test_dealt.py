"""Sheets dealt out by image: no query over parts moves or broadcasts pixels, and the operators behind them equal plain search."""

import os
import re

import pytest

import __spark_entry__ as contract
from inkloom.operators import dither, screen
from inkloom.sources import sinks

SF = "/root/testdata/sf0.001"
QUERIES = contract.queries()
STILL = """mark_histogram dot_size sample_coverage splat_marks svg_documents moire_swatch cross_channel_bleed svg_marks smear_drag block_copy
    unsharp_sharpen grid_warp line_marks block_shift gaussian_blur dot_size_desktop macroblock_modes iso_contours bitmap_sort
    bumped_lattice screen_lattice""".split()


def plan_of(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", STILL)
def test_only_headers_are_exchanged(spark, name):
    plan = plan_of(spark, name)
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    # Totals per plate or tile rank are exchanged once they are counted.
    moved = [m for m in moved if not re.search(r"hashpartitioning\(plate#\d+(, size_class#\d+|, _groupingexpression#\d+)?, \d+\)", m)]
    assert moved and all(re.search(r"hashpartitioning\(image_id#\d+L, \d+\), REPARTITION_BY_NUM", m) for m in moved), moved


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", [*STILL, "flatten_layers", "place_artwork", "frayed_edges", "glitch_chain", "densest_tiles"])
def test_no_broadcast_of_a_row_per_sheet(spark, name):
    assert "Broadcast" not in plan_of(spark, name)


def test_united_spans_equal_plain_discs(spark):
    """Discs over the borders of words and of the frame, on a frame wider than two words."""
    marks = [("a", "black", 150, 40, cx, cy, r) for cx, cy, r in
             ((63.0, 5.0, 4.0), (64.4, 6.0, 1.0), (0.0, 0.0, 6.0), (149.0, 39.0, 70.0), (-9.0, 3.0, 5.0), (127.5, 20.0, 0.4))]
    df = spark.createDataFrame(marks, "image_id string, plate string, w int, h int, cx double, cy double, radius double")
    wanted = set()
    for _, _, w, h, cx, cy, r in marks:
        side = max(1.0, round(r * 2))
        reach = 0 if side <= 2 else int(side // 2)
        wanted |= {(x, y) for x in range(w) for y in range(h) if (x - round(cx)) ** 2 + (y - round(cy)) ** 2 <= reach * reach}
    got = [(r.x, r.y) for r in screen.splat_marks(df).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    plan = screen.splat_marks(df)._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan


def test_coordinates_as_text(spark):
    values = [0.0, -0.0, 1.0, -1.5, 0.00004, -0.00004, 0.00005, -0.00005, 12.34567, -12.34567, 9.99995, 16384.0, 99999.99994]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(sinks.number_text(df.v)).collect()]
    assert got == ["0.0000", "0.0000", "1.0000", "-1.5000", "0.0000", "0.0000", "0.0001", "-0.0001", "12.3457", "-12.3457", "10.0000", "16384.0000", "99999.9999"]
    assert "format_string" not in df.select(sinks.number_text(df.v))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", ["error_diffusion", "error_diffusion_desktop", "glitch_diffusion"])
def test_diffusion_exchanges_headers_only(spark, name):
    moved = [line for line in plan_of(spark, name).splitlines() if "Exchange" in line]
    assert moved and all(re.search(r"hashpartitioning\(image_id#\d+L, \d+\), REPARTITION_BY_NUM", m) for m in moved), moved


def test_stacked_plates_equal_scanned_ones(spark):
    sizes = [(1, 1), (7, 5), (5, 7), (7, 5), (30, 20)]
    px = [(i, w, h, plate, x, y, (i * 7 + x * 13 + y * 29 + len(plate)) % 97 / 96) for i, (w, h) in enumerate(sizes)
          for plate in ("cyan", "black") for x in range(w) for y in range(h)]
    df = spark.createDataFrame(px, "image_id long, w int, h int, plate string, x int, y int, cov double").repartition(3, "image_id")
    for run in (lambda s: dither.error_diffusion(df, "stucki", 5, 0.9, "tilt", 0.5, spread=s),
                lambda s: dither.error_diffusion_desktop(df, "stucki", 4, 0.9, "circuit", 0.4, spread=s),
                lambda s: dither.glitch_diffusion(df, broken=0.6, bias=0.5, bias_angle=60, overflow=0.3, reset=0.9, spread=s)):
        whole, lines = run(False), run(True)
        assert whole.dtypes == lines.dtypes
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, lines.collect())) and whole.count() == len(px)
