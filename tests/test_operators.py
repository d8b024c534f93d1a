"""Operators against brute force on small fields, and invariants."""

import math
import random

import pytest
from grids import as_grids
from pyspark.sql import functions as F

from inkloom.functions import wavefront
from inkloom.functions.fixed_values import DIFFUSION_KERNELS, PLATES
from inkloom.operators import blocks, compose, dither, geometry, glitch, paths, screen, separate, tiles
from inkloom.session import checkpoint


def same(got, want, tol=1e-9):
    assert got.keys() == want.keys()
    for key, grid in want.items():
        assert len(got[key]) == sum(len(r) for r in grid)
        for y, row in enumerate(grid):
            for x, v in enumerate(row):
                assert got[key][x, y] == pytest.approx(v, abs=tol), (key, x, y)


def diffuse_web(grid, kernel, levels, intensity):
    import numpy as np

    h, w, top = len(grid), len(grid[0]), levels - 1
    err = np.zeros((h + 2, w), np.float32)
    out = [[0.0] * w for _ in range(h)]
    for y in range(h):
        for x in (range(w - 1, -1, -1) if y % 2 else range(w)):
            value = min(1.0, max(0.0, grid[y][x] + float(err[y, x])))
            out[y][x] = math.floor(value * top + 0.5) / top
            e = (value - out[y][x]) * intensity
            for dy, dx, wt in kernel:
                nx = x - dx if y % 2 else x + dx
                if 0 <= nx < w:
                    err[y + dy, nx] = np.float32(float(err[y + dy, nx]) + e * wt)
    return out


def diffuse_desktop(grid, kernels, levels, intensity, overflow=0.0, resets=()):
    import numpy as np

    h, w, top = len(grid), len(grid[0]), levels - 1
    base = np.array(grid, np.float32).astype(float)
    err = np.zeros((h + 2, w), np.float32)
    out = [[0.0] * w for _ in range(h)]
    for y in range(h):
        if y in resets:
            base[y] = np.clip(base[y] + err[y], 0, 1)
            err[y] = 0
        for x in range(w):
            value = base[y, x] + float(err[y, x])
            inside = min(1.0, max(0.0, value))
            if overflow:
                inside = inside * (1 - overflow) + (value - math.floor(value)) * overflow
            tone = round(inside * top) / top
            out[y][x] = min(1.0, max(0.0, tone))
            for dy, dx, wt in kernels:
                if 0 <= x + dx < w:
                    err[y + dy, x + dx] = np.float32(float(err[y + dy, x + dx]) + (value - tone) * intensity * wt)
    return out


@pytest.mark.parametrize("algorithm", ["floyd-steinberg", "jarvis-judice-ninke", "stucki", "burkes", "atkinson", "none"])
def test_error_diffusion_equals_pixel_loop(field, algorithm):
    df, grids = field
    offsets, div = DIFFUSION_KERNELS[algorithm if algorithm != "none" else "floyd-steinberg"]
    kernel = [(a, b, c / div) for a, b, c in offsets]
    want = {k: diffuse_web(v, kernel, 4, 0.8) for k, v in grids.items()}
    same(as_grids(dither.error_diffusion(df, algorithm, 4, 0.8)), want)


def test_error_diffusion_terms_enter_before_quantising(field):
    df, grids = field
    offsets, div = DIFFUSION_KERNELS["stucki"]
    kernel = [(a, b, c / div) for a, b, c in offsets]

    def base(x, y, v):
        raw = v
        v += ((x - y) % 8 if x >= y else -((y - x) % 8)) / 8 * 0.5 * 0.25
        angle = 30 * math.pi / 180
        v += math.sin(x * math.cos(angle) + y * math.sin(angle)) * 0.4 * 0.08
        v += ((x * 7 + y * 11) % 5 - 2) * 0.5 * 0.03
        if (x + y) % 9 == 0:
            v += 0.5 * 0.12
        if y % 6 == 0:
            v = raw
        return v + 0.3 * 0.02

    want = {k: diffuse_web([[base(x, y, v) for x, v in enumerate(r)] for y, r in enumerate(g)], kernel, 5, 0.9)
            for k, g in grids.items()}
    got = dither.error_diffusion(df, "stucki", 5, 0.9, "tilt", 0.5, bias=0.4, bias_angle=30, broken=0.5, overflow=0.5,
                                 reset=0.9, bleed=0.3)
    same(as_grids(got), want)


@pytest.mark.parametrize("modulation", ["none", "column", "row", "dispersed", "medium", "heavy", "circuit", "tilt", "grid"])
def test_desktop_diffusion_equals_pixel_loop(field, modulation):
    df, grids = field
    kernel = dither._edited_kernel("jarvis-judice-ninke", modulation, 0.6)
    assert sum(w for _, _, w in kernel) == pytest.approx(1.0)
    want = {k: diffuse_desktop(v, kernel, 4, 0.9) for k, v in grids.items()}
    same(as_grids(dither.error_diffusion_desktop(df, "jarvis-judice-ninke", 4, 0.9, modulation, 0.6)), want)


def test_glitch_diffusion_equals_pixel_loop(field):
    df, grids = field
    want = {}
    for (image, plate), grid in grids.items():
        kernel = dither.damaged_kernel("floyd-steinberg", plate, 0.6, 0.5, 60)
        assert sum(w for _, _, w in kernel) == pytest.approx(1.0)
        want[image, plate] = diffuse_desktop(grid, kernel, 4, 0.8, 0.3, dither.wiped_rows(len(grid), plate, 0.9))
    same(as_grids(dither.glitch_diffusion(df, broken=0.6, bias=0.5, bias_angle=60, overflow=0.3, reset=0.9)), want)


@pytest.mark.parametrize("algorithm", sorted(DIFFUSION_KERNELS))
def test_diagonals_equal_the_serial_scan_to_the_last_bit(monkeypatch, algorithm):
    import numpy as np

    rng = np.random.default_rng(len(algorithm))
    offsets, div = DIFFUSION_KERNELS[algorithm]
    kernel = [(a, b, c / div) for a, b, c in offsets]
    for w, h, n, band in ((9, 7, 3, 1), (1, 5, 2, 60), (17, 23, 2, 200), (6, 1, 1, 1000)):
        monkeypatch.setattr(wavefront, "BAND", band)
        plates = rng.random((n, h, w)).astype(np.float32).astype(float)
        wiped = {y for y in range(h) if y % 4 == 2}
        want = [diffuse_desktop(p.tolist(), kernel, 5, 0.9, 0.4, wiped) for p in plates]
        rows, before, out = wavefront.band_rows(w, h, n), np.zeros((2, n, w)), []
        for y in range(0, h, rows):
            flags = np.array([v in wiped for v in range(y, min(h, y + rows))])
            tones, before = wavefront.diffuse_band(plates[:, y:y + rows].transpose(1, 0, 2), before, kernel, 5, 0.9, 0.4, flags)
            out.append(np.clip(tones, 0, 1))
        assert np.concatenate(out).transpose(1, 0, 2).tolist() == want


def test_noise_in_tasks_equals_noise_in_columns(spark):
    from inkloom.functions.mixing import noise_at, unit_noise

    rows = [(x, y, s) for x in (-3, 0, 1, 500) for y in (-2, 0, 9) for s in (0, 42, 99)]
    df = spark.createDataFrame(rows, "x long, y long, s long").select("x", "y", "s", unit_noise(F.col("x"), F.col("y"), F.col("s")).alias("u"))
    assert all(r.u == noise_at([r.x], r.y, r.s)[0] for r in df.collect())


def test_no_pixel_table_is_broadcast(field):
    from inkloom.operators import blocks, geometry, screen

    df, _ = field
    marks = df.selectExpr("image_id", "plate", "w", "h", "w sw", "h sh", "x + 0.5 cx", "y + 0.5 cy")
    stereo = blocks.compose_stereo(df.where("cov > 0.5"), df.withColumn("a", F.lit(255)))
    for out in (glitch.grid_warp(df, 2.0, 3), glitch.block_shift(df, 0.5, 4), glitch.block_copy(df, 0.5, 4), glitch.smear_drag(df, 0.5, 4),
                glitch.macroblock_modes(df, 0.5, 0.4, 4), screen.sample_coverage(marks, df), dither.unsharp_sharpen(df, 0.5), stereo,
                geometry._gather(df.selectExpr("image_id", "x src_x", "y src_y"), df, ["image_id"], ["cov"])):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_missing_raster_line_is_refused(field):
    df, _ = field
    with pytest.raises(Exception, match="raster lines missing"):
        dither.error_diffusion(df.where("y <> 3")).count()


def test_results_do_not_depend_on_partitioning(field):
    df, _ = field
    run = lambda d: as_grids(glitch.glitch_chain(d, 2, 2, sliceShift=2, gridWarp=2.0, warpScale=3, bitmapSort=0.5))
    assert run(df.repartition(1)) == run(df.repartition(64))
    blur = lambda d: as_grids(dither.error_diffusion(d, "burkes"))
    assert blur(df.repartition(1)) == blur(df.repartition(64))


def test_remaps_keep_every_pixel_and_range(field):
    df, grids = field
    size = sum(len(g) * len(g[0]) for g in grids.values())
    for out in (glitch.slice_shift(df, 9, 2), glitch.vertical_slice_shift(df, 30, 2), glitch.slice_roll(df, 5, 2),
                glitch.channel_desync(df, 0.9), glitch.block_shift(df, 0.8, 4), glitch.block_copy(df, 0.7, 4),
                glitch.macroblock_corrupt(df, 0.9, 0.5, 4), glitch.macroblock_modes(df, 0.9, 0.5, 4),
                glitch.smear_band(df, 0.9, 6), glitch.bitmap_sort(df, 0.7, vertical=True), glitch.frayed_edges(df, 4, 4)):
        r = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("image_id", "plate", "x", "y").alias("d"),
                    F.min("cov").alias("lo"), F.max("cov").alias("hi")).first()
        assert r.n == r.d == size and r.lo >= 0 and r.hi <= 1


def test_clamped_shift_equals_gather(field):
    df, _ = field
    a = as_grids(glitch.slice_shift(df, 7, 2))
    b = as_grids(glitch.sample_field(df, sliceShift=7, sliceSize=2))
    assert a == b
    assert as_grids(glitch.vertical_slice_shift(df, 7, 2)) == as_grids(
        glitch.sample_field(df, verticalSliceShift=7, verticalSliceSize=2))


def test_block_moves_hide_corruption(field):
    df, _ = field
    plain = as_grids(glitch.glitch_field(df, blockShift=0.5, blockShiftSize=4))
    assert plain == as_grids(glitch.glitch_field(df, blockShift=0.5, blockShiftSize=4, macroblockCorrupt=1.0))


def test_zero_amounts_leave_the_field(field):
    df, _ = field
    assert glitch.glitch_chain(df).schema == df.schema
    assert as_grids(glitch.glitch_chain(df)) == as_grids(df)


def test_vertical_sort_is_transposed_horizontal_sort(field):
    df, _ = field
    flip = lambda d: d.select("image_id", F.col("h").alias("w"), F.col("w").alias("h"), "plate",
                              F.col("y").alias("x"), F.col("x").alias("y"), "cov")
    assert as_grids(glitch.bitmap_sort(df, 0.6, vertical=True)) == as_grids(flip(glitch.bitmap_sort(flip(df), 0.6)))


def test_macroblock_modes_brute_force(field):
    """Every output value is the dimmed, crushed or moved value of a pixel of the same plate."""
    df, grids = field
    out = as_grids(glitch.macroblock_modes(df, 1.0, 0.0, 4))
    for key, cells in out.items():
        pool = {v for row in grids[key] for v in row}
        steps = {k / n for n in (1, 2, 3, 4) for k in range(n + 1)}
        assert all(any(abs(v - c) < 1e-9 for c in pool | steps) for v in cells.values())
    dim = as_grids(glitch.macroblock_modes(df, 1.0, 1.0, 4))
    assert any(v != grids["a", "cyan"][y][x] for (x, y), v in dim["a", "cyan"].items())


def test_runs_expand_to_the_mask(field):
    df, grids = field
    runs = dither.coalesce_runs(df).collect()
    ink = {(r.image_id, r.plate, x, r.y) for r in runs for x in range(r.x0, r.x0 + r.length)}
    assert ink == {(i, p, x, y) for (i, p), g in grids.items() for y, row in enumerate(g) for x, v in enumerate(row) if v >= 0.5}
    ends = {(r.image_id, r.plate, r.y, r.x0 + r.length) for r in runs}
    assert not ends & {(r.image_id, r.plate, r.y, r.x0) for r in runs}


@pytest.mark.parametrize("sigma,tile", [(0.7, 256), (3.0, 256), (0.7, 4), (1.2, 3), (3.0, 1)])
def test_blur_mirrors_borders(field, monkeypatch, sigma, tile):
    df, grids = field
    monkeypatch.setattr(tiles, "TILE", tile)
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * k * k / sigma**2) for k in range(-r, r + 1)]
    wt = [v / sum(raw) for v in raw]

    def at(line, k):
        n = len(line)
        k %= 2 * n
        return line[k if k < n else 2 * n - 1 - k]

    smooth = lambda line: [sum(at(line, i + k) * wt[k + r] for k in range(-r, r + 1)) for i in range(len(line))]
    want = {}
    for key, g in grids.items():
        cols = [smooth(list(c)) for c in zip(*g)]
        want[key] = [smooth(list(row)) for row in zip(*cols)]
    same(as_grids(dither.gaussian_blur(df, sigma)), want)


def test_wide_blur_has_one_exchange_and_no_lag(field):
    df, _ = field
    out = dither.unsharp_sharpen(df, 0.5, 10.0)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    planned = out._jdf.queryExecution().executedPlan().toString()
    assert planned.count("Exchange hashpartitioning") == 1 and "lag(" not in plan and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("tile", [256, 4, 1])
def test_contours_do_not_depend_on_tiles(field, monkeypatch, tile):
    df, grids = field
    monkeypatch.setattr(tiles, "TILE", tile)
    got = {(r.image_id, r.plate, r.x, r.y) for r in blocks.iso_contours(df).collect()}
    inside = lambda g, x, y: sum(g[y + j][x + i] > 0.5 for j in (0, 1) for i in (0, 1)) % 4 != 0
    assert got == {(*k, x, y) for k, g in grids.items() for y in range(len(g) - 1) for x in range(len(g[0]) - 1) if inside(g, x, y)}


def test_noise_moments(spark):
    flat = spark.range(200).select(F.lit("i").alias("image_id"), F.lit(200).alias("w"), F.lit(200).alias("h"),
                                   F.lit("black").alias("plate"), F.col("id").cast("int").alias("y"),
                                   F.explode(F.sequence(F.lit(0), F.lit(199))).alias("x"), F.lit(0.5).alias("cov"))
    r = dither.add_noise(flat, 0.3).agg(F.avg("cov").alias("m"), F.stddev("cov").alias("s")).first()
    assert r.m == pytest.approx(0.5, abs=0.002) and r.s == pytest.approx(0.09, abs=0.002)


def test_stereogram_equals_sequential_copy(field):
    df, grids = field
    depth = df.where("plate = 'cyan'")
    for sep, inten, dot in ((12, 80, 2), (3, 100, 1), (1, 100, 2), (40, 50, 2)):
        got = blocks.stereogram(depth, sep, inten, dot, 3, "vertical lines", 1, expand=False)
        cells = {(r.image_id, r.cx, r.cy): r.color for r in got.collect()}
        for (image, plate), g in grids.items():
            if plate != "cyan":
                continue
            h, w = len(g) // dot, len(g[0]) // dot
            gap = sep // dot
            strip = max(1, gap)
            for y in range(h):
                line = [0] * w
                for x in range(w):
                    if x < strip:
                        line[x] = x % 3
                        continue
                    src = x - gap + min(int(gap * (inten / 100) * g[y * dot][x * dot]), x - 1)
                    line[x] = line[src] if 0 <= src < x else line[max(0, x - gap)]
                assert [cells[image, x, y] for x in range(w)] == line


def test_place_artwork_filters(spark):
    px = spark.createDataFrame([("i", 2, 1, 0, 0, 0, 0, 0), ("i", 2, 1, 1, 0, 100, 200, 40)],
                               "image_id string, w int, h int, x int, y int, r int, g int, b int")
    frame = spark.createDataFrame([("i", 6, 3, 1, 1, 4, 1, False, "horizontal"), ], "image_id string, sheet_w int, "
                                  "sheet_h int, art_x int, art_y int, art_w int, art_h int, mirror boolean, mirror_direction string")
    near = {(r.x, r.y): r.r for r in geometry.place_artwork(px, frame).collect()}
    assert len(near) == 18 and [near[x, 1] for x in range(6)] == [255, 0, 0, 100, 100, 255]
    soft = {(r.x, r.y): r.r for r in geometry.place_artwork(px, frame, "bilinear").collect()}
    assert len(soft) == 18 and [soft[x, 1] for x in range(6)] == [255, 0, 25, 75, 100, 255]
    turned = geometry.place_artwork(px, frame.withColumn("mirror", F.lit(True)))
    assert [r.r for r in turned.where("y = 1").orderBy("x").collect()] == [255, 100, 100, 0, 0, 255]


def test_pixelate_partial_blocks(spark):
    rows = [("i", 5, 3, x, y, 10 * x, y, x * y, 255) for y in range(3) for x in range(5)]
    px = spark.createDataFrame(rows, "image_id string, w int, h int, x int, y int, r int, g int, b int, a int")
    out = {(r.x, r.y): r.r for r in blocks.pixelate(px, 2).collect()}
    assert len(out) == 15 and out[0, 0] == 5 and out[4, 2] == 40


def test_splat_overlap_and_lattice_estimate(spark):
    head = spark.createDataFrame([("i", "cyan", 60, 40, 60, 40, 8.0, 30.0)],
                                 "image_id string, plate string, w int, h int, sw int, sh int, cell double, angle double")
    marks = screen.screen_lattice_desktop(head)
    from inkloom.operators.preflight import estimate_grid_points
    most = head.select(estimate_grid_points(F.col("w"), F.col("h"), F.col("cell"), F.col("angle")).alias("n")).first().n
    assert 0 < marks.count() <= most
    discs = marks.withColumn("radius", F.lit(6.0))
    out = screen.splat_marks(discs)
    assert out.count() == out.select("x", "y").distinct().count() <= 60 * 40


def test_long_path_chunks_do_not_matter(spark):
    pts = [("p", i, 10 * math.cos(i / 5) * (i % 17), 7.0 * i if i % 9 else 7.0 * (i - 1)) for i in range(100)]
    pts += [("q", i, 3.0, 4.0) for i in range(6)] + [("s", 0, 1.0, 1.0), ("s", 1, 2.0, 2.0)]
    df = spark.createDataFrame(pts, "path_id string, seq int, px double, py double")
    key = lambda d: sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in d.collect())
    for fn in (paths.smooth_path, paths.path_tangents):
        assert key(fn(df, chunk=7)) == key(fn(df))
    targets = spark.createDataFrame([("p", i, 13.0 * i - 60, 31.0 * (i % 20)) for i in range(40)] + [("q", 0, 1.0, 1.0), ("z", 0, 1.0, 1.0)],
                                    "path_id string, point_id int, x double, y double")
    small = key(paths.nearest_path_angle(targets, df, 20.0, 0.5, chunk=5))
    assert small == key(paths.nearest_path_angle(targets, df, 20.0, 0.5, chunk=1, levels=3))
    assert small == key(paths.nearest_path_angle(targets, df, 20.0, 0.5, chunk=1000))
    assert len(small) == 42
    tang = {(r.path_id, r.seq): r.tangent for r in paths.path_tangents(df).collect()}
    assert all(tang["q", i] == 0 for i in range(6))


def test_nearest_segment_of_a_path_of_a_million_points(spark):
    import numpy as np

    n = 1_000_000
    points = spark.range(n, numPartitions=8).selectExpr(
        "'p' AS path_id", "CAST(id AS INT) AS seq", "(id % 1000 + 0.25D) * IF((id div 1000) % 2 = 0, 1, -1) AS px", "CAST(id div 1000 AS DOUBLE) * 3 AS py")
    spots = [("p", i, 37.0 * i - 900, 61.0 * i) for i in range(50)] + [("p", 50, 5e5, -7.0), ("q", 0, 1.0, 1.0)]
    targets = spark.createDataFrame(spots, "path_id string, point_id int, x double, y double")
    got = {(r.path_id, r.point_id): r.nearest for r in paths.nearest_path_angle(targets, points).collect()}
    seq = np.arange(n)
    x, y = (seq % 1000 + 0.25) * np.where(seq // 1000 % 2 == 0, 1, -1), seq // 1000 * 3.0
    x1, y1, dx, dy = x[:-1], y[:-1], np.diff(x), np.diff(y)
    for p, i, tx, ty in spots[:-1]:
        t = np.clip(((tx - x1) * dx + (ty - y1) * dy) / (dx * dx + dy * dy + 1e-10), 0, 1)
        assert got[p, i] == int(np.argmin(np.hypot(tx - x1 - t * dx, ty - y1 - t * dy)))
    assert got["q", 0] is None and paths.tree_levels(points, 256) == 2 and paths.tree_levels(points, 8) == 3
    tree = paths._box_tree(points.selectExpr("path_id", "seq AS node", "px AS bx0", "px AS bx1", "py AS by0", "py AS by1"), 2)
    assert tree[0].select(F.max(F.size("kids"))).first()[0] == 64 and tree[1].select(F.max(F.size("kids"))).first()[0] == 64


@pytest.mark.parametrize("count", [1, 3, 4, 5, 17])
def test_flattened_layers_equal_a_fold(spark, count):
    rng = random.Random(count)
    heads = [("i", 7 * z, 6, 5, z % 4 != 1, 100, rng.choice([1.0, 0.5]), z % 2, 0) for z in range(count)]
    pixels = {(z, x, y): (*(rng.randrange(256) for _ in "rgb"), rng.choice([0, 90, 255])) for z in range(count) for x in range(6) for y in range(5)
              if rng.random() < 0.8}
    layers = spark.createDataFrame(heads, "image_id string, z int, w int, h int, visible boolean, scale_pct int, opacity double, offset_x int, offset_y int")
    df = spark.createDataFrame([("i", 7 * z, x, y, *v) for (z, x, y), v in pixels.items()],
                               "image_id string, z int, x int, y int, r int, g int, b int, a int").repartition(4)
    want = {}
    for z, (_, _, w, _, visible, _, opacity, dx, _) in enumerate(heads):
        for (k, x, y), (*rgb, a) in pixels.items() if visible else ():
            if k == z and x + dx < w:
                *under, low = want.get((x + dx, y), (0.0, 0.0, 0.0, 0.0))
                own = int(a * opacity) / 255
                alpha = own + low * (1 - own)
                want[x + dx, y] = (*((t * own + u * low * (1 - own)) / alpha if alpha else 0.0 for t, u in zip(rgb, under)), alpha)
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a / 255) for r in compose.flatten_layers(layers, df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_flattening_collects_no_lists(spark):
    from inkloom.plans.tables import layer_headers, layer_pixels

    sf = "/root/testdata/sf0.001"
    out = compose.flatten_layers(layer_headers(spark, sf), layer_pixels(spark, sf), most=3)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan and "aggregate(" not in plan


def test_compose_and_paper(spark):
    cov = spark.createDataFrame([("i", 1, 1, "cyan", 0, 0, 1.0), ("i", 1, 1, "black", 0, 0, 0.5)],
                                "image_id string, w int, h int, plate string, x int, y int, cov double")
    r = compose.compose_cmyk(cov).first()
    assert (r.r, r.g, r.b) == (0, 127, 127)


def test_sketches_of_days_add_up_to_the_corpus(spark):
    rows = spark.range(60_000).selectExpr("CAST(id % 40 AS STRING) AS image_id", "IF(id % 3 = 0, 'cyan', 'black') AS plate",
                                          "CAST(pmod(xxhash64(id), 100003) AS DOUBLE) / 100003 * IF(id % 5 = 0, 0, 1) AS cov")
    days = [separate.plate_sketches(rows.where(f"CAST(image_id AS INT) % 3 = {d}")) for d in range(3)]
    stored = separate.merged_sketches(days[0].unionByName(days[1]), "plate")
    total = separate.merged_sketches(stored.unionByName(separate.merged_sketches(days[2], "plate")), "plate")
    got = {r.plate: r for r in separate.sketch_report(total, 0.5, 0.9).collect()}
    exact = rows.groupBy("plate").agg(F.count("*").alias("n"), F.count_if(F.col("cov") > 0).alias("ink"), F.avg("cov").alias("mean"),
                                      F.countDistinct(F.round("cov", 6)).alias("levels"), F.collect_list("cov").alias("all"))
    for r in exact.collect():
        s = got[r.plate]
        assert (s.pixels, s.ink_pixels, s.mean_cov) == (r.n, r.ink, pytest.approx(r["mean"], abs=1e-6))
        assert abs(s.levels / r.levels - 1) < 0.03
        for share, value in ((0.5, s.cov_50), (0.9, s.cov_90)):
            below, upto = sum(v < value for v in r["all"]) / r.n, sum(v <= value for v in r["all"]) / r.n
            assert below - 0.02 <= share <= upto + 0.02


def test_plate_stats_totals(field):
    df, grids = field
    rows = {(r.plate, r.image_id): r for r in separate.plate_stats(df).collect()}
    assert rows[None, None].pixels == df.count()
    assert rows["cyan", "a"].mean_cov == pytest.approx(sum(map(sum, grids["a", "cyan"])) / 117, abs=1e-6)


def sorted_and_frayed(grid, plate, amount, vertical, fray_x, fray_y):
    """The line sort and fraying of one plate by nested loops."""
    h, w = len(grid), len(grid[0])
    wrap = lambda v: ((v ^ 0x9E3779B9) & 0xFFFFFFFF) * 2654435761 & 0xFFFFFFFF
    n, m = (w, h) if vertical else (h, w)
    state, order = 99 + 17 * PLATES.index(plate), list(range(n))
    for last in range(n - 1, 0, -1):
        state = (state * 1664525 + 1013904223) % 2**32
        other = state * (last + 1) >> 32
        order[last], order[other] = order[other], order[last]
    spot = (lambda k, p: (p, k)) if vertical else (lambda k, p: (k, p))
    out = [row[:] for row in grid]
    for k in order[:max(1, math.floor(n * amount))] if amount else []:
        p = 0
        while p < m:
            q = p
            while q < m and out[spot(k, q)[0]][spot(k, q)[1]] > 0.1:
                q += 1
            values = sorted(out[spot(k, r)[0]][spot(k, r)[1]] for r in range(p, q))
            for r, v in zip(range(p, q), values, strict=True):
                out[spot(k, r)[0]][spot(k, r)[1]] = v
            p = max(q, p + 1)
    ink = [(x, y) for y in range(h) for x in range(w) if out[y][x] > 0.1]
    rx, ry = math.floor(fray_x * 1.5), math.floor(fray_y * 1.5)
    if not ink:
        return {(x, y): out[y][x] for y in range(h) for x in range(w)}
    xs, ys = {x for x, _ in ink}, {y for _, y in ink}
    done = {}
    for y in range(h):
        for x in range(w):
            inset = lambda v, f, c, r: wrap(v * f + c) % (r + 1)
            a, b, c, d = inset(y, 17, 701, rx), inset(y, 31, 907, rx), inset(x, 17, 1301, ry), inset(x, 31, 1709, ry)
            gone = y in ys and (0 < a < max(10, 2 * rx) and min(xs) <= x < min(xs) + a or 0 < b < max(10, 2 * rx) and max(xs) - b <= x <= max(xs))
            gone |= x in xs and (0 < c < max(10, 2 * ry) and min(ys) <= y < min(ys) + c or 0 < d < max(10, 2 * ry) and max(ys) - d <= y <= max(ys))
            done[x, y] = 0.0 if gone else out[y][x]
    return done


@pytest.mark.parametrize("amount,vertical,fray_x,fray_y", [(0.6, False, 2, 3), (0.6, True, 2, 3), (1.0, True, 0, 4), (0, False, 3, 0), (0.3, False, 0, 0)])
def test_sorted_and_frayed_lines_equal_loops(field, amount, vertical, fray_x, fray_y):
    df, grids = field
    got = as_grids(glitch.glitch_chain(df, fray_x, fray_y, bitmapSort=amount, bitmapSortVertical=vertical))
    assert got == {k: sorted_and_frayed(g, k[1], amount, vertical, fray_x, fray_y) for k, g in grids.items()}


def test_fraying_over_word_borders(spark):
    rng = random.Random(5)
    grid = [[rng.choice([0.0, 0.0, 0.05, 0.9]) * (60 < x < 190 and 3 < y < 130) for x in range(200)] for y in range(140)]
    df = spark.createDataFrame([("a", 200, 140, "black", x, y, grid[y][x]) for y in range(140) for x in range(200)],
                               "image_id string, w int, h int, plate string, x int, y int, cov double")
    assert as_grids(glitch.frayed_edges(df, 6, 5))["a", "black"] == sorted_and_frayed(grid, "black", 0, False, 6, 5)
    assert as_grids(glitch.glitch_chain(df, 6, 5, bitmapSort=0.5, bitmapSortVertical=True))["a", "black"] == sorted_and_frayed(
        grid, "black", 0.5, True, 6, 5)
    spot = [[0.05 + 0.9 * ((x, y) == (4, 5)) for x in range(12)] for y in range(13)]
    small = spark.createDataFrame([("a", 12, 13, "black", x, y, spot[y][x]) for y in range(13) for x in range(12)], df.schema)
    for vertical in (False, True):  # insets reach over the far side of a small box
        assert as_grids(glitch.glitch_chain(small, 4, 4, bitmapSort=0.5, bitmapSortVertical=vertical))["a", "black"] == sorted_and_frayed(
            spot, "black", 0.5, vertical, 4, 4)
    blank = df.withColumn("cov", F.lit(0.0))
    assert set(as_grids(glitch.frayed_edges(blank, 6, 5))["a", "black"].values()) == {0.0}


def test_chain_computes_its_input_once_and_without_python(spark, field, tmp_path):
    df, _ = field
    df.write.parquet(f"{tmp_path}/cov")
    out = glitch.glitch_chain(spark.read.parquet(f"{tmp_path}/cov"), 2, 3, sliceShift=2, gridWarp=2.0, warpScale=3, bitmapSort=0.6)
    out = out.select("image_id", "plate", "x", "y", "cov")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 2  # targets and source of the one gather
    assert plan.count("ReusedExchange") == 1 and plan.count("SortMergeJoin") == 2  # the gather, and the narrow line table
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_checkpoint_uses_the_configured_folder(spark, field):
    df, _ = field
    assert checkpoint(df.limit(3)).count() == 3
    assert "checkpoint" in spark.sparkContext.getCheckpointDir()
