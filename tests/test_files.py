"""Sources and outputs round trip on generated files."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from inkloom.functions.fixed_values import REFUSALS
from inkloom.operators import preflight, screen, separate
from inkloom.operators import settings as st
from inkloom.sources import images, projects, sinks


def png(w, h, pixel):
    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(w)) for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture()
def art(tmp_path):
    folder = tmp_path / "art"
    folder.mkdir()
    (folder / "ramp.png").write_bytes(png(7, 5, lambda x, y: (30 * x, 40 * y, (x * y) % 256)))
    (folder / "flat.png").write_bytes(png(3, 2, lambda x, y: (9, 8, 7)))
    return str(folder)


def test_pixels_of_png_files(spark, art):
    px = images.scan_images(spark, art)
    got = {(r.image_id, r.x, r.y): (r.w, r.h, r.r, r.g, r.b, r.a) for r in px.collect()}
    assert len(got) == 35 + 6
    assert got["ramp.png", 6, 4] == (7, 5, 180, 160, 24, 255) and got["flat.png", 0, 1] == (3, 2, 9, 8, 7, 255)
    assert separate.plate_stats(separate.coverage(px)).where("plate IS NULL").first().pixels == 4 * 41


def test_header_scan_and_intake(spark, art):
    audit = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.refusal) for r in images.intake_audit(images.scan_headers(spark, art)).collect()}
    assert {(name, *audit[name]) for name in ("ramp.png", "flat.png")} == {("ramp.png", 7, 5, None), ("flat.png", 3, 2, None)}


def test_broken_files_are_refused_and_listed(spark, art, tmp_path):
    import pathlib
    import shutil

    folder = shutil.copytree(art, tmp_path / "mixed")
    good = pathlib.Path(folder, "ramp.png").read_bytes()
    (folder / "cut.png").write_bytes(good[:20])
    (folder / "wide.png").write_bytes(good[:16] + (20_000).to_bytes(4, "big") + good[20:24])
    audit = {r.path.rsplit("/", 1)[1]: r.refusal for r in images.intake_audit(images.scan_headers(spark, str(folder))).collect()}
    assert audit["ramp.png"] is None and audit["cut.png"] == REFUSALS["invalid"] and audit["wide.png"] == REFUSALS["dimensions"]
    assert {r.image_id for r in images.refused_images(spark, str(folder)).collect()} == {"cut.png", "wide.png"}
    assert images.scan_images(spark, str(folder)).count() == 35 + 6


def test_picture_sizes_of_other_formats():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x07" + b"\0" * 9
    webp = lambda kind, rest: b"RIFF\0\0\0\0WEBP" + kind + rest + b"\0" * 20
    assert images.picture_size(jpeg) == (7, 5) and images.picture_size(jpeg[:9]) is None and images.picture_size(b"") is None
    assert images.picture_size(webp(b"VP8X", b"\0" * 8 + b"\x06\0\0\x04\0\0")) == (7, 5)
    assert images.picture_size(webp(b"VP8L", b"\0\0\0\0\x2f" + (6 | 4 << 14).to_bytes(4, "little"))) == (7, 5)
    assert images.picture_size(webp(b"VP8 ", b"\0" * 10 + b"\x07\0\x05\0")) == (7, 5)


@pytest.mark.parametrize("row,why", [
    (("image/svg+xml", 10, "89504E470D0A1A0A", 5, 5), "type"), (("image/png", 0, "89504E470D0A1A0A", 5, 5), "empty"),
    (("image/png", 50 * 1024 * 1024 + 1, "89504E470D0A1A0A", 5, 5), "bytes"), (("image/png", 9, "FFD8FF", 5, 5), "signature"),
    (("image/png", 9, "89504E470D0A1A0A", 10000, 10000), None), (("image/png", 9, "89504E470D0A1A0A", 16385, 1), "dimensions"),
    (("image/png", 9, "89504E470D0A1A0A", 10001, 10000), "dimensions"), (("IMAGE/JPEG", 9, "FFD8FF00", 0, 100), "invalid"),
    (("image/webp", 9, "524946460000000057454250", 4, 4), None)])
def test_intake_rules(spark, row, why):
    df = spark.createDataFrame([row], "declared_type string, length long, hexed string, width int, height int")
    got = images.intake_audit(df.withColumn("head", F.unhex("hexed"))).first().refusal
    assert got == (REFUSALS[why] if why else None)


def test_project_files(spark, tmp_path):
    layers = [{"name": "a", "image_b64": "x", "effect_params": {"ascii_charset": "dots", "unknown": 1, "cell": 12, "spiro_d": 4, "rd_scale": 9.5, "geoflow_fill": False}},
              {"name": "b", "visible": False, "opacity": 0.5, "image_b64": "y", "scale_pct": 40}]
    (tmp_path / "one.json").write_text(json.dumps({"version": 2, "layers": layers, "dpi": 240}, indent=1))
    rows = projects.project_layers(projects.scan_projects(spark, str(tmp_path))).orderBy("z").collect()
    assert [(r.name, r.visible, r.scale_pct, r.opacity, r.selected) for r in rows] == [
        ("a", True, 100, 1.0, False), ("b", False, 40, 0.5, True)]
    assert rows[0].params["ascii_charset"] == "dots" and rows[0].params["cell"] == "12"
    assert (rows[0].params["spiro_d"], rows[0].params["rd_scale"], rows[0].params["geoflow_fill"]) == ("4", "9.5", "false")
    assert "unknown" not in rows[0].params and rows[0].params["pixelate_block_size"] == "20" and rows[1].params is None


def test_vector_files_hold_every_mark(spark, tmp_path):
    head = spark.createDataFrame([("i", "cyan", 48, 24, 48, 24, 8.0, 15.0), ("i", "black", 48, 24, 48, 24, 8.0, 45.0)],
                                 "image_id string, plate string, w int, h int, sw int, sh int, cell double, angle double")
    marks = screen.dot_size(screen.screen_lattice(head).where("plate = 'cyan'").withColumn("cov", F.lit(0.5)))
    marks = marks.withColumn("shape", F.lit("round"))
    regs = screen.registration_marks(head.select("image_id", "plate", "w", "h"))
    out = f"{tmp_path}/svg"
    sinks.write_plate_svg(sinks.svg_lines(marks, head, regs), out)
    body = spark.read.text(f"{out}/image_id=i/plate=cyan").collect()
    lines = [r.value for r in body]
    assert sum(v.startswith("<circle") for v in lines) == marks.count()
    assert lines[0].startswith('<svg xmlns="http://www.w3.org/2000/svg" width="0.2000in" height="0.1000in" viewBox="0 0 48 24">')
    assert lines[-1] == "</svg>" and sum(v.startswith('<g opacity="0.7">') for v in lines) == 4
    assert "\n".join(lines).count("<g") == "\n".join(lines).count("</g>")
    assert spark.read.text(f"{out}/image_id=i/plate=black").count() == 3 + 2 + 4 + 1 - 1


def test_vector_files_resolve_their_references(spark, tmp_path):
    import xml.etree.ElementTree as ET

    head = spark.createDataFrame([("i", "cyan", 48, 24, "<svg viewBox='0 0 1 1'><path d='M 0 0 h 1'/></svg>", None), ("i", "black", 48, 24, None, "<svg><g/></svg>")],
                                 "image_id string, plate string, w int, h int, dot_symbol string, registration_symbol string")
    marks = spark.createDataFrame([("i", "cyan", 0, 0, 4.0, 5.0, 3.0, "custom", 2.5), ("i", "cyan", 0, 1, 9.0, 5.0, 8.0, "circle-outline", 2.5)],
                                  "image_id string, plate string, u_idx int, v_idx int, cx double, cy double, size double, shape string, stroke double")
    runs = spark.createDataFrame([("i", "black", 3, 2, 5)], "image_id string, plate string, y int, x0 int, length int")
    regs = screen.registration_marks(head.select("image_id", "plate", "w", "h"))
    sinks.write_plate_svg(sinks.svg_lines(marks, head, regs, runs), f"{tmp_path}/svg")
    seen = {}
    for plate in ("cyan", "black"):
        text = "".join(r.value for r in spark.read.text(f"{tmp_path}/svg/image_id=i/plate={plate}").collect())
        root = ET.fromstring(text)
        ids = {e.get("id") for e in root.iter() if e.get("id")}
        used = [e.get("href")[1:] for e in root.iter() if e.tag.endswith("use")]
        assert set(used) <= ids
        seen[plate] = (ids, len(used), text)
    assert seen["cyan"][:2] == ({"dot-shape"}, 1) and seen["black"][:2] == ({"registration-shape"}, 4)
    assert 'stroke-width="2.5000"' in seen["cyan"][2] and '<rect x="2.0000" y="3.0000" width="5.2500" height="1.2500"/>' in seen["black"][2]


def test_plate_package_and_manifest(spark, art, tmp_path):
    cov = separate.coverage(images.scan_images(spark, art))
    sinks.write_plate_package(cov, f"{tmp_path}/plates")
    assert {r.ink: r["count"] for r in spark.read.parquet(f"{tmp_path}/plates").groupBy("ink").count().collect()} == dict.fromkeys("CMYK", 41)
    sinks.write_plate_package(cov, f"{tmp_path}/grey", grayscale=True)
    assert [r.ink for r in spark.read.parquet(f"{tmp_path}/grey").select("ink").distinct().collect()] == ["K"]


def job(spark, **change):
    row = {"job_id": 1, "sheet_id": "11x15", "orientation": "portrait", "cell_size": 12.0, "invert": False,
           "grayscale": False, "registration": True, "source_name": "My Art!.final.PNG", "src_w": 800, "src_h": 600,
           "scale_pct": 100, "dot_shape": "round", "mirror": False, "mirror_direction": "horizontal", **change}
    angles = change.pop("angles", (15.0, 75.0, 0.0, 45.0))
    visible = change.pop("visible", (True, True, True, True))
    row.pop("angles", None), row.pop("visible", None)
    four = lambda v: F.struct(*[F.lit(x).alias(p) for p, x in zip(("cyan", "magenta", "yellow", "black"), v)])
    return spark.createDataFrame([row]).withColumns({"angles": four(angles), "visible": four(visible)})


def test_clean_job_has_nothing_to_review(spark, tmp_path):
    df = job(spark)
    assert preflight.preflight_count(df).first().reviews == 0
    values = [r.value for r in preflight.preflight_report(df).orderBy("seq").collect()]
    assert values[:4] == ["4/4 enabled", "All four angles are distinct", "Marks included", "Standard positive"]
    assert values[4].endswith("estimated marks/plate (K at 45°)")
    sinks.write_manifest(df, f"{tmp_path}/manifest")
    doc = json.loads(spark.read.text(f"{tmp_path}/manifest").first().value)
    assert doc["package"] == "my-art-final-CMYK-plates.zip" and doc["output"]["width"] == 2640 and doc["output"]["dpi"] == 240
    assert doc["settings"]["stroke_width"] == 1 and doc["settings"]["angles"]["black"] == 45 and doc["registration_size"] == 120
    assert doc["settings"]["custom_shape"] is None and doc["registration_mode"] == "corners"


def test_every_check_fires(spark):
    df = job(spark, sheet_id="15x22", cell_size=4.0, invert=True, registration=False, angles=(45.0, 75.0, 405.0, 45.0),
             visible=(True, False, True, True))
    r = preflight.preflight_count(df).first()
    assert r.reviews == 5 and r.marks == 2464900 and r.worst_plate == "cyan"
    values = [v.value for v in preflight.preflight_report(df).orderBy("seq").collect()]
    assert values[0] == "M hidden" and values[1] == "C/Y/K share 45°"
    gate = preflight.mark_budget_gate(df).first()
    assert gate.blocked and "2,464,900 marks per plate exceeds the 2,000,000 limit" in gate.notice


def test_grayscale_uses_black_only(spark):
    r = preflight.preflight_count(job(spark, grayscale=True, visible=(False, False, False, True))).first()
    assert r.hidden == 0 and r.worst_plate == "black"
    text = sinks.job_ticket(job(spark, grayscale=True)).first().ticket
    assert "Color mode: Grayscale (K)" in text and "Angles: K 45°" in text and "Enabled plates: K" in text


def test_ticket_prints_what_the_job_holds(spark):
    plain = sinks.job_ticket(job(spark)).first().ticket.split("\n")
    assert len(plain) == 21 and "Outline stroke: 1px" in plain and "Registration mode: Four corners" in plain
    full = job(spark).withColumns({"stroke_width": F.lit(2.5), "registration_size": F.lit(90), "registration_offset": F.lit(75),
                                   "registration_weight": F.lit(3.0), "registration_mode": F.lit("centered"), "dot_shape": F.lit("custom"),
                                   "custom_shape": F.lit("star.svg"), "registration_shape": F.lit("mark.svg")})
    lines = sinks.job_ticket(full).first().ticket.split("\n")
    assert len(lines) == 23 and {"Outline stroke: 2.5px", "Registration size: 90px", "Registration offset: 75px", "Registration weight: 3px",
                                 "Registration mode: Top/bottom centered", "Custom SVG: star.svg (stretched to square)",
                                 "Registration SVG: mark.svg"} <= set(lines)


GOOD = {"cellSize": 12, "opacity": 4, "invert": False, "dotShape": "round",
        "angles": {"cyan": 15, "magenta": 75, "yellow": 0, "black": 375},
        "visible": {"cyan": True, "magenta": True, "yellow": True, "black": True}}


@pytest.mark.parametrize("change,field", [
    ({}, None), ({"cellSize": 0}, "cellSize"), ({"cellSize": -3}, "cellSize"), ({"cellSize": 257}, "cellSize"),
    ({"dotShape": "hexagon"}, "dotShape"), ({"dotShape": "custom"}, "customShape"), ({"customShape": None}, "customShape"),
    ({"strokeWidth": 0}, "strokeWidth"), ({"strokeWidth": 0.24}, "strokeWidth"), ({"strokeWidth": 10.01}, "strokeWidth"),
    ({"strokeWidth": "1"}, "strokeWidth"), ({"strokeWidth": None}, "strokeWidth"), ({"grayscale": "true"}, "grayscale"),
    ({"diffusionIntensity": 0.75}, None), ({"diffusionLevels": "8"}, "diffusionLevels"), ({"angles": []}, "angles.cyan"),
    ({"visible": 3}, "visible"), ({"opacity": None}, "opacity")])
def test_settings_rules(spark, change, field):
    df = spark.createDataFrame([(json.dumps({**GOOD, **change}),)], "settings string")
    r = st.validate_settings(df).first()
    assert (r.field, r.ok) == (field, field is None)
    if r.ok:
        assert r.value.angles.black == 15 and r.value.opacity == 1
        assert (r.diffusion is not None) == ("diffusionIntensity" in change)


def test_settings_need_an_object(spark):
    df = spark.createDataFrame([("null",), ("7",), ("{",), ("[]",)], "settings string")
    assert [r.field for r in st.validate_settings(df).collect()] == ["settings"] * 3 + ["cellSize"]
