"""Collected rasters for comparison with nested-loop results."""


def as_grids(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["image_id"], r["plate"]), {})[r["x"], r["y"]] = r["cov"]
    return out
