"""Neighbourhood work on square tiles with a copied border: one exchange, whatever the reach."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import floor_div

TILE = 256  # side of a tile, unless the reach is longer
FRAME = ["image_id", "w", "h", "plate"]
HELD = 1 << 20  # pixels of a stack of tiles

#: stack of dense blocks, origin (y, x) of the blocks, core ((y0, y1), (x0, x1)), frame (h, w) -> one stack of the core's shape per output
Work = Callable


def tile_map(cov: DataFrame, reach: int, work: Work, outputs: list[str]) -> DataFrame:
    """Apply ``work`` to every tile of a dense raster; each output is a column of doubles beside ``image_id, w, h, plate, x, y``.

    A pixel goes to its tile and to those within ``reach`` of it. A tile is one row, a list of its pixels in any order, which is the only
    exchange; none is needed where pixels of an image already lie together. Tiles of the same shape are worked on as one stack, about
    ``HELD`` pixels at a time, so many small sheets cost no step each and a task holds little, whatever the frame. A missing pixel
    counts as 0 and is filled in. nan in an output means that there is no value.
    """
    side = max(TILE, reach)

    def places(pos, size):
        first, last = F.greatest(F.lit(0), floor_div(pos - reach, side)), F.least(floor_div(size - 1, side), floor_div(pos + reach, side))
        return F.explode(F.sequence(first, last).cast("array<int>"))

    spread = cov.select(*FRAME, "x", "y", "cov", places(F.col("y"), F.col("h")).alias("ty"))
    keys = [*FRAME, "ty", "tx"]
    packed = spread.withColumn("tx", places(F.col("x"), F.col("w"))).groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "cov")).alias("px"))
    kinds = dict(cov.dtypes)
    done = packed.mapInArrow(_tiles(side, reach, work, outputs), f"image_id {kinds['image_id']}, w int, h int, plate string, ty int, tx int, "
                             + ", ".join(f"{o} array<double>" for o in outputs))
    width = F.least(F.lit(side), F.col("w") - F.col("tx") * side)
    cells = done.select(*keys, *outputs[1:], F.posexplode(outputs[0]).alias("at", outputs[0]))
    cells = cells.withColumns({o: F.get(o, F.col("at")) for o in outputs[1:]}) if outputs[1:] else cells
    value = lambda o: F.when(~F.isnan(o), F.col(o)).alias(o)
    return cells.select(*FRAME, (F.col("tx") * side + F.col("at") % width).cast("int").alias("x"),
                        (F.col("ty") * side + floor_div(F.col("at"), width)).cast("int").alias("y"), *map(value, outputs))


def _tiles(side: int, reach: int, work: Work, outputs: list[str]):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            shapes = np.stack([batch.column(c).to_numpy() for c in (1, 2, 4, 5)], axis=1)
            alike = np.lexsort(shapes.T)
            batch, shapes = batch.take(pa.array(alike)), shapes[alike]
            count = batch.column(6).value_lengths().to_numpy()
            start = np.cumsum([0, *count])
            px = batch.column(6).flatten()
            x, y, cov = (px.field(c).to_numpy(zero_copy_only=False) for c in range(3))
            cuts = np.flatnonzero((shapes[1:] != shapes[:-1]).any(1)) + 1
            for first, last in zip([0, *cuts], [*cuts, len(shapes)], strict=True):
                if first == last:
                    continue
                w, h, ty, tx = map(int, shapes[first])
                core = [(t * side, min(n, (t + 1) * side)) for t, n in ((ty, h), (tx, w))]
                (ya, yb), (xa, xb) = ((max(0, lo - reach), min(n, hi + reach)) for (lo, hi), n in zip(core, (h, w), strict=True))
                step = max(1, HELD // ((yb - ya) * (xb - xa)))
                for lo in range(int(first), int(last), step):
                    hi = min(int(last), lo + step)
                    own = slice(start[lo], start[hi])
                    blocks = np.zeros((hi - lo, yb - ya, xb - xa))
                    blocks[np.repeat(np.arange(hi - lo), count[lo:hi]), y[own] - ya, x[own] - xa] = cov[own]
                    columns = [batch.column(c).slice(lo, hi - lo) for c in range(6)]
                    for o in work(blocks, (ya, xa), core, (h, w)):
                        ends = np.arange(hi - lo + 1) * (o.size // (hi - lo))
                        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(o).ravel())))
                    yield pa.RecordBatch.from_arrays(columns, names=["image_id", "w", "h", "plate", "ty", "tx", *outputs])
    return run


def mirrored(low: int, high: int, size: int):
    """Places low .. high - 1 of an endless line of ``size`` places that turns back at its ends (each end place twice)."""
    import numpy as np

    place = np.arange(low, high) % (2 * size)
    return np.where(place < size, place, 2 * size - 1 - place)


def blurred(sigma: float) -> tuple[int, Work]:
    """Reach and work of a separable Gaussian with mirrored borders; the work gives the blurred and the plain core."""
    radius = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * k * k / (sigma * sigma)) for k in range(-radius, radius + 1)]
    weights = [v / sum(raw) for v in raw]

    def work(block, origin, core, frame):
        (y0, y1), (x0, x1) = core
        plain = block[..., y0 - origin[0]:y1 - origin[0], x0 - origin[1]:x1 - origin[1]]
        wide = block[..., mirrored(y0 - radius, y1 + radius, frame[0]) - origin[0], :]
        down = sum(wide[..., k:k + y1 - y0, :] * v for k, v in enumerate(weights))
        wide = down[..., mirrored(x0 - radius, x1 + radius, frame[1]) - origin[1]]
        return sum(wide[..., k:k + x1 - x0] * v for k, v in enumerate(weights)), plain
    return radius, work


def corners(block, origin, core, frame):
    """The plain core and its neighbours to the right, below, and below to the right; nan outside the frame."""
    import numpy as np

    (y0, y1), (x0, x1) = core
    padded = np.full((*block.shape[:-2], y1 - y0 + 1, x1 - x0 + 1), np.nan)
    own = block[..., y0 - origin[0]:y1 - origin[0] + 1, x0 - origin[1]:x1 - origin[1] + 1]
    padded[..., :own.shape[-2], :own.shape[-1]] = own
    return padded[..., :-1, :-1], padded[..., :-1, 1:], padded[..., 1:, :-1], padded[..., 1:, 1:]
