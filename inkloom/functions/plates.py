"""Plate dimension: order, short names and unpivoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import PLATES, PLATE_SHORT


def plate_index(plate) -> Column:
    """Position of the plate in print order, 0..3."""
    return (F.array_position(F.array(*[F.lit(p) for p in PLATES]), F.col(plate) if isinstance(plate, str) else plate)
            - 1).cast("int")


def plate_case(values, plate="plate") -> Column:
    """CASE over the plate name; ``values`` maps plate name to a column or literal."""
    out = None
    for name, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(F.col(plate) == name, value) if out is None else out.when(F.col(plate) == name, value)
    return out


def short_name(plate="plate") -> Column:
    return plate_case(PLATE_SHORT, plate)


def unpivot_plates(df: DataFrame, ids: list[str], value: str = "cov", plates: list[str] | None = None) -> DataFrame:
    """One row per plate from columns named after the plates (no shuffle). Rows are stacked, as Spark forgets after an unpivot how a table
    is dealt out."""
    wanted = PLATES if plates is None else plates
    if not wanted:
        return df.select(*ids, F.lit("").alias("plate"), F.lit(0.0).alias(value)).where("false")
    cells = [c for p in wanted for c in (F.lit(p), F.col(p).cast("double"))]
    return df.select(*ids, F.stack(F.lit(len(wanted)), *cells).alias("plate", value))
