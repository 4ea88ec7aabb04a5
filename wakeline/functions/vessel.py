"""Vessel type codes to classes and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wakeline.constants import (
    COMMERCIAL_CODE_RANGES,
    COMMERCIAL_SHIP_TYPES,
    VESSEL_CLASS_RANGES,
    VESSEL_LABEL_RANGES,
    VESSEL_LABELS,
)


def vessel_class(code: Column) -> Column:
    out = F.when(code.isNull(), F.lit(0))
    for low, high, cls in VESSEL_CLASS_RANGES:
        out = out.when(code.between(low, high), F.lit(cls))
    return out.otherwise(F.lit(8))


def vessel_label(text: Column) -> Column:
    """Label of a type held as text: numbers go through the code table, other text passes."""
    trimmed = F.trim(text)
    code = trimmed.try_cast("double").try_cast("int")
    table = F.create_map(*[F.lit(x) for pair in VESSEL_LABELS.items() for x in pair])
    label = F.when(trimmed.isNull() | (trimmed == ""), F.lit("Unknown"))
    label = label.when(code.isNull(), trimmed)
    label = label.when(F.try_element_at(table, code).isNotNull(), F.try_element_at(table, code))
    for low, high, name in VESSEL_LABEL_RANGES:
        label = label.when(code.between(low, high), F.lit(name))
    return label.otherwise(F.concat(F.lit("Type "), code.cast("string")))


def is_commercial(code: Column, text: Column) -> Column:
    """Numeric sources are judged by code, text sources by ship type."""
    by_code = F.lit(False)
    for low, high in COMMERCIAL_CODE_RANGES:
        by_code = by_code | code.between(low, high)
    return F.coalesce(
        F.when(code.isNotNull(), by_code).otherwise(text.isin(*COMMERCIAL_SHIP_TYPES)), F.lit(False)
    )
