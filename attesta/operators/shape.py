"""Column order and cell form of every output table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import cell_text


def effective_columns(
    df: DataFrame, include_provenance: bool = True, columns: Sequence[str] | None = None
) -> list[str]:
    """Substantive columns, then the provenance columns present; other ``_`` columns stay hidden."""
    names = list(columns or df.columns)
    out = [c for c in names if not c.startswith("_")]
    return out + [c for c in names if c in fixed.PROVENANCE_COLUMNS] if include_provenance else out


def flat_cells(
    df: DataFrame, include_provenance: bool = True, columns: Sequence[str] | None = None
) -> DataFrame:
    """Text cells under headers without the leading underscore."""
    names = effective_columns(df, include_provenance, columns)
    return df.select([cell_text(F.col(c), df.schema[c].dataType).alias(c.lstrip("_")) for c in names])
