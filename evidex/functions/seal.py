"""A fence between computed columns and what is done with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seal(df: DataFrame, *computed: str) -> DataFrame:
    """The same rows, with ``computed`` columns fenced off.

    A filter on a computed column is normally pushed below the projection that computes it, by writing
    the expression into the filter. For columns built in many steps this repeats the whole chain at
    every reference: planning explodes, and costly parts (a JSON parse, a colour distance) run many
    times per row. A one-element ``inline`` keeps such filters above the computation; it moves no data.
    """
    kept = [c for c in df.columns if c not in computed]
    return df.select(*kept, F.inline(F.array(F.struct(*computed))))
