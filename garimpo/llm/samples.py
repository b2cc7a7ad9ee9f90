"""Bounded samples of texts for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def sampled(docs: DataFrame, id_col: str, text: str, rows: int, most_chars: int) -> list[Row]:
    """Texts (t) of the ``rows`` rows with the smallest hashed ids, of 1 to
    ``most_chars`` characters. Rows with a hash above a cut that about twice as many
    rows lie below are left out first, so that what reaches the driver does not grow
    with the number of tasks."""
    fit = docs.where(F.length(text).between(1, most_chars)).select(F.xxhash64(id_col).alias("h"), F.col(text).alias("t"))
    n = docs.count()
    if n > 2 * rows:
        fit = fit.where(F.col("h") < -(1 << 63) + int((1 << 64) * (2 * rows / n)))
    return fit.orderBy("h", "t").limit(rows).collect()
