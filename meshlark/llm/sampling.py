"""Bounded training samples, drawn by a hash so that they repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 30


def labelled_sample(rows: DataFrame, label_col: str, id_col: str, per_label: int) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows of each non-null label (never over twice that on the whole), and the rows that each label has.

    The labels are counted first; a row is taken if a hash of its id falls below its
    label's share. The shares go to the tasks as a map: a row a label.
    """
    named = rows.filter(F.col(label_col).isNotNull())
    counts = {r[0]: r[1] for r in named.groupBy(label_col).count().collect()}
    if not counts:
        return named.limit(0), counts
    cut = rows.sparkSession.createDataFrame([(k, int(min(1.0, per_label / n) * _SPAN)) for k, n in counts.items()], f"_label {rows.schema[label_col].dataType.simpleString()}, _cut long")
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(_SPAN))
    taken = named.join(F.broadcast(cut), F.col(label_col) == F.col("_label")).filter(draw < F.col("_cut")).select(*rows.columns)
    return taken.limit(2 * per_label * len(counts)), counts
