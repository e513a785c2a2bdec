"""Ordered scans over groups of any size.

Held keys, open spans and gestures all ask one question: what was the last known value before
(or the next after) this row in its group? ``carry`` answers it with a window. One window is
one task, so a group that holds a large share of all rows must not be one window: ``split_hot``
cuts such groups into consecutive slices of bounded size, and ``carry`` is then a parallel prefix:
each slice is summed up by what it sets, clears or leaves, only the sums are scanned along the
slices, and each slice starts from what its predecessors ended with.

Both are part of the one plan of the query. Nothing is counted while a plan is built; a table
without hot groups is found out at run time, where the slicing falls away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE, FINE = "_slice", "_fine"

# A group above this many rows is cut; a slice holds less than twice as many.
HOT_ROWS = 2_000_000


def split_hot(
    df: DataFrame,
    group: list[str],
    cell: str | Column | None = None,
    finer: tuple[str, ...] = ("ts_us", "ord"),
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Cut groups of more than ``hot_rows`` rows into slices along ``cell`` and ``finer``.

    Cells, by default about a second of a log, are counted, and neighbours make up a slice until
    it is full. A cell too large for a slice is cut at each value of the finer numbers and, along
    the last of them, every ``hot_rows`` values. So a slice is bounded whether rows are spread
    evenly, crowd in a second, or all lie in one microsecond; and the sums to scan are bounded by
    the length of a recording, at most one per microsecond of its crowded seconds.
    ``_slice`` and ``_fine`` never decrease along the order; rows of other groups have no
    ``_slice``. ``counted`` is a table cheaper to count that holds all rows of ``df``, and maybe more.
    """
    number = (F.shiftright("ts_us", 20) if cell is None else F.col(cell) if isinstance(cell, str) else cell).alias("_cell")
    sizes = (df if counted is None else counted).groupBy(*group, number).agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*group)
    before = F.sum("_n").over(inside.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = sizes.withColumns({"_before": F.coalesce(before, F.lit(0)), "_all": F.sum("_n").over(inside)})
    place = cells.where(F.col("_all") > hot_rows).select(
        *group, "_cell", F.floor(F.col("_before") / hot_rows).alias(SLICE), (F.col("_n") > hot_rows).alias("_dense")
    )
    *exact, last = [F.col(c).cast("bigint") for c in finer]
    parts = [F.col("_dense"), *exact, F.floor(last / hot_rows)]
    fine = F.struct(*[F.when(F.col("_dense"), p.cast("bigint")).otherwise(0).alias(f"p{i}") for i, p in enumerate(parts)])
    return df.withColumn("_cell", number).join(place, [*group, "_cell"], "left").withColumn(FINE, fine).drop("_cell", "_dense")


def carry(
    df: DataFrame,
    group: list[str],
    order: list[str],
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    dense: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add the last value that is not null ``before`` each row, and the first one ``after`` it.

    Both map new column names to values. ``dense`` states that no value is ever null, so that
    the neighbouring row decides and one sort serves both directions. ``source`` is a table with
    the same rows that is cheaper to sum up, where ``df`` only has further columns.
    """
    before, after = before or {}, after or {}
    values = {**before, **after}
    sliced = SLICE in df.columns
    keys = [*group, SLICE, FINE] if sliced else group

    def last_before(window, ordering):
        return window.orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1)

    backwards = [F.col(c).desc() for c in order]
    # The slice first: rows dealt by recording and slice serve the finer groups within them too.
    rows = Window.partitionBy(*keys)
    if dense:
        local = {name: F.lag(v).over(rows.orderBy(*order)) for name, v in before.items()}
        local.update({name: F.lead(v).over(rows.orderBy(*order)) for name, v in after.items()})
    else:
        local = {name: F.last(v, True).over(last_before(rows, order)) for name, v in before.items()}
        local.update({name: F.last(v, True).over(last_before(rows, backwards)) for name, v in after.items()})
    if not sliced:
        return df.withColumns(local)

    # One row per slice of the cut groups: what it passes on at its end and at its start. A slice
    # that leaves a value as it is passes on none, and the scan looks past it.
    place = F.struct(*order)
    passed = {name: F.max_by(v, F.when(v.isNotNull(), place)) for name, v in before.items()}
    passed.update({name: F.min_by(v, F.when(v.isNotNull(), place)) for name, v in after.items()})
    ends = (
        (df if source is None else source)
        .where(F.col(SLICE).isNotNull())
        .groupBy(*keys)
        .agg(*[v.alias(f"_end_{name}") for name, v in passed.items()])
    )
    along = Window.partitionBy(*group)
    forth = last_before(along, [SLICE, FINE])
    back = last_before(along, [F.col(SLICE).desc(), F.col(FINE).desc()])
    handed = ends.select(
        *keys,
        *[F.last(f"_end_{name}", True).over(forth if name in before else back).alias(f"_in_{name}") for name in values],
    )
    joined = df.withColumns(local).join(handed, keys, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.col(f"_in_{name}")) for name in values}).drop(
        *[f"_in_{name}" for name in values]
    )
