"""Time slices with a look-back, the unit of work for per-key windows.

A key may hold a large share of all rows, so nothing that needs event order is keyed by the key
alone. Rows are keyed by (key, slice), where a slice is named by its start; rows that a later
slice can still see are copied into it as ``carried`` rows. Widths are a multiple of the
look-back, so few rows are copied and a row reaches at most the next slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetsight.session import ensure_checkpoint_dir

SLICE_FACTOR = 4
MIN_SLICE_NS = 3_600_000_000_000
# Slices of this width are narrow enough to spread any group; wider ones are checked for size.
NARROW_SLICE_NS = 24 * MIN_SLICE_NS
ROWS_PER_PIECE = 2_000_000
STEPS_PER_SLICE = 4096

_START = "(`{c}` - pmod(`{c}`, _width))"


def slice_width(look_back_ns: int, min_width_ns: int = MIN_SLICE_NS) -> int:
    return max(SLICE_FACTOR * look_back_ns, min_width_ns)


def _placed(df: DataFrame, order_ns: str, look_back: Column, width: Column) -> DataFrame:
    """Adds ``_back``, ``_width`` and the start of the row's own slice."""
    start = f"CASE WHEN _width > 0 THEN {_START.format(c=order_ns)} ELSE 0L END"
    return df.withColumns({"_back": look_back, "_width": width}).withColumn("_own", F.expr(start))


def with_slices(df: DataFrame, order_ns: str, look_back: Column, width: Column) -> DataFrame:
    """Adds ``slice`` and ``carried``. A width of 0 puts every row into the single slice 0."""
    placed = _placed(df, order_ns, look_back, width)
    slices = F.expr(
        f"CASE WHEN _width > 0 AND `{order_ns}` + _back >= _own + _width "
        "THEN array(_own, _own + _width) ELSE array(_own) END"
    )
    return (
        placed.withColumn("slice", F.explode(slices))
        .withColumn("carried", F.col("slice") > F.col("_own"))
        .drop("_back", "_width", "_own")
    )


def with_even_slices(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    look_back: Column,
    width: Column,
    newest: int,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """As ``with_slices``, but slices with more than ``rows_per_piece`` rows are cut into pieces.

    Only the ``newest`` rows before a piece can matter to it, so pieces of a busy slice, and the
    slice after it, are handed those instead of everything in the look-back. Cuts follow the
    rows' density. The rows are checkpointed, as they are counted before they are cut.
    """
    ensure_checkpoint_dir(df.sparkSession)
    clock = order[0]
    rows = _placed(df, clock, look_back, width).checkpoint()
    slot = [*keys, "_own"]
    busy = (
        rows.where("_width > 0").groupBy(*slot, "_width").count().where(F.col("count") > rows_per_piece)
    )
    plain = with_slices(rows.drop("_own"), clock, F.col("_back"), F.col("_width"))
    if busy.isEmpty():
        return plain
    cuts = _cuts(rows, busy, slot, clock, rows_per_piece)
    here = cuts.select(*slot, F.col("cuts").alias("_here"), F.lit(None).cast("array<bigint>").alias("_next"))
    before = cuts.select(
        *keys, F.expr("_own - _width AS _own"), F.lit(None).cast("array<bigint>").alias("_here"), F.col("cuts").alias("_next")
    )
    around = here.unionByName(before).groupBy(*slot).agg(F.max("_here").alias("_here"), F.max("_next").alias("_next"))
    near = rows.join(around, slot, "left")
    quiet = F.col("_here").isNull() & F.col("_next").isNull()
    calm = with_slices(near.where(quiet).drop("_own", "_here", "_next"), clock, F.col("_back"), F.col("_width"))
    pieces = near.where(~quiet).withColumns({
        "slice": F.expr(f"coalesce(array_max(filter(_here, x -> x <= `{clock}`)), _own)"),
        "_later": F.expr(
            f"filter(concat(coalesce(_here, array(_own)), coalesce(_next, array(_own + _width))), "
            f"x -> x > `{clock}` AND x <= `{clock}` + _back)"
        ),
    })
    last = W.partitionBy(*keys, "slice").orderBy(*[F.desc(c) for c in order])
    tails = (
        pieces.withColumn("_rn", F.row_number().over(last))
        .where(F.col("_rn") <= newest)
        .withColumn("slice", F.explode("_later"))
        .withColumn("carried", F.lit(True))
    )
    columns = plain.columns
    own = pieces.withColumn("carried", F.lit(False))
    return calm.select(*columns).unionByName(own.select(*columns)).unionByName(tails.select(*columns))


def _cuts(rows: DataFrame, busy: DataFrame, slot: Sequence[str], clock: str, rows_per_piece: int) -> DataFrame:
    """Starts of the pieces of each busy slice: runs of short steps with about equal row counts."""
    step = F.expr(f"(`{clock}` - _own) DIV greatest(_width DIV {STEPS_PER_SLICE}, 1L)")
    steps = (
        rows.join(busy.select(*slot), slot, "left_semi")
        .groupBy(*slot, "_width", step.alias("_step"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    running = W.partitionBy(*slot).orderBy("_step").rowsBetween(W.unboundedPreceding, -1)
    piece = F.floor(F.coalesce(F.sum("_n").over(running), F.lit(0)) / rows_per_piece)
    begin = F.expr(f"_own + min(_step) * greatest(_width DIV {STEPS_PER_SLICE}, 1L)")
    starts = steps.withColumn("_piece", piece).groupBy(*slot, "_width", "_piece").agg(begin.alias("_begin"))
    # The first piece starts with its slice. A slice has at most one piece per step.
    return starts.groupBy(*slot, "_width").agg(
        F.array_sort(F.array_distinct(F.concat(F.array(F.col("_own")), F.collect_list("_begin")))).alias("cuts")
    )
