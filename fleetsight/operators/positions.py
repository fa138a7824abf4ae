"""Dense positions in a total order without a single sorting task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetsight.session import ensure_checkpoint_dir

_ROW_BITS = 33


def global_position(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``, the 0-based rank of each row in ``order`` (which should be unique).

    Rows are range-partitioned, so equal shares go to every task however the values lie; a row's
    rank is its place in its partition plus the sizes of the partitions before it. The ranged
    rows are checkpointed to the shared folder, because partition numbers must not change
    between counting and ranking.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint()
        .withColumns({
            "_part": F.shiftright("_mid", _ROW_BITS),
            "_row": F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1),
        })
    )
    # One row per partition; the running total over them is tiny whatever the data size.
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # Bounded by the number of shuffle partitions.
    placed = ranged.join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_row")).drop("_mid", "_part", "_row", "_before")
