"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabledeltas.sources import files

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def working_folder(spark: SparkSession) -> str:
    return files.scratch_directory(spark)


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write to shared storage and read back: cuts the lineage, survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, order: Sequence[Column], path: str, number: str) -> DataFrame:
    """Every row with its gapless place (from 0) in the global order, computed without a
    single-task sort: rows are range-partitioned, counted per partition and offset. Only one
    row per partition is ever summed in one task. End ``order`` with something that tells the
    rows of a hot key apart, so that the ranges can split it."""
    part, place, before = fresh(df, "_part", "_place", "_before")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(
        dealt.withColumns(
            {
                part: F.spark_partition_id(),
                place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
            }
        ),
        path,
    )
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    running = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part, F.coalesce(F.sum(before).over(running), F.lit(0)).alias(before))
    return (
        placed.join(F.broadcast(offsets), part)  # one row per partition of the range shuffle
        .withColumn(number, F.col(before) + F.col(place))
        .drop(part, place, before)
    )


def hex_fraction(digest: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
