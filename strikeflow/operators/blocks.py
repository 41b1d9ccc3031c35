"""Long series in blocks of time, so that one series is many tasks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length of a block where the caller states none.
WEEK = timedelta(days=7)


def in_blocks(df: DataFrame, by: str, halo: int, width: timedelta = WEEK, time: str = "timestamp") -> DataFrame:
    """The rows of each series with `_block`, and `_own` true; and again, with `_own` false, in every block that they come at most `halo` rows before.

    Windows over (by, _block) that look back `halo` rows then give a block's own rows what windows over the whole series would. Rows
    meet on the series and block only. How far a row reaches follows from counts: one row for each block is all that a
    series gathers. Blocks may be empty or short, then rows reach over several. Rows of one time are in no order.
    """
    at = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(width // timedelta(microseconds=1)))
    rows = df.withColumn("_block", at)
    counts = rows.groupBy(by, "_block").agg(F.count("*").alias("_n"))
    ahead = F.collect_list(F.struct("_block", "_n")).over(Window.partitionBy(by).orderBy("_block").rowsBetween(1, halo))
    # (block, rows between): of the blocks that come next, those that a last row of this one can reach
    reach = F.reduce(
        ahead, F.struct(F.lit(0).cast("long").alias("between"), F.array().cast("array<struct<block: long, between: long>>").alias("to")),
        lambda s, b: F.struct((s["between"] + b["_n"]).alias("between"), F.when(s["between"] < halo, F.array_append(s["to"], F.struct(b["_block"].alias("block"), s["between"].alias("between")))).otherwise(s["to"]).alias("to")),
    )["to"]
    targets = counts.select(by, "_block", reach.alias("_to"))
    nth = F.row_number().over(Window.partitionBy(by, "_block").orderBy(F.desc(time)))
    tails = rows.withColumn("_nth", nth).where(F.col("_nth") <= halo).join(targets, [by, "_block"])
    sent = tails.withColumn("_t", F.explode("_to")).where(F.col("_nth") + F.col("_t.between") <= halo).withColumn("_block", F.col("_t.block"))
    return rows.withColumn("_own", F.lit(True)).unionByName(sent.drop("_nth", "_to", "_t").withColumn("_own", F.lit(False)))
