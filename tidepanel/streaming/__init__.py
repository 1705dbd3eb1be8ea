"""Micro-batch upkeep of the long table.

The panel is a batch workload; what changes over time is that provisional months are
published again. ``latest_revision`` is the one incremental operator: it keeps the last
published row of each key and runs in ``foreachBatch`` as well as over a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_revision(rows: DataFrame, keys: list[str], published: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last(published))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def follow(stream: DataFrame, target: str, keys: list[str], published: str, checkpoint: str):
    """Append every micro-batch's latest rows to ``target``; readers apply latest_revision."""

    def write(batch: DataFrame, _: int) -> None:
        latest_revision(batch, keys, published).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
